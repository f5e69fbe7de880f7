import pickle
import tracemalloc

import numpy as np
import pytest

from spindrel.llm import decontaminate


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def prose(r, words, n):
    return " ".join(r.choice(words, n))


@pytest.fixture
def words():
    r = np.random.default_rng(4)
    return ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(150)]


def test_starts_and_ends_are_those_of_the_copy(words):
    r = np.random.default_rng(9)
    item = decontaminate.plain(prose(r, words, 18))[:110].strip()
    index = decontaminate.Index([(1, item)])
    for edits in range(5):
        for _ in range(8):
            copy = list(item)
            for k in range(edits):
                at = int(r.integers(5, len(copy) - 5))
                copy[at : at + 1] = [["z"], [], [copy[at], "z"]][k % 3]
            before, copy = prose(r, words, 20) + " ", "".join(copy)
            whole = [x for x in index.find(f"{before}{copy} {prose(r, words, 20)}") if x[2] - x[1] > 70]
            text = f"{before}{copy}"
            assert whole
            for _, start, end, k in whole:
                assert abs(start - len(before)) <= k and abs(end - len(before) - len(copy)) <= k and distance(item, text[start:end]) == k
    found = index.find(f"{'x' * 140} {item} yes")
    assert (1, 141, 141 + len(item), 0) in found


def test_items_of_a_word_are_listed_and_not_looked_for(spark, words):
    benchmark = spark.createDataFrame([(1, "a"), (2, "--"), (3, "Tiny one"), (4, None), (5, "is a longer item"), (6, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "this is a fine text, a tiny one"), (2, "it is a longer item, and more")], "doc_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, benchmark).collect()] == [(2, 5)]
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, benchmark, least=1).collect()) == [(1, 1), (1, 3), (2, 1), (2, 5)]
    assert {x.item_id for x in decontaminate.short_items(benchmark).collect()} == {1, 2, 3, 6}
    assert [x.doc_id for x in decontaminate.drop_leaks(docs, benchmark).collect()] == [1]


def test_blocks_of_a_large_benchmark_find_the_same(spark, words, monkeypatch):
    r = np.random.default_rng(5)
    items = [(i, prose(r, words, 20)) for i in range(12)]
    rows = [(i, f"{prose(r, words, 30)} {items[i][1] if i < 12 and i % 2 else ''} {prose(r, words, 30)}", i) for i in range(20)] + [(30, None, 1), (None, items[3][1], 2), (1, "", 3)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string, __sha2 int"), spark.createDataFrame(items, "item_id long, text string")
    once, kept = sorted(map(str, decontaminate.find_leaks(docs, benchmark).collect())), sorted(map(str, decontaminate.drop_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 200)
    assert len(list(decontaminate.blocks(benchmark))) > 3
    assert sorted(map(str, decontaminate.find_leaks(docs, benchmark).collect())) == once
    assert sorted(map(str, decontaminate.drop_leaks(docs, benchmark).collect())) == kept and len(kept) == 16


def test_an_index_has_a_bounded_size(words):
    r = np.random.default_rng(5)
    items = [(i, "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz "), 300))) for i in range(3000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    index = decontaminate.Index(items)
    raw = pickle.dumps(index)
    assert len(raw) < 45 * size and tracemalloc.get_traced_memory()[1] < 250 * size
    tracemalloc.stop()
    assert pickle.loads(raw).find(decontaminate.plain(f"words {items[7][1]} words"))

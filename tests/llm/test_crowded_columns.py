import random

import pytest

from spindrel.llm import components as stars
from spindrel.llm import ngram_jaccard
from test_ngram_jaccard import brute


def crowd(seed=8):
    """Families of near copies of several sizes that share a passage, and texts that have only the passage in common."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    docs = []
    for family, (length, copies) in enumerate([(60, 70), (60, 25), (64, 3), (90, 40), (300, 12)]):
        base = [r.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            at = 0 if family % 2 else len(w) // 2
            docs.append(" ".join(w[:at] + passage + w[at:]))
    docs += [" ".join([r.choice(vocabulary) for _ in range(r.choice([5, 6, 50, 61]))] + passage) for _ in range(40)]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("sample,block", [(0, 1 << 11), (1 << 18, 1 << 11), (0, 1 << 17), (500, 1 << 9)])
def test_crowds_match_every_pair(spark, monkeypatch, sample, block):
    monkeypatch.setattr(ngram_jaccard, "COLUMN_SAMPLE", sample)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "LEAST", 1 << 4)
    docs = crowd()
    members, links = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80, longest=4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == brute(docs, 3, 80)
    assert links.where("x = y").count() == 0


def test_sets_that_share_half_a_name_stay_apart(spark):
    rows = [(1, 2, 77, 5, b"a"), (2, 2, 77, 6, b"b"), (3, 2, 77, 5, b"a"), (4, 2, 78, 9, b"c"), (5, 0, None, None, None)]
    out = {r.doc_id: r for r in ngram_jaccard._apart(spark.createDataFrame(rows, "doc_id long, n long, cls long, rest long, least binary")).collect()}
    assert out[1].cls == out[3].cls != out[2].cls and out[4].cls == 78 and out[5].cls is None and out[2].first == 77


def test_hubs_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(stars, "HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(i, 500 + i) for i in range(0, 60, 7)] + [(900, 901), (901, 902)] + [(700, 800 + i) for i in range(30)] + [(59, 700)]
    got = {r.node: r.comp for r in stars.components(spark.createDataFrame(edges, "x long, y long").repartition(3)).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {x: 900 if 900 <= x <= 902 else 0 for x in nodes}

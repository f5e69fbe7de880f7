import hashlib
from collections import Counter

import numpy as np
import pytest

from spindrel.llm import merkle


def plain_likeness(a, b):
    """Dice share of the code points of all phrases, without any tree."""
    if a == b:
        return 1.0
    counts = []
    for text in (a, b):
        c = Counter()
        for line in text.split("\n"):
            for p in merkle.phrases(line):
                c[p] += len(p)
        counts.append(c)
    x, y = counts
    total = sum(x.values()) + sum(y.values())
    return min(2 * sum((x & y).values()) / total, 1 - 1 / (total + 1)) if total else 0.0


def test_likeness_by_branches_is_the_plain_one():
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdhlp."), r.integers(2, 9))) for _ in range(60)]
    lines = [" ".join(r.choice(words, r.integers(0, 40))) for _ in range(30)]
    for _ in range(60):
        a = "\n".join(lines[i] for i in r.integers(0, 30, r.integers(0, 25)))
        b = list(a)
        for _ in range(int(r.integers(0, 4))):
            at = int(r.integers(0, len(b) + 1))
            b[at : at + int(r.integers(0, 30))] = list(" ".join(r.choice(words, 3)))
        b = "".join(b) if r.random() < 0.8 else "\n".join(reversed(a.split("\n")))
        x, y = merkle.Tree.of(a), merkle.Tree.of(b)
        assert merkle.likeness(x, y) == pytest.approx(plain_likeness(a, b)) == pytest.approx(merkle.likeness_of(y.dump(), x.dump()))
    a, b = "one line of text here.\nand another one there.", "and another one there.\none line of text here."
    assert 0.9 < merkle.likeness(merkle.Tree.of(a), merkle.Tree.of(b)) < 1


def test_roots_differ_for_many_short_texts():
    roots = {merkle.Tree.of(f"short text {i}").root for i in range(300_000)}
    assert len(roots) == 300_000


def test_query_columns_follow_from_the_fingerprints(spark):
    big = 2**53
    rows = [(big + i, f"text {i} with some words, and then more of them " * (i % 5 + 1)) for i in range(150)] + [(None, f"nameless {i} text of a few words") for i in range(90)] + [(7, f"seven {i}") for i in range(90)] + [(7, "seven 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as own", "3 as __order2")
    got = merkle.edited_fingerprints(df.repartition(5)).collect()
    assert len(got) == len(rows) and Counter(r.fingerprint for r in got) == Counter(merkle.Tree.of(t).dump() for _, t in rows)
    text = {merkle.Tree.of(t).dump(): t for _, t in rows}
    named = [t for i, t in sorted(rows[:150], reverse=True)]
    following = dict(zip(named, named[1:]))
    edges = []
    for r in got:
        own = text[r.fingerprint]
        assert r.near_edited == merkle.likeness_of(r.fingerprint, r.edited_fingerprint)
        k = len(own) // 3
        fits = [t for t in ([following[own]] if own in following else text.values()) if hashlib.sha256((own[: len(own) - k] + t[:k]).encode()).hexdigest() == r.edited_sha256]
        assert fits and any(r.near_next == merkle.likeness_of(r.fingerprint, merkle.Tree.of(t).dump()) for t in fits)
        edges.append(r.edited_sha256)
    assert len(edges) == len(rows)

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.operators import slots, topics


@pytest.fixture(scope="module")
def tokens(spark):
    r = np.random.default_rng(1)
    rows = [(d, p, f"w{int(r.integers(12))}") for d in range(-3, 30) for p in range(int(r.integers(1, 9)))]
    return spark.createDataFrame(rows, "doc_id long, pos long, term string")


@pytest.mark.parametrize("together", [1, 24, 99])
def test_blocks_sample_as_single_documents_do(spark, tokens, together, monkeypatch):
    monkeypatch.setattr(topics, "TOGETHER", together)
    monkeypatch.setattr(slots, "LEAST", 20)
    start = tokens.withColumn("z", F.pmod(F.xxhash64(F.lit(3), "doc_id", "pos"), F.lit(3)).cast("int")).orderBy("doc_id", "pos").collect()
    z, places, v = np.array([x.z for x in start]), {}, len({x.term for x in start})
    for i, x in enumerate(start):
        places.setdefault(x.doc_id, []).append(i)
    for sweep in range(2):
        words, n, new = Counter((x.term, t) for x, t in zip(start, z.tolist())), np.bincount(z, minlength=3).astype(float), z.copy()
        for d, own in places.items():
            r, nd = np.random.default_rng([3, sweep, d & 0xFFFFFFFF]), np.bincount(z[own], minlength=3).astype(float)
            for i in own:
                nd[new[i]] -= 1
                p = (0.5 + nd) * (0.1 + np.array([words[start[i].term, k] for k in range(3)], float)) / (v * 0.1 + n)
                new[i] = np.searchsorted(np.cumsum(p), r.random() * p.sum())
                nd[new[i]] += 1
        z = new
    got = {(x.doc_id, x.pos): (x.term, x.topic) for x in topics.collapsed_gibbs(tokens, 3, 2, seed=3).collect()}
    assert got == {(x.doc_id, x.pos): (x.term, t) for x, t in zip(start, z.tolist())}


def test_a_step_moves_terms_of_blocks_not_slots(spark, monkeypatch):
    many = spark.createDataFrame([(d, p, f"w{p % 3}") for d in range(8) for p in range(50)], "doc_id long, pos long, term string")
    monkeypatch.setattr(slots, "LEAST", 200)
    s = slots.Slots(many, {}, lambda block, x: ([], block.summed(np.ones((len(block.at), 1)))))
    assert s.blocks == 2 == s.work.count() and s.words.count() <= 6
    assert {r.term: r.n[0] for r in s.sums(1).collect()} == {"w0": 136, "w1": 136, "w2": 128}


def test_equal_slots_of_a_document_share_a_row(spark):
    rows = [(d, p, "ab"[p % 2]) for d in (1, 2) for p in range(6)]
    fit = topics.SimpleHierarchicalTopicModel([[0, 1], [0, 2]])
    fit.fit(spark.createDataFrame(rows, "doc_id long, pos long, term string"), 2)
    shares = fit.slot_leaves.collect()
    assert len(shares) == 24 and {(r.doc_id, r.pos, r.term) for r in shares} == set(rows)
    assert len({(r.doc_id, r.term, r.leaf, r.p) for r in shares}) == 8
    assert {(r.doc_id, r.leaf) for r in fit.leaf_shares.collect()} == {(d, a) for d in (1, 2) for a in (0, 1)}
    by = {}
    for r in shares:
        by[r.doc_id, r.pos] = by.get((r.doc_id, r.pos), 0) + r.p
    assert all(x == pytest.approx(1) for x in by.values())

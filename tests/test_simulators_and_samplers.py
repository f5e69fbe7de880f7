import numpy as np
import pytest

from spindrel.operators import samplers, simulators

TREE = {0: [1, 2], 1: [3, 4], 2: [5, 6]}


def test_walks_end_where_they_may(spark):
    def shares(stop):
        rows = simulators.walk_corpus(spark, 60, 30, TREE, 12, stop=stop, seed=3).groupBy("node").count().collect()
        return {r["node"]: r["count"] / 1800 for r in rows}

    leaf, path, ended = shares("leaf"), shares("path"), shares("exit")
    assert set(leaf) == {3, 4, 5, 6}
    assert set(path) == set(range(7)) and abs(path[0] - 1 / 3) < 0.05
    assert set(ended) == set(range(7)) and abs(ended[0] - 1 / 3) < 0.12
    with pytest.raises(ValueError):
        simulators.walk_corpus(spark, 1, 1, {0: [1], 2: [1]}, 3)
    with pytest.raises(ValueError):
        simulators.walk_corpus(spark, 1, 1, TREE, 3, stop="other")


def test_walks_follow_weights_and_given_topics_and_repeat(spark):
    one = lambda n: np.eye(7)[n]
    weigh = lambda a, b: 1000.0 if b in (2, 6) else 1e-3
    df = simulators.walk_corpus(spark, 5, 20, TREE, 7, alpha=weigh, topic=one)
    rows = df.collect()
    assert len(rows) == 100 and all(r.term == r.node for r in rows) and sum(r.node == 6 for r in rows) > 95
    assert sorted(rows) == sorted(df.repartition(3).collect())


def test_nested_documents_share_their_tree(spark):
    rows = simulators.nested_corpus(spark, 40, 30, 10, alpha=0.2, beta=1.0, seed=1).collect()
    assert len(rows) == 1200 and all(0 <= r.term < 10 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.path, set()).add(r.doc_id)
    assert len(by[""]) > 20 and max(len(v) for p, v in by.items() if p) > 10


def test_grid_documents_and_spectra(spark):
    t = simulators.grid_topics(3)
    assert t.shape == (6, 9) and np.allclose(t.sum(1), 1) and t[0].nonzero()[0].tolist() == [0, 1, 2] and t[3].nonzero()[0].tolist() == [0, 3, 6]
    assert all((r.term // 3 == r.node) if r.node < 3 else (r.term % 3 == r.node - 3) for r in simulators.grid_corpus(spark, 10, 20, 3).collect())
    peak = (float(np.log(2)), 0.0, float(np.log(7)), 0.0, float(np.log(0.5)), 0.0)
    row = simulators.draw_spectra(spark, 1, [(2.0, [peak])], [1.0, 2.0, 3.0]).first()
    assert row.ys == pytest.approx([14 * np.exp(-2), 14, 14 * np.exp(-2)])


def test_uniform_density(spark):
    df = spark.createDataFrame([(x,) for x in (0.9, 1.0, 2.0, 3.0, 3.1, None)], "x double")
    assert [r[0] for r in df.select(simulators.uniform_density(df.x, 1, 3)).collect()] == [0, 0.5, 0.5, 0.5, 0, None]


def test_stored_sweeps_by_burn_in_lag_and_reset():
    assert samplers.TreeGibbs([[0]], burn_in=2, lag=1).stored(8) == [2, 4, 6]
    assert samplers.TreeGibbs([[0]], burn_in=0, lag=0).stored(3) == [0, 1, 2]
    assert samplers.TreeGibbs([[0]], burn_in=2, lag=0, reset=2).stored(9) == [2, 3, 6, 7]


def test_gibbs_keeps_slots_and_tells_topics_apart(spark):
    rows = [(d, p, f"{'xy'[d % 2]}{p % 5}") for d in range(20) for p in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, term string")
    fit = samplers.TreeGibbs([[0, 1], [0, 2]], burn_in=9, lag=0, reset=1, seed=5)
    out = fit.fit(df, 10).collect()
    assert sorted((r.doc_id, r.pos, r.term) for r in out) == sorted(rows) and {r.sample for r in out} == {0}
    assert all(0 <= r.leaf < 2 and 0 <= r.depth < 2 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.leaf)
    assert np.mean([max(np.mean(v), 1 - np.mean(v)) for v in by.values()]) > 0.9
    assert fit.fit(df.limit(0), 2).count() == 0


def test_l1_kmeans_against_a_plain_loop(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.3, (n, 3)) for c, n in ((0, 30), (5, 20), (9, 10))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found, centres = samplers.l1_kmeans(df, 3, seed=4)
    c = np.array(centres)
    label = np.array([p.cluster for p in found.orderBy("id").collect()])
    assert (np.abs(x[:, None] - c).sum(2).argmin(1) == label).all()
    assert all(np.allclose(x[label == k].mean(0), c[k]) for k in range(3) if (label == k).any())
    assert (np.diff(np.bincount(label, minlength=3)) <= 0).all()
    with pytest.raises(ValueError):
        samplers.l1_kmeans(df.limit(2), 3)

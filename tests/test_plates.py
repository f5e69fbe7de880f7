import numpy as np
import pytest

from spindrel.operators import models, plates, topics


def test_forward_draws_follow_what_they_refer_to(spark):
    m = plates.PlateModel({"doc": 40, "slot": 50, "topic": 3}, seed=2)
    p = m.constant("p", [0.2, 0.0, 0.8])
    z = m.categorical("z", p, "doc", "slot")
    own = m.deterministic("own", lambda t: t * 10, [m.categorical("fixed", m.constant("one", [0.0, 1.0]), "topic")], "topic")
    m.deterministic("w", lambda a, b: a + b, [plates.Ref("own", z), z], "doc", "slot")
    t = m.sample(spark, "z", "w", "own")
    got = {(r.doc, r.slot): r.value for r in t["z"].collect()}
    assert len(got) == 2000 and set(got.values()) == {0, 2} and abs(np.mean([v == 2 for v in got.values()]) - 0.8) < 0.04
    assert own.name == "own" and {r.value for r in t["own"].collect()} == {10}
    assert {(r.doc, r.slot): r.value for r in t["w"].collect()} == {k: v + 10 for k, v in got.items()}


def test_shares_are_drawn_once_and_repeat(spark):
    m = plates.topic_mixture(30, 20, 2, 5, seed=1)
    t = m.sample(spark, "theta", "w", "phi")
    theta = {r.doc: r.value for r in t["theta"].collect()}
    assert len(theta) == 30 and all(sum(v) == pytest.approx(1) for v in theta.values()) and t["phi"].count() == 2
    assert sorted(t["w"].collect()) == sorted(plates.topic_mixture(30, 20, 2, 5, seed=1).sample(spark, "w")["w"].collect())


def test_faults_and_text(spark):
    m = plates.topic_mixture(2, 3, 2, 4)
    assert m.log_joint().splitlines() == ["sum_doc log Dirichlet(theta[doc] | alpha)", "+ sum_topic log Dirichlet(phi[topic] | beta)", "+ sum_doc sum_slot log theta[doc][z[doc, slot]]", "+ sum_doc sum_slot log phi[z[doc, slot]][w[doc, slot]]"]
    assert m.log_joint(latex=True).startswith("\\sum_{doc=1}^{2} \\log Dirichlet")
    with pytest.raises(ValueError):
        m.dirichlet("theta", plates.Ref("alpha"), "doc")
    with pytest.raises(ValueError):
        m.categorical("x", plates.Ref("theta", "doc"), "slot")
    m.deterministic("a", lambda x: x, [plates.Ref("b")])
    m.deterministic("b", lambda x: x, [plates.Ref("a")])
    with pytest.raises(ValueError, match="circle"):
        m.sample(spark, "a")


def test_partition_votes_among_centres(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (60, 2)), r.normal(12, 1, (40, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    side = {p.id: p.side for p in models.partition_by_representatives(df, 10, n_neighbors=3).collect()}
    assert len(side) == 100 and len({side[i] for i in range(60)}) == 1 and side[0] != side[99]


def test_fit_takes_a_start_and_stops_when_told(spark):
    rows = [(d, p, f"{'xy'[d % 2]}{p % 3}") for d in range(6) for p in range(9)]
    slots = spark.createDataFrame(rows, "doc_id long, pos long, term string")
    seen = []
    fit = topics.SimpleHierarchicalTopicModel([[0, 1], [0, 2]])
    start = lambda node, term: (((node == 1) & term.startswith("x")) | ((node == 2) & term.startswith("y"))).cast("double")
    dv = fit.fit(slots, 5, start=start, after=lambda e, t: seen.append(sorted(t)) or e == 1)
    assert len(fit.history) == 2 == len(seen) and seen[0] == ["d", "dd", "dl", "dv", "l"]
    assert sum(fit.history[-1]["mass"].values()) == pytest.approx(54 + 3 * 6 * 0.1) and fit.history[-1]["entropy"] > 0
    best = {(r.node, r.term[0]): r.val for r in dv.collect()}
    assert best[1, "x"] > best[1, "y"] and best[2, "y"] > best[2, "x"]

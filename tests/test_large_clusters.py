import numpy as np
import pytest

from spindrel.operators import trees


def _greedy(sizes):
    sides, out = [0, 0], []
    for size, many in sorted(sizes, reverse=True):
        for _ in range(many):
            s = int(sides[1] < sides[0])
            sides[s] += size
            out.append((size, s))
    return out


def test_sides_of_components_match_one_by_one_placing():
    r = np.random.default_rng(0)
    for _ in range(300):
        sizes = [(int(s), int(r.integers(1, 9))) for s in r.choice(np.arange(1, 40), r.integers(1, 7), replace=False)]
        many = dict(sizes)
        found = [(size, first if k < m or (k - m) % 2 else 1 - first) for size, first, m in trees._sides(sizes) for k in range(many[size])]
        assert found == _greedy(sizes)


def _split(paths):
    return {frozenset(i for i, p in paths.items() if p[:1] == side) for side in "LR"}


def _points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")


def test_joins_cut_components_as_the_grouped_pass_does(spark):
    rows = [(50 * g + 0.1 * i, 0.3 * (i % 3)) for g, n in enumerate((9, 6, 5, 4)) for i in range(n)]
    df = _points(spark, rows)
    small, large = ({r.id: r.path for r in trees.HierClust(n_neighbors=4, dense=d).fit(df).collect()} for d in (2000, 8))
    assert _split(small) == _split(large)
    assert len(set(large.values())) == len(rows)


def test_joins_find_the_fiedler_cut_of_a_connected_node(spark):
    r = np.random.default_rng(3)
    rows = [*r.normal(0, 1, (14, 2)), *(r.normal(0, 1, (10, 2)) + [4.5, 0])]
    df = _points(spark, rows)
    small, large = ({x.id: x.path for x in trees.HierClust(n_neighbors=9, dense=d).fit(df).collect()} for d in (2000, 20))
    assert _split(small) == _split(large)


def test_one_sided_vectors_are_errors_and_tiny_weights_still_split():
    w = np.full((4, 4), 1e-200) * (1 - np.eye(4))
    assert set(trees._halves(w)) == {0, 1}
    with pytest.raises(ValueError), pytest.MonkeyPatch.context() as m:
        m.setattr(trees, "_fiedler", lambda w: np.ones(len(w)))
        trees._halves(np.ones((3, 3)))

from itertools import chain, combinations

import numpy as np
import pytest

from spindrel.operators import covers, extraction


def _greedy(sets, weights):
    left, out = set().union(*sets.values()), []
    while left:
        s = min(sets, key=lambda k: (-len(sets[k] & left) / weights.get(k, 1), k))
        out.append((s, len(sets[s] & left)))
        left -= sets[s]
    return out


def test_greedy_cover_with_and_without_weights(spark):
    r = np.random.default_rng(1)
    sets = {s: {int(x) for x in r.choice(12, r.integers(1, 6), replace=False)} for s in range(8)}
    df = spark.createDataFrame([(s, i) for s, v in sets.items() for i in v] + [(3, next(iter(sets[3]))), (None, 1), (2, None)], "s long, item long")
    assert [(x.s, x.gain) for x in covers.greedy_cover(df).orderBy("step").collect()] == _greedy(sets, {})
    weights = {0: 2.0, 5: 0.25}
    w = spark.createDataFrame(list(weights.items()), "s long, weight double")
    assert [(x.s, x.gain) for x in covers.greedy_cover(df, w).orderBy("step").collect()] == _greedy(sets, weights)
    assert covers.greedy_cover(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        covers.greedy_cover(df, w.selectExpr("s", "-weight as weight"))


def test_exact_cover_is_the_first_smallest():
    assert covers.exact_cover([{1, 2}, {3}, {1, 3}, {2, 3}, {1}]) == [0, 1]
    assert covers.exact_cover([{1}, {1, 2}, {1, 2}]) == [1]
    assert covers.exact_cover([]) == [] and covers.exact_cover([set()]) == []


def _matrix(edges, n, near=0.5):
    """Co-occurrence that falls with the distance in a tree and with depth, so that each rule finds the tree again."""
    parent = {b: a for a, b in edges}

    def up(x):
        return [x, *up(parent[x])] if x in parent else [x]

    x = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            common = max(len(up(c)) for c in up(a) if c in up(b))
            x[a, b] = near ** (len(up(a)) + len(up(b)) - 2 * common) * 0.5 ** len(up(a)) * 0.5 ** len(up(b))
    return x


TREE = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)]


def test_greedy_rules_find_a_planted_tree():
    x = _matrix(TREE, 7)
    assert sorted(extraction.greedy_tree(x)[1]) == TREE and extraction.greedy_tree(x)[0] == 0
    assert sorted(extraction.threshold_tree(x, 0.1)[1]) == TREE
    assert sorted(extraction.branching_tree(x, [2, 2])[1]) == TREE
    with pytest.raises(ValueError):
        extraction.branching_tree(x, [3, 2])


def test_depth_penalty_flattens():
    x = np.array([[5.0, 1.0, 1.0], [1.0, 2.0, 1.2], [1.0, 1.2, 2.0]])
    assert extraction.greedy_tree(x, apply_cond=False)[1] == [(0, 1), (1, 2)]
    assert extraction.greedy_tree(x, depth_penalty=0.5, apply_cond=False)[1] == [(0, 1), (0, 2)]


def test_conflicting_constraints_are_cut_by_strength():
    agree = [(0, 1, 2, 1.0), (2, 3, 0, 1.0)]
    assert extraction.weighted_tree([0, 1, 2, 3], agree) == ((0, 1), (2, 3))
    fight = agree + [(1, 2, 3, 0.01)]
    assert extraction.build_tree([0, 1, 2, 3], [c[:3] for c in fight]) is None
    assert extraction.weighted_tree([0, 1, 2, 3], fight) == ((0, 1), (2, 3))
    with pytest.raises(ValueError):
        extraction.weighted_tree([], [])


def test_sequence_keeps_distinct_trees():
    ranked = [(0, 1, 2), (0, 1, 3), (2, 3, 0), (1, 2, 0)]
    found = extraction.tree_sequence([0, 1, 2, 3], ranked)
    assert [n for n, _ in found] == sorted({n for n, _ in found}) and all(a[1] != b[1] for a, b in zip(found, found[1:]))
    assert found[0] == (0, (0, 1, 2, 3)) and found[-1][1] == ((0, 1), (2, 3)) and found[-1][0] == 3


def test_transitive_reduction_by_brute_force():
    r = np.random.default_rng(5)

    def closure(e):
        e = set(e)
        while True:
            more = e | {(a, d) for a, b in e for c, d in e if b == c}
            if more == e:
                return e
            e = more

    for _ in range(20):
        edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 6, (7, 2)) if a != b})
        least = next(set(c) for c in chain.from_iterable(combinations(edges, k) for k in range(len(edges) + 1)) if closure(c) == closure(edges))
        assert set(extraction.transitive_reduction(edges)) == least
    with pytest.raises(ValueError):
        extraction.transitive_reduction([(0, 1), (1, 0)])


def test_analyse_reads_a_table(spark):
    x = _matrix(TREE, 7)
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(7) for j in range(7)], "i int, j int, p double")
    rows = extraction.analyse(df, 0.1).collect()
    assert {m: sorted((r.parent, r.child) for r in rows if r.method == m) for m in ("greedy", "threshold")} == {"greedy": TREE, "threshold": TREE}
    assert extraction.analyse(df.limit(0)).count() == 0

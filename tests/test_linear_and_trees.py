import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.operators import linear, neighbors, tables, trees
from spindrel.sources import files


def test_determinants_of_numbers_and_symbols():
    r = np.random.default_rng(0)
    for n in range(1, 7):
        m = r.integers(-5, 6, (n, n))
        assert linear.determinant(m.tolist()) == round(np.linalg.det(m))

    class S(str):
        def __add__(self, o):
            return S(f"({self:s}+{o:s})")

        def __sub__(self, o):
            return S(f"({self:s}-{o:s})")

        def __mul__(self, o):
            return S(f"{self:s}{o:s}")

    assert linear.determinant([[S("a"), S("b")], [S("c"), S("d")]]) == "(ad-bc)"
    assert linear.determinant([]) == 1
    with pytest.raises(ValueError):
        linear.determinant([[1, 2]])


def test_eigenvectors_and_lanczos():
    m = linear.random_psd(12, seed=3)
    assert np.linalg.eigvalsh(m).min() > -1e-9 and np.linalg.matrix_rank(linear.random_psd(9, 4)) == 4
    second = np.linalg.eigh(m)[1][:, -2]
    assert abs(second @ linear.second_eigenvector(m)) == pytest.approx(1, abs=1e-6)
    v, t = linear.lanczos(m, 12)
    assert np.allclose(v.T @ v, np.eye(12)) and np.allclose(v.T @ m @ v, t, atol=1e-8) and np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(m))
    v, t = linear.lanczos(np.diag([1.0, 1, 1, 2, 2]), 5)
    assert t.shape == (2, 2) and np.allclose(np.linalg.eigvalsh(t), [1, 2])


def test_condition_grows_with_sigma_and_timers_add_up():
    d = np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0)))
    c = linear.condition_numbers(d, [0.1, 1, 3])
    assert c[0] == pytest.approx(1) and c[0] < c[1] < c[2]
    now = iter(range(100))
    t = linear.Timers(lambda: next(now))

    def work(x):
        if x:
            raise KeyError
        return 5

    assert t.timed(work)(0) == 5
    with pytest.raises(KeyError):
        t.timed(work)(1)
    assert t.seconds == {"work": 2} and t.calls == {"work": 2}
    t.reset()
    assert not t.seconds


@pytest.fixture(scope="module")
def leaves(spark):
    return spark.createDataFrame([(1, "LL", 1.0), (2, "LL", 2.0), (3, "LR", 3.0), (4, "R", 4.0)], "id long, path string, x double")


def test_leaves_map_reduce_and_replace(spark, leaves):
    assert [r.x for r in trees.map_leaves(leaves, x=F.col("x") * 2).orderBy("id").collect()] == [2, 4, 6, 8]
    with pytest.raises(ValueError):
        trees.map_leaves(leaves, path=F.lit("L"))
    got = {r.node: (r.total, r.most) for r in trees.reduce_leaves(leaves, total=F.sum("x"), most=F.max("x")).collect()}
    assert got == {"": (10, 4), "L": (6, 3), "LL": (3, 2), "LR": (3, 3), "R": (4, 4)}
    parts = spark.createDataFrame([(1, "L"), (2, "R")], "id long, below string")
    new = trees.replace_leaves(leaves, parts)
    assert {r.id: r.path for r in new.collect()} == {1: "LLL", 2: "LLR", 3: "LR", 4: "R"}
    assert {r.id for r in trees.same_leaves(leaves, new).collect()} == {1, 2} and trees.same_leaves(leaves, leaves).count() == 0
    for bad in (parts.limit(1), spark.createDataFrame([(9, "L")], "id long, below string")):
        with pytest.raises(ValueError):
            trees.replace_leaves(leaves, bad)


def test_pretty(leaves):
    assert trees.pretty(leaves) == "root (4)\n  L (3)\n    L (2)\n    R (1)\n  R (1)"
    with pytest.raises(ValueError):
        trees.pretty(leaves, most=3)


def test_forests_are_stored_and_route_as_before(spark, tmp_path):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(90)], "id long, v array<double>")
    forest = neighbors.RPForest(2, 12, seed=4).fit(df)
    own = {(x.id, x.tree, x.path) for x in forest.leaves.collect()}
    assert {(x.id, x.tree, x.path) for x in forest.route(df).collect()} == own
    forest.write(str(tmp_path / "a"))
    (tmp_path / "a").rename(tmp_path / "b")
    again = neighbors.RPForest.read(spark, str(tmp_path / "b"))
    assert {(x.id, x.tree, x.path) for x in again.route(df).collect()} == own and again.seed == 4
    assert again.knn(df.where("id = 7"), 3).collect() == forest.knn(df.where("id = 7"), 3).collect()
    assert sum(x.n for x in again.leaf_sizes().collect()) == 180


def test_rows_through_a_function(leaves):
    assert [r.x for r in linear.apply_to_rows(leaves, lambda c: c + 1, "x").orderBy("id").collect()] == [2, 3, 4, 5]


def test_columns_by_pattern_and_json(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.1` int, a2 int, b int")
    assert tables.columns_like(df, "a").columns == ["a.1", "a2"] and tables.columns_like(df, ".*1").first()[0] == 1
    with pytest.raises(ValueError):
        tables.columns_like(df, "z")
    m = spark.createDataFrame([({"b": "1", "a": 'x"'},), (None,), ({},)], "m map<string,string>")
    assert [r[0] for r in m.select(tables.json_text(m.m)).collect()] == ['{"a":"x\\"","b":"1"}', None, "{}"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    p = tmp_path / "lines.txt"
    p.write_text("".join(f"line {i}\n" if i % 3 else "\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {r.line: r.value for r in files.numbered_lines(spark, str(p)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: f"line {i}" if i % 3 else "" for i in range(3000)}


def test_comments_need_a_header(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("# old\n# a , b\n1, 2\n")
    assert files.read_csv_after_comments(spark, str(p)).collect() == [("1", "2")]
    p.write_text("1,2\n")
    with pytest.raises(ValueError):
        files.read_csv_after_comments(spark, str(p))


def test_documents_snapshots_and_leaf_files(spark, leaves, tmp_path):
    t = spark.createDataFrame([(2, 1, "b"), (2, 0, "a"), (1, 0, "z"), (3, 0, None)], "doc_id long, pos long, term string")
    files.write_documents(t, str(tmp_path / "docs"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "docs")).collect()) == ["a b", "z"]
    assert files.write_snapshot({"t": t, "f": len, "n": 3}, str(tmp_path), "one") == ["f", "n"]
    assert spark.read.parquet(str(tmp_path / "one" / "t")).count() == 4
    files.write_csv_by_leaf(leaves.withColumnRenamed("path", "leaf_path"), str(tmp_path / "leaves"))
    for leaf, n in (("LL", 2), ("LR", 1), ("R", 1)):
        (one,) = (tmp_path / "leaves" / f"leaf_path={leaf}").glob("*.csv")
        assert one.read_text().splitlines()[0] == "id,x" and len(one.read_text().splitlines()) == n + 1

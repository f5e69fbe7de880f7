import gzip
import struct


import pytest

from spindrel.operators import neighbors, spectra, topics, trees
from spindrel.sources import files
from spindrel.streaming import jobs


def test_peaks_follow_the_fold(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(13)], [float(y) for y in (0, 5, 0, 4, 0, 9, 0, 8, 0, 0, 0, 6, 0)]), (2, [], []), (3, None, None)], "id long, xs array<double>, ys array<double>")
    found = {r.id: [(p.x, p.y) for p in r.peaks] for r in spectra.extract_peaks(df, 0.3, 2.0).collect()}
    assert found == {1: [(1.0, 5.0), (5.0, 9.0), (11.0, 6.0)], 2: [], 3: []}


def test_parsimonious_labels_cover(spark):
    peaks = spark.createDataFrame([(1, 10.1), (1, 20.1), (1, 30.1), (1, 40.1)], "id long, x double")
    lines = spark.createDataFrame([(10.0, "A"), (20.0, "A"), (20.0, "B"), (30.0, "C")], "wavelength double, name string")
    verbose = {r.x: r.labels for r in spectra.label_peaks(peaks, lines, 0.25).collect()}
    assert verbose == {10.1: ["A"], 20.1: ["A", "B"], 30.1: ["C"], 40.1: []}
    few = {r.x: r.labels for r in spectra.label_peaks(peaks, lines, 0.25, "PARSIMONIOUS").collect()}
    assert few == {10.1: ["A"], 20.1: ["A"], 30.1: ["C"], 40.1: []}
    with pytest.raises(ValueError):
        spectra.label_peaks(peaks, lines, 0.25, "other")


def test_emd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 1.0, 4.0])], "x array<double>, p array<double>, q array<double>")
    assert df.select(spectra.emd(F.col("p"), F.col("q"), F.col("x")).alias("e")).first().e == pytest.approx(1 / 6)


def test_knn_and_forest_find_the_planted_neighbour(spark):
    rows = [(0, [0.0] * 5), (1, [1.0] * 5)] + [(i, [5**0.5 + 1 if j == i % 5 else 0.0 for j in range(5)]) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    best = neighbors.knn(df, df.where("id = 0"), 1).first()
    assert best.id == 1 and best.dist == pytest.approx(5**0.5)
    leaves = neighbors.RPForest(2, 20).fit(df).leaves
    assert leaves.count() == 120 and leaves.groupBy("tree", "path").count().agg({"count": "max"}).first()[0] <= 20


def test_hierarchical_clusters_split_separate_groups(spark):
    rows = [(i, [float(i % 4), 0.1 * i]) for i in range(8)] + [(i, [100.0 + i % 4, 0.1 * i]) for i in range(8, 16)]
    paths = {r.id: r.path for r in trees.HierClust(n_neighbors=4).fit(spark.createDataFrame(rows, "id long, v array<double>")).collect()}
    assert len(set(paths.values())) == 16
    assert len({paths[i][0] for i in range(8)}) == 1 and paths[0][0] != paths[15][0]


def test_tree_algebra(spark):
    leaves = spark.createDataFrame([(1, "LLL", "a"), (2, "LLR", "a"), (3, "LR", "b"), (4, "RL", "b"), (5, "RR", "b")], "id long, path string, label string")
    g = {r.node: round(r.gini, 4) for r in trees.gini(trees.rollup(leaves, ["label"])).collect()}
    assert g["LL"] == 0 and g["R"] == 0 and g[""] == pytest.approx(0.48)
    assert {r.path for r in trees.prune(leaves, 1).collect()} == {"L", "R"}
    assert trees.integrity(leaves).count() == 0
    assert {r.fault for r in trees.integrity(leaves.unionByName(spark.createDataFrame([(6, "LR" + "L", "b")], "id long, path string, label string"))).collect()} == {"below a leaf", "one side"}


def test_topic_tree_recovery():
    assert topics.extract_tree([0, 1, 2, 3], [(1, 0, 2), (1, 0, 3), (3, 2, 0), (3, 2, 1)]) == (((0, 1), (2, 3)), 4)
    assert topics.build_tree([0, 1, 2], [(0, 1, 2), (1, 2, 0)]) is None


def test_file_formats(spark, tmp_path):
    (tmp_path / "bow").write_text("3 2:10 5:5 2:7\n1 4:1\n")
    assert {(r.doc_id, r.idx): r.n for r in files.read_bag_of_words(spark, str(tmp_path / "bow")).collect()} == {(0, 2): 17, (0, 5): 5, (1, 4): 1}
    (tmp_path / "bad").write_text("2 2:10\n")
    with pytest.raises(Exception, match="pairs"):
        files.read_bag_of_words(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "c.csv").write_text("# made by\n# a, b\n1, x\n2, y\n")
    assert [(r.a, r.b) for r in files.read_csv_after_comments(spark, str(tmp_path / "c.csv")).collect()] == [("1", "x"), ("2", "y")]
    (tmp_path / "l").write_text("Fe  1   2.5\nMg 2 3\n")
    assert [r.w for r in files.read_blank_separated(spark, str(tmp_path / "l"), "e string, n int, w double").collect()] == [2.5, 3.0]
    raw = struct.pack(">IIII", 2051, 2, 2, 2) + bytes(range(8))
    (tmp_path / "i.gz").write_bytes(gzip.compress(raw))
    assert [r["values"] for r in files.read_idx(spark, str(tmp_path / "i.gz")).collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    (tmp_path / "r.bin").write_bytes(bytes([7, 1, 2, 3, 9, 4, 5, 6]))
    assert [(r.label, r["values"]) for r in files.read_labelled_records(spark, str(tmp_path / "r.bin"), 3).collect()] == [(7, [1, 2, 3]), (9, [4, 5, 6])]
    (tmp_path / "d.xml").write_text("<all><doc id='1'><t> one </t></doc><doc><t>two</t><t>no</t></doc></all>")
    assert [r.text for r in files.read_xml_texts(spark, str(tmp_path / "d.xml"), "doc", "t[1]").collect()] == ["one", "two"]
    assert {(r.depth, r.tag) for r in files.xml_tags(spark, str(tmp_path / "d.xml")).collect()} == {(0, "all"), (1, "doc"), (2, "t")}
    assert files.newick("((A:1,B)x,C,D);") == [("LLL", "A"), ("LLR", "B"), ("LR", "C"), ("R", "D")]


def test_stream_ingests_once_and_seats(spark, tmp_path):
    src, dst, led = (str(tmp_path / n) for n in ("s", "d", "l"))
    spark.createDataFrame([("a", i) for i in range(20)], "room string, guest long").write.parquet(src)
    for _ in range(2):
        jobs.ingest(spark, src, "room string, guest long", dst, led)
    assert spark.read.parquet(dst).count() == 20
    stream = jobs.seat_guests(spark.readStream.schema("room string, guest long").parquet(src))
    query = stream.writeStream.format("memory").queryName("seats").trigger(availableNow=True).start()
    query.awaitTermination()
    places = [r.place for r in spark.sql("select place from seats").collect()]
    assert len(places) == 20 and set(places) == set(range(max(places) + 1))




def test_models(spark):
    from spindrel.operators import models

    rain = spark.createDataFrame([(1, 0.2), (0, 0.8)], "r int, p double")
    sprinkler = spark.createDataFrame([(1, 1, 0.01), (1, 0, 0.99), (0, 1, 0.4), (0, 0, 0.6)], "r int, s int, p double")
    wet = spark.createDataFrame([(0, 0, 1, 0.0), (0, 0, 0, 1.0), (1, 0, 1, 0.9), (1, 0, 0, 0.1), (0, 1, 1, 0.8), (0, 1, 0, 0.2), (1, 1, 1, 0.99), (1, 1, 0, 0.01)], "s int, r int, w int, p double")
    got = {x.r: x.p for x in models.query([rain, sprinkler, wet], ["r"], {"w": 1}).collect()}
    assert got[1] == pytest.approx(891 / 2491)
    assert all(x.p == 0 for x in models.query([rain, sprinkler, wet], ["w"], {"s": 0, "r": 0, "w": 1}).collect())
    d = [[0, 1, 9, 9.5], [1, 0, 8, 9], [9, 8, 0, 2], [9.5, 9, 2, 0]]
    assert models.linkage(d, "complete") == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 9.5, 4)]
    tree = models.spanning_tree(spark.createDataFrame([(0, 1, 3.0), (1, 2, 2.0), (2, 0, 1.0), (3, 2, 5.0)], "i long, j long, w double"))
    assert {(x.i, x.j) for x in tree.collect()} == {(0, 1), (1, 2), (2, 3)}
    paths = models.nested_crp(50, 3, 1.0)
    assert len(paths) == 50 and all(len(p) == 3 for p in paths) and paths[0] == (0, 0, 0)
    fit = models.fit_mixture(spark.createDataFrame([(float(i % 5),) for i in range(100)] + [(100.0 + i % 5,) for i in range(50)], "x double"), 2).collect()
    assert sorted(round(m["mean"]) for m in fit) == [2, 102] and max(m["weight"] for m in fit) == pytest.approx(2 / 3, abs=0.01)


def test_special_functions(spark):
    from pyspark.sql import functions as F

    from spindrel.functions.special import digamma, lgamma

    r = spark.range(1).select(digamma(F.lit(1.0)).alias("d"), lgamma(F.lit(0.5)).alias("g")).first()
    assert r.d == pytest.approx(-0.5772156649, abs=1e-9) and r.g == pytest.approx(0.5723649429, abs=1e-8)


def test_entry_has_no_query_without_its_table_of_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_forest_neighbours_follow_the_metric(spark):
    import numpy as np

    from spindrel.operators.neighbors import RPForest

    r = np.random.default_rng(3)
    v = r.standard_normal((60, 4)) * r.uniform(0.2, 5, (60, 1))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    forest = RPForest(trees=1, leaf_size=60).fit(points)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    plain = {"euclidean": np.linalg.norm(v[:, None] - v, axis=2), "cosine": 1 - unit @ unit.T, "abs_cosine": 1 - np.abs(unit @ unit.T)}
    for metric, d in plain.items():
        d = d.copy()
        np.fill_diagonal(d, np.inf)
        got = {(x.q, x["rank"]): x.id for x in forest.knn(points, 3, metric).collect()}
        assert got == {(q, k + 1): int(p) for q in range(60) for k, p in enumerate(np.argsort(d[q])[:3])}
    with pytest.raises(ValueError):
        forest.knn(points, 3, "taxi")

import duckdb
import numpy as np
import pytest

from spindrel.operators import neighbors


def write(spark, folder, rows):
    spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def expected(folder, sql):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    return sorted(db.execute(sql).fetchall())


@pytest.fixture(scope="module")
def rows():
    """Many equal vectors and near ones; no id but two is divisible by 100."""
    r = np.random.default_rng(5)
    v = np.round(r.normal(0, 1, (70, 6)), 2)
    v[20:45] = v[20]
    v[46] = v[47] + 1e-3
    return [(i + 60, x) for i, x in enumerate(v)]


@pytest.mark.parametrize("block", [2048, 7])
@pytest.mark.parametrize("name", ["dot_products", "knn_similarity", "rbf_similarity", "knn_graph", "knn_graph_mutual"])
def test_all_pairs_in_blocks_match_sql(spark, tmp_path, rows, name, block, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    folder = write(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in neighbors.CATALOG.queries[name](spark, folder).collect())
    want = expected(folder, neighbors.CATALOG.sql[name])
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    full = {"dot_products": 70 * 70, "rbf_similarity": 70 * 69}
    assert len(got) == full.get(name, len(got)) and len({i for r in got for i in r[:2]}) == 70 or name == "knn_graph_mutual"


@pytest.mark.parametrize("name", ["dot_products", "knn_similarity", "rbf_similarity"])
def test_uneven_vectors_follow_the_sql(spark, tmp_path, name):
    folder = write(spark, tmp_path, [(1, (1, 2, 3)), (2, (2, 1)), (3, (0, 1, 5)), (5, (1, 1, 1)), (5, (2, 0, 1))])
    assert sorted(tuple(r) for r in neighbors.CATALOG.queries[name](spark, folder).collect()) == expected(folder, neighbors.CATALOG.sql[name])


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "abs_cosine", "dot"])
def test_blocks_find_the_nearest(metric):
    r = np.random.default_rng(2)
    p, q = r.normal(0, 1, (500, 5)), r.normal(0, 1, (40, 5))
    p[100:300] = p[100]
    q[:3] = p[100]
    import pyarrow as pa

    def blocks():
        for a in range(0, 500, 90):
            part = np.arange(a, min(a + 90, 500))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (np.arange(100, 140), q, part, p[part])], ["a", "b", "c", "d"])

    got = {}
    for b in neighbors._best(blocks(), 4, metric, False):
        for i, j, _ in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(i, []).append(j)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    d = {"euclidean": np.sqrt(((q[:, None] - p) ** 2).sum(2)), "dot": -(q @ p.T), "cosine": 1 - unit(q) @ unit(p).T, "abs_cosine": 1 - np.abs(unit(q) @ unit(p).T)}[metric]
    d[np.arange(40), np.arange(100, 140)] = np.inf
    assert got == {100 + i: np.lexsort((np.arange(500), np.round(d[i], 9)))[:4].tolist() for i in range(40)}

"""Nearest neighbours: exact search in blocks, and forests of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.plans.catalog import Catalog, table
from spindrel.plans.dialects import DUCK, SPARK, both, run_sql
from spindrel.plans.scratch import save

CATALOG = Catalog()
#: Vectors of a block; a pair of blocks is one matrix product.
BLOCK = 2048
#: Blocks of points that a task holds; candidates that are compared at once; pairs of a batch that is handed on.
HELD, CHUNK, OUT = 64, 1 << 16, 1 << 17


def q(name):
    return both(CATALOG, name)


def _packed(batches: Iterator[pa.RecordBatch], size: int, keep: int | None) -> Iterator[pa.RecordBatch]:
    """(id, v) -> blocks (ids, vs) of up to ``size`` rows as bytes. Of equal vectors in a block only the ``keep`` smallest ids stay, if it is given and no id is repeated."""

    def block(ids: list, vs: list) -> pa.RecordBatch:
        i, v = np.concatenate(ids), np.concatenate(vs)
        if keep is not None and len(np.unique(i)) == len(i):
            order = np.argsort(i)
            i, v = i[order], np.ascontiguousarray(v[order]) + 0.0
            kind = np.unique(v.view(f"V{v.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
            order = np.argsort(kind, kind="stable")
            first = np.searchsorted(kind[order], kind[order])
            at = np.sort(order[np.arange(len(i)) - first < keep])
            i, v = i[at], v[at]
        return pa.RecordBatch.from_arrays([pa.array([i.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())], ["ids", "vs"])

    ids, vs, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        i, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat, dim = v.flatten().to_numpy(zero_copy_only=False), len(v.flatten()) // len(i)
        if v.null_count or (np.diff(v.offsets.to_numpy()) != dim).any() or not dim or vs and vs[0].shape[1] != dim:
            raise ValueError("all vectors must have one length, above 0")
        v = flat.reshape(-1, dim)
        for a in range(0, len(i), size):
            for x, y in ((i[a : a + size - held], v[a : a + size - held]), (i[a + size - held : a + size], v[a + size - held : a + size])):
                if len(x):
                    ids.append(x.copy()), vs.append(y.copy())
                    held += len(x)
                if held == size:
                    yield block(ids, vs)
                    ids, vs, held = [], [], 0
    if held:
        yield block(ids, vs)


def block_pairs(queries: DataFrame, points: DataFrame, keep: int | None = None) -> DataFrame:
    """(q_ids, q_vs, p_ids, p_vs): every block of queries with every block of points, as bytes. A task has some blocks of queries and at most about HELD blocks of points."""
    spark = points.sparkSession
    n, m = queries.count(), points.count() if points is not queries else None
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = min(BLOCK, max(1, -(-n // parts)))
    left = queries.select("id", "v").repartition(max(1, -(-n // size)), F.xxhash64("id")).mapInArrow(lambda it: _packed(it, BLOCK, None), "q_ids binary, q_vs binary")
    right = points.select("id", "v").mapInArrow(lambda it: _packed(it, BLOCK, keep), "p_ids binary, p_vs binary").repartition(max(1, -(-(n if m is None else m) // (BLOCK * HELD))))
    return left.crossJoin(right)


def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key of the queries' block, their ids and vectors, ids and vectors of the points) of rows of block_pairs."""
    for batch in batches:
        for row in range(batch.num_rows):
            raw = [batch.column(i)[row].as_buffer() for i in range(4)]
            qi, pi = (np.frombuffer(x, np.int64) for x in raw[::2])
            yield raw[0].to_pybytes(), qi, np.frombuffer(raw[1]).reshape(len(qi), -1), pi, np.frombuffer(raw[3]).reshape(len(pi), -1)


class _Metric:
    """Scores of a pair of blocks that rank its points as their distances do, but for rounding; ``limit`` is the score that a distance may reach, ``exact`` the distance itself of some pairs."""

    def __init__(self, metric: str, q: np.ndarray, p: np.ndarray) -> None:
        if metric not in ("euclidean", "cosine", "abs_cosine", "dot"):
            raise ValueError(f"unknown metric {metric}")
        self.metric, self.q, self.p = metric, q, p
        self.qq, pp = (q * q).sum(1), (p * p).sum(1)
        largest = self.qq.max() + pp.max()
        kind = np.float32 if largest < 1e30 else np.float64  # scores only choose whom to compare, so half the digits do
        self.slack = (1e-5 if kind is np.float32 else 1e-12) * (self.qq + (pp[np.isfinite(pp)].max() if np.isfinite(pp).any() else 0.0)) + 1e-30
        if metric == "euclidean":  # |p|^2 / 2 - q p, as one product
            self.scores = np.hstack((-q, np.ones((len(q), 1)))).astype(kind) @ np.hstack((p, pp[:, None] / 2)).astype(kind).T
        elif metric == "dot":
            self.scores = (-q).astype(kind) @ p.astype(kind).T
        else:
            if not (self.qq.all() and pp.all()):
                raise ValueError("the cosine of a zero vector isn't defined")
            c = q @ p.T / np.sqrt(self.qq)[:, None] / np.sqrt(pp)
            self.scores = 1 - np.abs(c) if metric == "abs_cosine" else 1 - c

    def limit(self, d: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Above the scores of all that the 9 rounded places of d can't tell from it."""
        if self.metric == "euclidean":
            return ((d + 2e-9) ** 2 - self.qq[rows]) / 2 + self.slack[rows]
        return d + 2e-9 + (self.slack[rows] if self.metric == "dot" else 0)

    def distance(self, score: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.qq[rows] + 2 * score, 0) + 2 * self.slack[rows]) if self.metric == "euclidean" else score + self.slack[rows] * (self.metric == "dot")

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.metric == "euclidean":  # differences, not expanded squares: equal vectors are at distance 0
            return np.sqrt(((self.q[i] - self.p[j]) ** 2).sum(1))
        return -(self.q[i] * self.p[j]).sum(1) if self.metric == "dot" else self.scores[i, j]


def _best(batches: Iterator[pa.RecordBatch], k: int, metric: str, own: bool) -> Iterator[pa.RecordBatch]:
    """The k best points of each query among the blocks that this task sees. A query's k-th distance so far bounds what is looked at in further blocks."""
    found: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for key, qi, qv, pi, pv in each_pair(batches):
        if key not in found:
            found[key] = qi.copy(), np.full((len(qi), k), np.iinfo(np.int64).max), np.full((len(qi), k), np.inf)
        _, ids, dist = found[key]
        m = _Metric(metric, qv, pv)
        hit = m.scores <= m.limit(np.round(dist[:, -1], 9))[:, None].astype(m.scores.dtype)
        rows = np.flatnonzero(np.count_nonzero(hit, 1) > 4 * (k + 1)) if np.count_nonzero(hit) > 4 * (k + 1) else []
        if len(rows) and (last := k + len(pi) - len(np.unique(pi))) < len(pi):
            bound = np.partition(m.scores[rows], last, axis=1)[:, last].astype(float)
            bound = m.limit(m.distance(bound, rows), rows).astype(m.scores.dtype)
            hit[rows] &= m.scores[rows] <= np.where(np.isnan(bound), np.inf, bound)[:, None]
        i, j = np.divmod(np.flatnonzero(hit), len(pi))
        if not own:
            fine = qi[i] != pi[j]
            i, j = i[fine], j[fine]
        for a in range(0, len(i), CHUNK):
            r, c = i[a : a + CHUNK], j[a : a + CHUNK]
            d = m.exact(r, c)
            at = np.unique(r)
            rr, ii, dd = np.concatenate((np.repeat(at, k), r)), np.concatenate((ids[at].ravel(), pi[c])), np.concatenate((dist[at].ravel(), np.where(np.isnan(d), np.inf, d)))
            order = np.lexsort((ii, np.round(dd, 9), rr))
            rr, ii, dd = rr[order], ii[order], dd[order]
            top = np.arange(len(rr)) - np.searchsorted(rr, rr) < k
            ids[at], dist[at] = ii[top].reshape(-1, k), dd[top].reshape(-1, k)
    for qi, ids, dist in found.values():
        fine = np.isfinite(dist)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, fine.sum(1))), pa.array(ids[fine]), pa.array(dist[fine])], ["q", "id", "dist"])


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", include_self: bool = False) -> DataFrame:
    """(q, id, dist, rank): the k nearest points of each query, ties to the smaller id; metric: euclidean, cosine, abs_cosine, or dot, whose distance is the product with its sign turned.

    points and queries have (id long, v array<double>) without nulls. Blocks of queries meet blocks of points, so a row that is joined is a block, and only k rows
    a query leave each task. Fewer than k points give fewer rows.
    """
    near = block_pairs(queries, points, k + 1).mapInArrow(lambda it: _best(it, k, metric, include_self) if k > 0 else iter(()), "q long, id long, dist double")
    w = Window.partitionBy("q").orderBy(F.round("dist", 9), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_edges(neighbors: DataFrame, mutual: bool = False) -> DataFrame:
    """(src < dst, dist) undirected edges of a kNN table; mutual keeps those that both ends have."""
    both_ways = neighbors.where("q <> id").groupBy(F.least("q", "id").alias("src"), F.greatest("q", "id").alias("dst")).agg(F.min("dist").alias("dist"), F.count(F.lit(1)).alias("n"))
    return (both_ways.where("n = 2") if mutual else both_ways).select("src", "dst", "dist")


def _draw(seed: int, tree: int, path: str, dim: int) -> tuple[np.ndarray, float]:
    """Unit direction and quantile of a node."""
    r = np.random.default_rng(int.from_bytes(md5(f"{seed}:{tree}:{path}".encode()).digest()[:8], "little"))
    v = r.standard_normal(dim)
    return v / np.linalg.norm(v), r.uniform(0.25, 0.75)


class RPForest:
    """Random-projection trees, built level by level: one projection and one quantile of each open node a level.

    A node splits on a unit direction drawn from (seed, tree, path) at a quantile between 1/4 and 3/4; rows at most the threshold go left. Nodes of at most
    ``leaf_size`` rows are leaves, and so are nodes that a split would leave whole. ``rules`` and ``leaves`` are tables.
    """

    def __init__(self, trees: int = 4, leaf_size: int = 50, max_depth: int = 20, seed: int = 0) -> None:
        self.trees, self.leaf_size, self.max_depth, self.seed = trees, leaf_size, max_depth, seed

    def _project(self, rows: DataFrame) -> DataFrame:
        seed = self.seed

        @F.pandas_udf("struct<proj double, beta double>")
        def project(tree, path, v):
            import pandas as pd

            drawn = {k: _draw(seed, *k, len(v.iloc[0])) for k in set(zip(tree, path))}
            return pd.DataFrame({"proj": [float(np.dot(drawn[k][0], x)) for k, x in zip(zip(tree, path), v)], "beta": [drawn[k][1] for k in zip(tree, path)]})

        return rows.withColumn("p", project("tree", "path", "v")).select("id", "v", "tree", "path", "p.proj", "p.beta")

    def fit(self, points: DataFrame) -> "RPForest":
        """points: (id long, v array<double>)."""
        spark = points.sparkSession
        rows = points.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree")).withColumn("path", F.lit(""))
        done, self.rules = [], spark.createDataFrame([], "tree int, path string, threshold double")
        for _ in range(self.max_depth):
            sizes = rows.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n"))
            tagged = rows.join(sizes, ["tree", "path"])
            done.append(tagged.where(F.col("n") <= self.leaf_size).select("id", "tree", "path"))
            if not (open_rows := tagged.where(F.col("n") > self.leaf_size).drop("n")).limit(1).count():
                rows = None
                break
            moved = save(self._project(open_rows), "projections")
            rules = moved.groupBy("tree", "path").agg(F.percentile_approx("proj", F.array(*[F.lit(i / 100) for i in range(25, 76)]), 20000).alias("qs"), F.first("beta").alias("beta"), F.max("proj").alias("top"), F.min("proj").alias("low"))
            at = F.element_at("qs", (F.round((F.col("beta") - 0.25) * 100) + 1).cast("int"))
            # of rows that share the greatest projection none goes left; a threshold there moves down to the next known value
            at = F.when(at < F.col("top"), at).otherwise(F.coalesce(F.array_max(F.filter("qs", lambda x: x < F.col("top"))), F.col("low")))
            rules = rules.select("tree", "path", at.alias("threshold"), "top").where("threshold < top").drop("top")
            rules = save(rules, "rules")
            self.rules = self.rules.unionByName(rules)
            routed = moved.join(rules, ["tree", "path"], "left")
            done.append(routed.where("threshold is null").select("id", "tree", "path"))  # all projections equal
            rows = routed.where("threshold is not null").select("id", "v", "tree", F.concat("path", F.when(F.col("proj") <= F.col("threshold"), "L").otherwise("R")).alias("path"))
        if rows is not None:
            done.append(rows.select("id", "tree", "path"))
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        self.leaves, self.points = save(out, "leaves"), points
        return self

    def route(self, queries: DataFrame) -> DataFrame:
        """(id, tree, path): the leaf of each query in each tree; a point that was fitted comes to its own leaf."""
        rows = queries.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree")).withColumn("path", F.lit(""))
        done: list[DataFrame] = []
        depth = self.rules.agg(F.max(F.length("path"))).first()[0]
        for _ in range(0 if depth is None else depth + 1):
            moved = self._project(rows).join(self.rules, ["tree", "path"], "left")
            went = save(moved.select("id", "v", "tree", F.concat("path", F.when(F.col("threshold").isNull(), "").when(F.col("proj") <= F.col("threshold"), "L").otherwise("R")).alias("path"), F.col("threshold").isNotNull().alias("open")), "route")
            done.append(went.where("not open").select("id", "tree", "path"))
            rows = went.where("open").drop("open")
        for d in done:
            rows = rows.select("id", "tree", "path").unionByName(d)
        return rows.select("id", "tree", "path")

    def write(self, path: str) -> None:
        """Stores the forest in a folder: its parameters, rules, leaves and points, each a table."""
        spark, root = self.points.sparkSession, path.rstrip("/")
        spark.createDataFrame([(self.trees, self.leaf_size, self.max_depth, self.seed)], "trees int, leaf_size int, max_depth int, seed long").coalesce(1).write.parquet(f"{root}/parameters")
        for name in ("rules", "leaves", "points"):
            getattr(self, name).write.parquet(f"{root}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> "RPForest":
        """A stored forest; it may have been moved, as the tables lie next to each other."""
        root = path.rstrip("/")
        out = cls(**spark.read.parquet(f"{root}/parameters").first().asDict())
        out.rules, out.leaves, out.points = (spark.read.parquet(f"{root}/{name}") for name in ("rules", "leaves", "points"))
        return out

    def leaf_sizes(self) -> DataFrame:
        """(tree, path, n) of all leaves."""
        return self.leaves.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n"))

    def knn(self, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
        """(q, id, dist, rank) among the points that share a leaf with the query in any tree; metric: euclidean, cosine or abs_cosine (null distances, of zero vectors, come last)."""
        there = self.leaves.withColumnRenamed("id", "p").join(self.route(queries).withColumnRenamed("id", "q"), ["tree", "path"]).select("q", "p").distinct()
        pairs = there.join(queries.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").join(self.points.select(F.col("id").alias("p"), F.col("v").alias("pv")), "p")
        total = lambda a, b, f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
        cosine = total("qv", "pv", lambda x, y: x * y) / F.nullif(F.sqrt(total("qv", "qv", lambda x, y: x * y) * total("pv", "pv", lambda x, y: x * y)), F.lit(0.0))
        known = {"euclidean": F.sqrt(total("qv", "pv", lambda x, y: (x - y) * (x - y))), "cosine": 1 - cosine, "abs_cosine": 1 - F.abs(cosine)}
        if metric not in known:
            raise ValueError(f"unknown metric {metric}")
        ranked = pairs.where("q <> p").select("q", F.col("p").alias("id"), known[metric].alias("dist"))
        return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.asc_nulls_last("dist"), "id"))).where(F.col("rank") <= k)


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def asked(df: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return df.where("id % 100 = 0")


_D = f"SELECT a.vec_id AS q, b.vec_id AS id, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM {DUCK.vec} a JOIN {DUCK.vec} b ON a.pos = b.pos WHERE a.vec_id <> b.vec_id GROUP BY 1, 2"
_TOP = "SELECT q, id, round(d, 6) AS dist, r AS rank FROM (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY round(d, 9), id))::INT AS r FROM ({d}) {where}) WHERE r <= {k}"


@CATALOG.query("knn_exact", _TOP.format(d=_D, where="WHERE q % 100 = 0", k=10))
def _knn_exact(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn(v, asked(v), 10).withColumn("dist", F.round("dist", 6))


@CATALOG.query("nn_linear_scan", _TOP.format(d=_D, where="WHERE q % 100 = 0", k=1))
def _nn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn(v, asked(v), 1).withColumn("dist", F.round("dist", 6))


_GRAPH = "SELECT least(q, id) AS src, greatest(q, id) AS dst, min(dist) AS dist FROM (" + _TOP.format(d=_D, where="", k=5) + ") GROUP BY 1, 2"


@CATALOG.query("knn_graph", _GRAPH)
def _knn_graph(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn_edges(knn(v, v, 5)).withColumn("dist", F.round("dist", 6))


@CATALOG.query("knn_graph_mutual", _GRAPH + " HAVING count(*) = 2")
def _knn_mutual(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn_edges(knn(v, v, 5), mutual=True).withColumn("dist", F.round("dist", 6))


_COS = f"SELECT a.vec_id AS q, b.vec_id AS id, 1 - {{abs}}(sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x))) AS d FROM {DUCK.vec} a JOIN {DUCK.vec} b ON a.pos = b.pos WHERE a.vec_id <> b.vec_id GROUP BY 1, 2"


@CATALOG.query("cosine_abs_distance", _TOP.format(d=_COS.format(abs="abs"), where="WHERE q % 100 = 0", k=5))
def _cos(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn(v, asked(v), 5, "abs_cosine").withColumn("dist", F.round("dist", 6))


@CATALOG.query("analogy_nn", f"""WITH t AS (SELECT b.vec_id AS q, b.pos, b.x - a.x + c.x AS x FROM {DUCK.vec} b JOIN {DUCK.vec} a ON a.vec_id = b.vec_id + 1 AND a.pos = b.pos JOIN {DUCK.vec} c ON c.vec_id = b.vec_id + 2 AND c.pos = b.pos WHERE b.vec_id % 100 = 0),
d AS (SELECT q, v.vec_id AS id, 1 - sum(t.x * v.x) / sqrt(sum(t.x * t.x)) / sqrt(sum(v.x * v.x)) AS d FROM t JOIN {DUCK.vec} v ON t.pos = v.pos WHERE v.vec_id NOT IN (q, q + 1, q + 2) GROUP BY 1, 2)
SELECT q, id, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), id) AS r FROM d) WHERE r = 1""")
def _analogy(spark, sf_dir):
    v = vectors(spark, sf_dir)
    at = lambda i: v.select((F.col("id") - i).alias("id"), F.col("v").alias(f"v{i}"))
    moved = F.zip_with(F.zip_with("v0", "v1", lambda b, a: b - a), "v2", lambda x, c: x + c)
    asked_for = asked(at(0)).join(at(1), "id").join(at(2), "id").select("id", moved.alias("v"))
    near = knn(v, asked_for, 4, "cosine").where("id not in (q, q + 1, q + 2)")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where("r = 1").select("q", "id", F.round("dist", 6).alias("dist"))


@CATALOG.query("rp_forest_knn")
def _rp_knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return RPForest(trees=4, leaf_size=60).fit(v).knn(asked(v), 5)


@CATALOG.query("rp_tree_levels")
def _rp_levels(spark, sf_dir):
    return RPForest(trees=1, leaf_size=60).fit(vectors(spark, sf_dir)).leaves


def even(spark, sf_dir) -> bool:
    """Whether the vectors can go in blocks: one length, no nulls, no repeated ids. Any other table takes the query's SQL, which joins places."""
    n, x = F.size("embedding"), F.coalesce(F.exists("embedding", lambda e: e.isNull()), F.lit(True))
    r = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)), F.countDistinct("vec_id"), F.min(n), F.max(n), F.bool_or(x)).first()
    return r[0] == r[1] > 0 and 0 < r[2] == r[3] and not r[4]


def in_blocks(name: str, sql):
    """Registers f(vectors) as a query for even tables, and sql(dialect) as its check and as the query for others."""

    def register(f):
        CATALOG.add(name, lambda spark, sf_dir: f(vectors(spark, sf_dir)) if even(spark, sf_dir) else run_sql(spark, sf_dir, sql(SPARK)), sql(DUCK))
        return f

    return register


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves go away from zero, as in SQL."""
    return np.where(np.abs(x) < 1e15, np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places, x), x) + 0.0


def pair_rows(qi: np.ndarray, pi: np.ndarray, x: np.ndarray, keep: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (id of the query, id of the point, x) of the pairs that keep marks, some OUT at a time."""
    step = max(1, OUT // max(1, len(pi)))
    for a in range(0, len(qi), step):
        i, j = np.nonzero(keep[a : a + step])
        yield pa.RecordBatch.from_arrays([pa.array(qi[a + i]), pa.array(pi[j]), pa.array(x[a + i, j])], names)


def _dot_sql(d):
    return f"SELECT a.vec_id AS a, b.vec_id AS b, round(sum(a.x * b.x), 6) AS dot FROM {d.vec} a JOIN {d.vec} b ON a.pos = b.pos GROUP BY a.vec_id, b.vec_id"


@in_blocks("dot_products", _dot_sql)
def _dot_products(v):
    def rows(batches):
        for _, qi, qv, pi, pv in each_pair(batches):
            yield from pair_rows(qi, pi, rounded(qv @ pv.T, 6), np.ones((len(qi), len(pi)), bool), ["a", "b", "dot"])

    return block_pairs(v, v).mapInArrow(rows, "a long, b long, dot double")


def _normal(d, key):
    return f"sqrt(-2 * ln(greatest({d.hu(f'''concat('a:', {key})''')}, 0.000000001))) * cos(2 * pi() * {d.hu(f'''concat('b:', {key})''')})"


@q("rp_directions")
def _(d):
    key = f"concat(CAST(t.i AS {d.text}), ':', CAST(p.i AS {d.text}))"
    return f"WITH n AS (SELECT t.i AS tree, p.i AS pos, {_normal(d, key)} AS g FROM {d.seq(8)} t CROSS JOIN {d.seq(64)} p) SELECT CAST(tree AS BIGINT) AS tree, CAST(pos AS BIGINT) AS pos, round(g / sqrt(sum(g * g) OVER (PARTITION BY tree)), 8) AS x FROM n"


@q("rp_projections")
def _(d):
    key = f"concat(CAST(t.i AS {d.text}), ':', CAST(p.i AS {d.text}))"
    return f"WITH n AS (SELECT t.i AS node, p.i AS pos, {_normal(d, key)} AS g FROM {d.seq(7)} t CROSS JOIN {d.seq(64)} p) SELECT vec_id, CAST(node AS BIGINT) AS node, round(sum(x * g), 5) AS proj FROM {d.vec} v JOIN n ON v.pos = n.pos GROUP BY vec_id, node"


@q("rp_rule")
def _(d):
    key = f"concat('0:', CAST(p.i AS {d.text}))"
    return f"""WITH n AS (SELECT p.i AS pos, {_normal(d, key)} AS g FROM {d.seq(64)} p), s AS (SELECT vec_id, round(sum(x * g), 9) AS proj FROM {d.vec} v JOIN n ON v.pos = n.pos GROUP BY vec_id),
    t AS (SELECT {d.lower_quantile('proj', 0.375)} AS threshold FROM s) SELECT vec_id, CASE WHEN proj <= threshold THEN 'L' ELSE 'R' END AS side FROM s CROSS JOIN t"""


@q("gen_nn_data")
def _(d):
    far = f"CAST(floor({d.hu(f'''concat('f:', CAST(r.i AS {d.text}))''')} * 10) AS BIGINT)"
    return f"SELECT CAST(r.i AS BIGINT) AS row_id, CAST(p.i AS BIGINT) AS pos, CASE WHEN r.i = 0 THEN CAST(1 AS DOUBLE) WHEN p.i = {far} THEN sqrt(CAST(10 AS DOUBLE)) + 1 ELSE CAST(0 AS DOUBLE) END AS x FROM {d.seq(500)} r CROSS JOIN {d.seq(10)} p"


def _rbf_sql(d):
    # edges of all pairs of rows; sigma is the lower median of the positive distances times sqrt(1 / (2 ln(1 / 0.8)))
    return f"""WITH e AS (SELECT a.vec_id AS q, b.vec_id AS id, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 9) AS d FROM {d.vec} a JOIN {d.vec} b ON a.pos = b.pos WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
    s AS (SELECT coalesce({d.lower_quantile('CASE WHEN d > 0 THEN d END', 0.5)} * sqrt(1 / (2 * ln(1 / CAST(0.8 AS DOUBLE)))), 1.0) AS s FROM e) SELECT q, id, round(exp(-d * d / (2 * s * s)), 6) AS w FROM e CROSS JOIN s"""


def _all_distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of two blocks to 9 places; those of near pairs by differences, as the expanded square has too few digits there."""
    qq, pp = (q * q).sum(1), (p * p).sum(1)
    d = qq[:, None] + pp - 2 * (q @ p.T)
    i, j = np.nonzero(~(d > 1e-3 * (qq[:, None] + pp)))
    for a in range(0, len(i), CHUNK):
        r, c = i[a : a + CHUNK], j[a : a + CHUNK]
        d[r, c] = ((q[r] - p[c]) ** 2).sum(1)
    return rounded(np.sqrt(d), 9)


def median_distance(pairs: DataFrame) -> float | None:
    """Lower median of the positive distances, to 9 places, of different ids in block_pairs; None if there are none.

    A radix search: positive numbers are in the order of their bits, so three passes over the pairs count 2^20 values of 24, 20 and 20 bits in turn; no distance is kept. At most 2^20 counts come to the driver.
    """
    known, rank = 0, None
    for shift in (40, 20, 0):

        def count(batches, known=known, shift=shift):
            sums: dict[int, np.ndarray] = {}
            for _, qi, qv, pi, pv in each_pair(batches):
                d = _all_distances(qv, pv)
                key = d[(d > 0) & (qi[:, None] != pi)].view(np.int64) >> shift
                if shift < 40:
                    key = key[key >> 20 == known]
                for part in np.unique(key >> 12):  # the few exponents, or parts of the known range, that there are
                    own = np.bincount(key[key >> 12 == part] & 4095, minlength=4096)
                    sums[int(part)] = sums.get(int(part), 0) + own
            for part, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array((part << 12) + at), pa.array(n[at])], ["key", "n"])

        found = sorted((r["key"], r["n"]) for r in pairs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect())
        if not found:
            return None
        rank = -(-sum(n for _, n in found) // 2) if rank is None else rank
        for known, n in found:
            if rank <= n:
                break
            rank -= n
    return float(np.array([known], np.int64).view(float)[0])


@in_blocks("rbf_similarity", _rbf_sql)
def _rbf_similarity(v):
    pairs = block_pairs(v, v)
    middle = median_distance(pairs)
    s = 1.0 if middle is None else middle * float(np.sqrt(1 / (2 * np.log(1 / 0.8))))

    def rows(batches):
        for _, qi, qv, pi, pv in each_pair(batches):
            d = _all_distances(qv, pv)
            yield from pair_rows(qi, pi, rounded(np.exp(-d * d / (2 * s * s)), 6), qi[:, None] != pi, ["q", "id", "w"])

    return pairs.mapInArrow(rows, "q long, id long, w double")


@CATALOG.query("rp_rules_tree")
def _rp_rules(spark, sf_dir):
    """Rules of one tree with heap numbers: the root is 1, children of i are 2 i and 2 i + 1."""
    rules = RPForest(trees=1, leaf_size=60).fit(vectors(spark, sf_dir)).rules
    number = F.aggregate(F.split("path", ""), F.lit(1).cast("long"), lambda i, c: F.when(c == "", i).otherwise(i * 2 + (c == "R").cast("long")))
    return rules.select(number.alias("node"), "path", F.round("threshold", 6).alias("threshold"))


@CATALOG.query("rp_forest")
def _rp_forest(spark, sf_dir):
    return RPForest(trees=3, leaf_size=60).fit(vectors(spark, sf_dir)).leaves.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query("rp_route")
def _rp_route(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return RPForest(trees=2, leaf_size=60).fit(v).route(asked(v))


@CATALOG.query("rp_repopulate")
def _rp_repopulate(spark, sf_dir):
    """New rows (here the vectors moved by 0.01) go through stored rules."""
    v = vectors(spark, sf_dir)
    return RPForest(trees=1, leaf_size=60).fit(v).route(v.withColumn("v", F.transform("v", lambda x: x + 0.01)))


def _similar_sql(d):
    # the 3 most similar rows of each row, by either end
    return f"""WITH s AS (SELECT a.vec_id AS i, b.vec_id AS j, round(sum(a.x * b.x), 9) AS s FROM {d.vec} a JOIN {d.vec} b ON a.pos = b.pos WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
    k AS (SELECT i, j, s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM s) x WHERE r <= 3) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, round(s, 6) AS s FROM k"""


@in_blocks("knn_similarity", _similar_sql)
def _knn_similarity(v):
    return knn(v, v, 3, "dot").select(F.least("q", "id").alias("i"), F.greatest("q", "id").alias("j"), F.round(F.round(-F.col("dist"), 9), 6).alias("s")).distinct()

"""Binary and many-way trees as path tables, their evaluation, and spectral clustering from the top down.

A tree is a table of leaves (id, path): 'L' and 'R' from the root. Ancestors are prefixes of a path, so roll-ups are explodes and groups.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.operators.neighbors import knn, knn_edges, vectors
from spindrel.plans.catalog import Catalog
from spindrel.plans.dialects import both, run_sql
from spindrel.plans.scratch import save

CATALOG = Catalog()


def q(name):
    return both(CATALOG, name)


def prefixes(path: Column) -> Column:
    """All prefixes of a path, the empty one first."""
    return F.transform(F.sequence(F.lit(0), F.length(path)), lambda i: F.substring(path, F.lit(1), i))


def rollup(leaves: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """Counts of ``by`` at every node, from its leaves up."""
    return leaves.select(F.explode(prefixes(F.col(path))).alias("node"), *by).groupBy("node", *by).agg(F.count(F.lit(1)).alias("n"))


def gini(counts: DataFrame) -> DataFrame:
    """(node, size, gini) from (node, label, n): the chance that two draws from a node differ in label."""
    return counts.groupBy("node").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("sq")).select("node", "size", (1 - F.col("sq") / (F.col("size") * F.col("size"))).alias("gini"))


def prune(leaves: DataFrame, depth: int) -> DataFrame:
    """Leaves with every node at depth made a leaf."""
    return leaves.withColumn("path", F.substring("path", 1, depth))


def map_leaves(leaves: DataFrame, **columns: Column) -> DataFrame:
    """The leaves with data columns set to functions of what a leaf holds; id and path stay as they are."""
    if {"id", "path"} & set(columns):
        raise ValueError("id and path make the tree")
    return leaves.withColumns(columns)


def reduce_leaves(leaves: DataFrame, path: str = "path", **combine: Column) -> DataFrame:
    """(node, ...) with an aggregate of the leaves below every node, itself included; ``combine`` names aggregates, e.g. total=F.sum("x"). The root is ''."""
    return leaves.withColumn("node", F.explode(prefixes(F.col(path)))).groupBy("node").agg(*[c.alias(name) for name, c in combine.items()])


def replace_leaves(leaves: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, path) where the leaves that ``parts`` (id, below) names are replaced by the trees below them; ids that parts doesn't have keep their leaf.

    A leaf of which only some ids are replaced would be a leaf and an inner node at once, so that is an error; so is a part whose id is in no leaf.
    """
    both = leaves.select("id", "path").join(parts.select("id", "below"), "id", "full")
    checked = both.groupBy("path").agg((F.count("below") % F.count(F.lit(1)) != 0).alias("torn"), F.max(F.length("below")).alias("deep"))
    if checked.where("path is null or (torn and deep > 0)").limit(1).count():
        raise ValueError("parts must replace whole leaves of the tree")
    return both.select("id", F.concat("path", F.coalesce("below", F.lit(""))).alias("path"))


def same_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, path_a, path_b) of ids whose leaf differs; empty for equal trees."""
    both = a.select("id", F.col("path").alias("path_a")).join(b.select("id", F.col("path").alias("path_b")), "id", "full")
    return both.where(~F.col("path_a").eqNullSafe(F.col("path_b")))


def pretty(leaves: DataFrame, most: int = 1000) -> str:
    """A tree as text: a line for each node with its number of rows, two blanks a level. A tree of more than ``most`` nodes is an error, as it isn't for reading."""
    nodes = rollup(leaves, []).orderBy("node").limit(most + 1).collect()
    if len(nodes) > most:
        raise ValueError(f"the tree has more than {most} nodes")
    return "\n".join(f"{'  ' * len(r['node'])}{r['node'][-1:] or 'root'} ({r['n']})" for r in nodes)


def integrity(nodes: DataFrame) -> DataFrame:
    """(path, fault) of a node table: a leaf below a leaf, or an inner node with one side only."""
    inner = nodes.select(F.explode(prefixes(F.col("path"))).alias("a"), "path").where("a <> path")
    below = inner.join(nodes.select(F.col("path").alias("a")), "a", "left_semi").select("path", F.lit("below a leaf").alias("fault"))
    sides = inner.select("a", F.substring("path", F.length("a") + 1, F.lit(1)).alias("side")).distinct().groupBy("a").count().where("count = 1").select(F.col("a").alias("path"), F.lit("one side").alias("fault"))
    return below.unionByName(sides)


def _fiedler(w: np.ndarray) -> np.ndarray:
    """Second eigenvector of the Laplacian, its sign fixed: the largest entry is not smaller than the smallest one's size.

    The constant vector is moved above all other eigenvalues, so that what comes first has mean 0 even where weights are tiny.
    """
    degree = w.sum(1)
    lap = np.diag(degree) - w + (2 * degree.max() + 1) / len(w)
    v = np.linalg.eigh(lap)[1][:, 0]
    return v if v.max() > -v.min() or (np.isclose(v.max(), -v.min()) and v[0] >= 0) else -v


def _components(w: np.ndarray) -> np.ndarray:
    label = np.arange(len(w))
    while True:
        new = np.minimum(label, np.where(w > 0, label, len(w)).min(1))
        if (new == label).all():
            return label
        label = new


def _halves(w: np.ndarray) -> np.ndarray:
    """0 or 1 for each row: by components if there are several (largest first, each to the smaller side), else by the Fiedler vector's sign."""
    label = _components(w)
    kinds, counts = np.unique(label, return_counts=True)
    side = np.zeros(len(w), int)
    if len(kinds) > 1:
        sizes = [0, 0]
        for k in kinds[np.lexsort((kinds, -counts))]:
            s = int(sizes[1] < sizes[0])
            side[label == k] = s
            sizes[s] += int((label == k).sum())
        return side
    if len(w) == 2:
        return np.array([0, 1])
    side = (_fiedler(w) >= 0).astype(int)
    if side.min() == side.max():
        raise ValueError("the Fiedler vector of a connected node has one sign only")
    return side


def _sides(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(size, first, m) for a node's components, given (size, how many): from the largest size down each goes to the smaller side, 0 if they are equal.

    Of the components of one size the first m go to side ``first`` and the rest alternate, the other side before it; so only the numbers of each size are needed, not the components.
    """
    out, lead = [], 0
    for size, many in sorted(sizes, reverse=True):
        first = int(lead > 0)
        m = min(many, -(-lead // size) if first else -lead // size + 1)
        other = (many - m + 1) // 2
        lead += size * ((m + many - m - other - other) * (-1 if first else 1))
        out.append((size, first, m))
    return out


class HierClust:
    """Spectral clustering from the top down: kNN graph, RBF similarity, Fiedler bisection, again on both halves.

    ``n_neighbors`` counts the point itself; sigma 'auto' is the lower median of the node's positive distances scaled so that this distance has similarity ``alpha``. Every node goes by
    the same rule: with several components each goes to the smaller side, the largest first; one component is cut by the signs of its Fiedler vector. Nodes of up to ``dense`` rows are
    finished in one grouped pass; larger ones, all of a level together, find components by joins and the vector by Lanczos steps, until the residual is below ``tol`` of the spectrum's bound.
    Their median of distances is approximate (1 in 10,000 ranks). A node still above ``dense`` after ``max_depth`` levels is an error.
    """

    def __init__(self, n_neighbors: int = 20, mutual: bool = False, sigma: float | str = "auto", alpha: float = 0.8, leaf_size: int = 1, dense: int = 2000, max_depth: int = 200, tol: float = 1e-6) -> None:
        self.n_neighbors, self.mutual, self.sigma, self.alpha, self.leaf_size, self.dense, self.max_depth, self.tol = n_neighbors, mutual, sigma, alpha, leaf_size, dense, max_depth, tol

    def fit(self, points: DataFrame) -> DataFrame:
        """(id, path) of the leaf of each point; points: (id long, v array<double>)."""
        edges = save(knn_edges(knn(points, points, self.n_neighbors - 1), self.mutual), "knn-edges")
        rows, done = points.select("id").withColumn("path", F.lit("")), []
        for depth in range(self.max_depth + 1):
            sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
            tagged = save(rows.join(sizes, "path"), "nodes")
            done.append(tagged.where(F.col("n") <= self.dense).select("id", "path"))
            rows = tagged.where(F.col("n") > self.dense).select("id", "path")
            if not rows.limit(1).count():
                break
            if depth == self.max_depth:
                raise ValueError(f"a node has more than {self.dense} rows after {depth} levels")
            rows = self._split_large(rows, edges)
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return self._finish(save(out, "nodes"), edges)

    def _split_large(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """(id, path) one level down, of all rows."""
        inside = edges.join(rows.select(F.col("id").alias("src"), "path"), "src").join(rows.select(F.col("id").alias("dst"), F.col("path").alias("p2")), "dst").where("path = p2")
        if self.sigma == "auto":
            scale = inside.groupBy("path").agg(F.expr("percentile_approx(case when dist > 0 then dist end, 0.5)").alias("m")).select("path", (F.coalesce("m", F.lit(1.0)) * float(np.sqrt(1 / (2 * np.log(1 / self.alpha))))).alias("s"))
        else:
            scale = rows.select("path").distinct().withColumn("s", F.lit(float(self.sigma)))
        w = inside.join(scale, "path").select("src", "dst", "path", F.exp(-F.col("dist") * F.col("dist") / (2 * F.col("s") * F.col("s"))).alias("w")).where("w > 0 and src <> dst")
        w = save(w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "path", "w")), "weights")
        comp = components(w.where("src < dst").select(F.col("src").alias("x"), F.col("dst").alias("y")), rows.select(F.col("id").alias("node")))
        comp = save(rows.join(comp, F.col("id") == F.col("node")).select("id", "path", "comp"), "parts")
        sizes = save(comp.groupBy("path", "comp").agg(F.count(F.lit(1)).alias("size")), "part-sizes")
        kinds = sizes.groupBy("path", "size").agg(F.count(F.lit(1)).alias("many"))

        def place(df):
            import pandas as pd

            return pd.DataFrame([(df["path"].iloc[0], *x) for x in _sides([(int(a), int(b)) for a, b in zip(df["size"], df["many"])])], columns=["path", "size", "first", "m"])

        several = sizes.groupBy("path").agg((F.count(F.lit(1)) > 1).alias("several"))
        rank = F.row_number().over(Window.partitionBy("path", "size").orderBy("comp")) - 1
        sided = sizes.withColumn("r", rank).join(kinds.groupBy("path").applyInPandas(place, "path string, size long, first int, m long"), ["path", "size"])
        sided = sided.join(several, "path").where("several").select("comp", F.expr("case when r < m or (r - m) % 2 = 1 then first else 1 - first end").alias("side"))
        by_parts = comp.join(sided, "comp").select("id", F.concat("path", F.when(F.col("side") == 0, "L").otherwise("R")).alias("path"))
        whole = save(comp.join(several.where("not several"), "path").select("id", "path"), "connected")
        out = by_parts
        if whole.limit(1).count():
            x = self._second_vector(whole, w.join(several.where("not several"), "path").select("src", "dst", "w"))
            ends = x.groupBy("path").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("not (a < 0 and b >= 0)")
            if ends.limit(1).count():
                raise ValueError("the Fiedler vector of a connected node has one sign only")
            out = out.unionByName(x.select("id", F.concat("path", F.when(F.col("x") >= 0, "R").otherwise("L")).alias("path")))
        return save(out, "halves")

    def _second_vector(self, rows: DataFrame, w: DataFrame, steps: int = 12, restarts: int = 40) -> DataFrame:
        """(id, path, x): the Fiedler vector of every connected node, by Lanczos steps from a start hashed from the id, begun again from the best vector of their span.

        A step is one join over the edges and one grouped sum of at most ``steps`` numbers a node. It stops when all residuals are below tol * twice the greatest degree.
        """
        n = F.col("n")
        degree = w.groupBy("src").agg(F.sum("w").alias("deg"))
        base = rows.join(degree, F.col("id") == F.col("src")).select("id", "path", "deg")
        bound = save(base.groupBy("path").agg((2 * F.max("deg")).alias("most"), F.count(F.lit(1)).alias("n")), "bounds")
        state = base.withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5)

        def unit(df: DataFrame) -> DataFrame:
            """x with mean 0 and length 1 in each node; 0 where only rounding is left, as the span holds all that the start reaches."""
            sums = df.groupBy("path").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")).join(bound, "path")
            length = F.sqrt(F.col("var") * n)
            return df.join(sums, "path").withColumn("x", F.when(length > 1e-11 * F.least(F.col("most"), F.lit(1.0)), (F.col("x") - F.col("mean")) / length).otherwise(0.0)).drop("mean", "var", "most", "n")

        def ritz(df):
            import pandas as pd

            t, b = [], []
            for row in df.itertuples():
                h, there = np.array([list(r) for r in row.h], float), np.flatnonzero(np.array(row.g) > 0.5)
                own = h[np.ix_(there, there)]
                vals, vecs = np.linalg.eigh((own + own.T) / 2)
                mixed = np.zeros(len(h))
                mixed[there] = vecs[:, 0]
                t.append(mixed.tolist())
                b.append(float(vals[0]))
            return pd.DataFrame({"path": df["path"], "t": t, "theta": b})

        for _ in range(restarts):
            now = save(unit(state).select("id", "path", "deg", F.array("x").alias("v"), F.array().cast("array<double>").alias("lv")), "lanczos")
            for j in range(steps):
                last = now.select(F.col("id").alias("dst"), F.element_at("v", -1).alias("y"))
                pull = w.join(last, "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("y")).alias("pull"))
                got = now.join(pull, F.col("id") == F.col("src")).select("id", "path", "deg", "v", "lv", (F.col("deg") * F.element_at("v", -1) - F.col("pull")).alias("z"))
                got = save(got.select("id", "path", "deg", "v", F.array_append("lv", F.col("z")).alias("lv"), F.col("z").alias("x")), "lanczos")
                if j + 1 == steps:
                    now = got
                    break
                for _ in range(2):  # twice, as rounding leaves some of the earlier vectors
                    dots = got.groupBy("path").agg(F.array(*[F.sum(F.col("v")[i] * F.col("x")) for i in range(j + 1)]).alias("c"))
                    taken = F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
                    got = got.join(dots, "path").withColumn("x", F.col("x") - taken).drop("c")
                now = save(unit(got).select("id", "path", "deg", F.array_append("v", F.col("x")).alias("v"), "lv"), "lanczos")
            h = now.groupBy("path").agg(F.array(*[F.array(*[F.sum(F.col("v")[a] * F.col("lv")[b]) for b in range(steps)]) for a in range(steps)]).alias("h"), F.array(*[F.sum(F.col("v")[a] * F.col("v")[a]) for a in range(steps)]).alias("g"))
            best = save(h.mapInPandas(lambda it: (ritz(df) for df in it), "path string, t array<double>, theta double"), "ritz")
            mix = lambda c: F.aggregate(F.zip_with(c, "t", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            state = save(now.join(best, "path").select("id", "path", "deg", mix("v").alias("x"), (mix("lv") - F.col("theta") * mix("v")).alias("off")), "fiedler")
            left = state.groupBy("path").agg(F.sqrt(F.sum(F.col("off") * F.col("off")) / F.sum(F.col("x") * F.col("x"))).alias("residual")).join(bound, "path").where(F.col("residual") > self.tol * F.col("most"))
            state = state.drop("off")
            if not left.limit(1).count():
                break
        else:
            logging.getLogger(__name__).warning("some Fiedler vectors have a residual above %g of the bound after %d restarts", self.tol, restarts)
        return state.select("id", "path", "x")

    def _finish(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        alpha, sigma, leaf = self.alpha, self.sigma, self.leaf_size

        def split(ids: np.ndarray, d: np.ndarray) -> list[str]:
            out = [""] * len(ids)
            stack = [(np.arange(len(ids)), "")]
            while stack:
                at, path = stack.pop()
                if len(at) <= leaf:
                    for i in at:
                        out[i] = path
                    continue
                own = d[np.ix_(at, at)]
                known = np.sort(own[np.isfinite(own) & (own > 0)])
                s = sigma if sigma != "auto" else (known[(len(known) - 1) // 2] if len(known) else 1.0) * np.sqrt(1 / (2 * np.log(1 / alpha)))
                side = _halves(np.where(np.isfinite(own), np.exp(-(own**2) / (2 * s * s)), 0) * (1 - np.eye(len(at))))
                stack += [(at[side == 0], path + "L"), (at[side == 1], path + "R")]
            return out

        def node(key, left, right):
            import pandas as pd

            ids = np.sort(left["id"].to_numpy())
            d = np.full((len(ids), len(ids)), np.inf)
            a, b = np.searchsorted(ids, right["src"]), np.searchsorted(ids, right["dst"])
            d[a, b] = d[b, a] = right["dist"]
            return pd.DataFrame({"id": ids, "path": [key[0] + p for p in split(ids, d)]})

        inside = edges.join(rows.select(F.col("id").alias("src"), "path"), "src").join(rows.select(F.col("id").alias("dst"), F.col("path").alias("p2")), "dst").where("path = p2").select("src", "dst", "dist", F.concat("path", F.lit("")).alias("node"))
        return rows.groupBy("path").cogroup(inside.groupBy("node")).applyInPandas(node, "id long, path string")


@CATALOG.query("tree_assignments")
def _assignments(spark, sf_dir):
    return HierClust(n_neighbors=10, leaf_size=10).fit(vectors(spark, sf_dir)).orderBy("id")


def _path(d, bits: int = 5) -> str:
    """A tree over vectors: the path is the first bits of a hash."""
    h = f"md5(CAST(vec_id AS {d.text}))"
    return "concat(" + ", ".join(f"CASE WHEN substr({h}, {i + 1}, 1) < '8' THEN 'L' ELSE 'R' END" for i in range(bits)) + ")"


def _nodes(d) -> str:
    return f"(SELECT vec_id, label, substr(path, 1, CAST(i AS INT)) AS node, path FROM (SELECT vec_id, label, {_path(d)} AS path FROM embeddings) l CROSS JOIN {d.seq(6)} s)"


@q("tree_stats")
def _(d):
    return f"SELECT CAST(max(length(path)) AS BIGINT) AS depth, count(DISTINCT path) AS leaves FROM (SELECT {_path(d)} AS path FROM embeddings) l"


@q("tree_prune")
def _(d):
    return f"SELECT DISTINCT substr(path, 1, 2) AS path FROM (SELECT {_path(d)} AS path FROM embeddings) l"


@q("tree_subtree")
def _(d):
    return f"SELECT vec_id, substr(path, 3) AS path FROM (SELECT vec_id, {_path(d)} AS path FROM embeddings) l WHERE {d.starts('path', 'upper(' + chr(39) + 'lr' + chr(39) + ')')}"


@q("tree_reduce")
def _(d):
    return f"SELECT node, count(*) AS size, CAST(sum(vec_id) AS BIGINT) AS total, min(vec_id) AS least FROM {_nodes(d)} n GROUP BY node"


@q("tree_reconstruct")
def _(d):
    return f"SELECT node, CAST(max(CASE WHEN node = path THEN 1 ELSE 0 END) AS INT) AS leaf FROM {_nodes(d)} n GROUP BY node"


@q("tree_integrity")
def _(d):
    return f"SELECT node, count(DISTINCT substr(path, CAST(length(node) + 1 AS INT), 1)) AS sides FROM {_nodes(d)} n WHERE node <> path GROUP BY node HAVING count(DISTINCT substr(path, CAST(length(node) + 1 AS INT), 1)) < 3"


@q("gini_rollup")
def _(d):
    return f"WITH c AS (SELECT node, label, count(*) AS n FROM {_nodes(d)} x GROUP BY node, label) SELECT node, CAST(sum(n) AS BIGINT) AS size, round(1 - sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE), 6) AS gini FROM c GROUP BY node"


@q("gini_by_leaf")
def _(d):
    return f"WITH c AS (SELECT node, label, count(*) AS n FROM {_nodes(d)} x WHERE node = path GROUP BY node, label) SELECT node, round(1 - sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE), 6) AS gini FROM c GROUP BY node"


@q("gini_by_depth")
def _(d):
    return f"WITH c AS (SELECT node, label, count(*) AS n FROM {_nodes(d)} x GROUP BY node, label), g AS (SELECT node, CAST(sum(n) AS DOUBLE) AS size, 1 - sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS gini FROM c GROUP BY node) SELECT CAST(length(node) AS BIGINT) AS depth, round(sum(size * gini) / sum(size), 6) AS gini FROM g GROUP BY length(node)"


@q("avg_gini")
def _(d):
    return f"WITH c AS (SELECT node, label, count(*) AS n FROM {_nodes(d)} x WHERE node = path GROUP BY node, label), g AS (SELECT node, CAST(sum(n) AS DOUBLE) AS size, 1 - sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS gini FROM c GROUP BY node) SELECT round(sum(size * gini) / sum(size), 6) AS gini FROM g"


@q("peel_impurity")
def _(d):
    # leaves leave the root one by one, in path order: impurity of what is left behind each
    return f"""WITH c AS (SELECT node, label, count(*) AS n FROM {_nodes(d)} x WHERE node = path GROUP BY node, label), k AS (SELECT p.node, l.label, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT node FROM c) p CROSS JOIN (SELECT DISTINCT label FROM c) l LEFT JOIN c ON c.node = p.node AND c.label = l.label),
    r AS (SELECT node, sum(n) OVER (PARTITION BY label ORDER BY node DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM k) SELECT node, round(1 - sum(m * m) / CAST(sum(m) * sum(m) AS DOUBLE), 6) AS gini FROM r GROUP BY node"""


@q("split_ratios")
def _(d):
    return f"WITH c AS (SELECT node, count(*) AS n FROM {_nodes(d)} x GROUP BY node) SELECT a.node, round(a.n / CAST(b.n AS DOUBLE), 6) AS ratio FROM c a JOIN c b ON b.node = substr(a.node, 1, CAST(length(a.node) - 1 AS INT)) WHERE a.node <> ''"


@q("tree_linkage")
def _(d):
    # inner nodes after leaves, deepest first: place, size and height above the leaves
    return f"WITH c AS (SELECT node, count(*) AS n FROM {_nodes(d)} x GROUP BY node) SELECT node, CAST(row_number() OVER (ORDER BY length(node) DESC, node) - 1 AS BIGINT) AS number, n AS size, CAST(5 - length(node) AS BIGINT) AS height FROM c"


@q("random_tree")
def _(d):
    r = f"row_number() OVER (ORDER BY md5(CAST(vec_id AS {d.text})), vec_id) - 1"
    return f"SELECT vec_id, concat(CASE WHEN r * 2 < n THEN 'L' ELSE 'R' END, CASE WHEN (r * 4) % (2 * n) < n THEN 'L' ELSE 'R' END) AS path FROM (SELECT vec_id, {r} AS r, count(*) OVER () AS n FROM embeddings) x"


@q("prefix_join")
def _(d):
    leaves = "(SELECT DISTINCT concat('/', CAST(r_regionkey AS {t}), '/', CAST(n_nationkey AS {t})) AS leaf FROM region JOIN nation ON r_regionkey = n_regionkey)".replace("{t}", d.text)
    nodes = f"(SELECT '' AS node UNION ALL SELECT concat('/', CAST(r_regionkey AS {d.text})) FROM region UNION ALL SELECT leaf FROM {leaves} a)"
    return f"SELECT node, leaf FROM {leaves} l JOIN {nodes} n ON {d.starts('leaf', 'node')} AND (length(node) = length(leaf) OR substr(leaf, CAST(length(node) + 1 AS INT), 1) = '/')"


@q("make_tree")
def _(d):
    return f"""WITH RECURSIVE t(path, depth) AS (SELECT CAST('' AS {d.text}), 0 UNION ALL SELECT concat(path, '/', CAST(i AS {d.text})), depth + 1 FROM t JOIN {d.seq(3)} s ON i < CASE depth WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END) SELECT path, CAST(depth AS INT) AS depth FROM t"""


@q("tree_paths")
def _(d):
    return f"SELECT node, CAST(length(node) AS BIGINT) AS depth FROM (SELECT DISTINCT node FROM {_nodes(d)} x) y ORDER BY node"


@q("dag_paths")
def _(d):
    e = d.values("p, c", "(0, 1), (0, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5)")
    return f"WITH RECURSIVE t(node, path) AS (SELECT 0, CAST('0' AS {d.text}) UNION ALL SELECT e.c, concat(path, '/', CAST(e.c AS {d.text})) FROM t JOIN {e} AS e ON t.node = e.p) SELECT node, path FROM t"


@q("tree_relation")
def _(d):
    n = d.values("a", "('LL'), ('LR'), ('L'), ('RL'), ('RR'), ('R'), ('LLL'), ('LRL')")
    up = "substr({x}, 1, CAST(length({x}) - 1 AS INT))"
    pa, pb = up.format(x="m.a"), up.format(x="n.a")
    return f"""SELECT m.a AS a, n.a AS b, CASE WHEN m.a = n.a THEN 'self' WHEN {pb} = m.a THEN 'parent' WHEN {pa} = n.a THEN 'child' WHEN {d.starts('n.a', 'm.a')} THEN 'ancestor' WHEN {d.starts('m.a', 'n.a')} THEN 'descendant'
      WHEN {pa} = {pb} THEN 'sibling' WHEN {up.format(x=pb)} = {pa} AND length(n.a) = length(m.a) + 1 THEN 'aunt' WHEN length(m.a) = length(n.a) THEN 'cousin' ELSE 'other' END AS relation FROM {n} AS m CROSS JOIN {n} AS n"""


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable by edges (x, y). Labels go to neighbours and to their labels' labels until none changes; each round is written."""
    links = save(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "links")
    label = save(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        near = links.join(label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        new = label.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("mid"))
        jump = new.join(new.select(F.col("node").alias("mid"), F.col("mid").alias("far")), "mid").select("node", "old", F.least("mid", "far").alias("comp"))
        jump = save(jump, "labels")
        label = jump.select("node", "comp")
        if not jump.where("old <> comp").limit(1).count():
            return label


_LINKS = "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 7 WHERE md5(CAST(a.s_suppkey AS VARCHAR)) < 'a'"
_WALK = f"WITH RECURSIVE e AS (SELECT x, y FROM ({_LINKS}) UNION ALL SELECT y, x FROM ({_LINKS})), w(a, b) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT w.a, e.y FROM w JOIN e ON w.b = e.x)"


def _supplier_components(spark, sf_dir):
    links = run_sql(spark, sf_dir, _LINKS.replace("VARCHAR", "STRING"))
    return components(links, run_sql(spark, sf_dir, "SELECT s_suppkey AS node FROM supplier"))


@CATALOG.query("connected_components", _WALK + " SELECT a AS node, min(b) AS comp FROM w GROUP BY a")
def _connected(spark, sf_dir):
    return _supplier_components(spark, sf_dir)


@CATALOG.query("component_sizes", _WALK + " SELECT comp, count(*) AS n FROM (SELECT a AS node, min(b) AS comp FROM w GROUP BY a) GROUP BY comp")
def _sizes(spark, sf_dir):
    return _supplier_components(spark, sf_dir).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


def _graph(d) -> str:
    """A weighted graph on nations, each edge in both directions."""
    e = f"(SELECT n_nationkey AS i, (n_nationkey + k.i) % 25 AS j, CAST(1 + (n_nationkey * k.i) % 3 AS DOUBLE) AS w FROM nation CROSS JOIN {d.seq(3, 1)} k)"
    return f"(SELECT i, j, w FROM {e} a UNION ALL SELECT j, i, w FROM {e} b)"


@q("laplacian")
def _(d):
    return f"SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS j, sum(w) AS v FROM {_graph(d)} x GROUP BY i UNION ALL SELECT CAST(i AS BIGINT), CAST(j AS BIGINT), -sum(w) FROM {_graph(d)} y GROUP BY i, j"


@q("fiedler_matvec")
def _(d):
    return f"SELECT CAST(i AS BIGINT) AS i, round(sum(w * (cos(CAST(i AS DOUBLE)) - cos(CAST(j AS DOUBLE)))), 8) AS y FROM {_graph(d)} x GROUP BY i"


@q("cg_step")
def _(d):
    # one conjugate-gradient step for L x = b from x = 0: the step length, and x after it
    return f"""WITH b AS (SELECT CAST(n_nationkey AS BIGINT) AS i, CASE n_nationkey WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS r FROM nation),
    l AS (SELECT g.i, sum(w * (p.r - o.r)) AS lr FROM {_graph(d)} g JOIN b p ON p.i = g.i JOIN b o ON o.i = g.j GROUP BY g.i), a AS (SELECT sum(b.r * b.r) / sum(b.r * l.lr) AS a FROM b JOIN l ON b.i = l.i)
    SELECT b.i, round(a * r, 8) AS x, round(r - a * lr, 8) AS residual FROM b JOIN l ON b.i = l.i CROSS JOIN a"""


@q("power_step")
def _(d):
    return f"""WITH y AS (SELECT CAST(i AS BIGINT) AS i, sum(w * (1 + j)) AS y FROM {_graph(d)} x GROUP BY i) SELECT i, round(y / sqrt(sum(y * y) OVER ()), 8) AS x FROM y"""


@q("boruvka_step")
def _(d):
    # the heaviest edge of each node, ties to the smaller neighbour; an edge that both ends choose counts once
    return f"SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b, w FROM (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, w, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS r FROM {_graph(d)} g) x WHERE r = 1"


@q("component_balance")
def _(d):
    # components by size: the two largest apart, each of the others to the side that is smaller (here three)
    return "WITH c AS (SELECT c_mktsegment AS comp, count(*) AS n FROM customer GROUP BY c_mktsegment), r AS (SELECT comp, n, row_number() OVER (ORDER BY n DESC, comp) AS r FROM c) SELECT a.n AS largest, b.n AS second, CASE WHEN a.n <= b.n THEN 'L' ELSE 'R' END AS third_goes FROM r a JOIN r b ON a.r = 1 AND b.r = 2"


@q("gen_hier_points")
def _(d):
    def part(k: int) -> str:
        key = f"concat('{k}:', CAST({d.div('p.i', 2 ** (6 - k))} AS {d.text}), ':', CAST(c.i AS {d.text}))"
        return f"{2.0 ** -k} * (2 * {d.hu(key)} - 1)"

    terms = " + ".join(part(k) for k in range(7))
    return f"SELECT CAST(p.i AS BIGINT) AS id, CAST(c.i AS BIGINT) AS dim, round({terms}, 8) AS x FROM {d.seq(64)} p CROSS JOIN {d.seq(3)} c"


@q("linkage_tree")
def _(d):
    # linkage rows (children a, b; leaves 0 to 4, inner nodes from 5) to paths of leaves, from the last row down
    z = d.values("n, a, b", "(5, 0, 1), (6, 4, 2), (7, 3, 6), (8, 5, 7)")
    return f"WITH RECURSIVE t(n, path) AS (SELECT 8, CAST('' AS {d.text}) UNION ALL SELECT CASE WHEN s.i = 0 THEN z.a ELSE z.b END, concat(path, CASE WHEN s.i = 0 THEN 'L' ELSE 'R' END) FROM t JOIN {z} AS z ON t.n = z.n CROSS JOIN {d.seq(2)} s) SELECT n AS leaf, path FROM t WHERE n < 5"


@q("make_dag")
def _(d):
    # layers of 1, 2 and 3 nodes, each linked to the whole next layer
    n = d.values("layer, node", "(0, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5)")
    return f"SELECT a.node AS parent, b.node AS child FROM {n} AS a JOIN {n} AS b ON b.layer = a.layer + 1"

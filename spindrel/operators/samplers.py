"""Gibbs sampling of a topic tree with all its variables kept, and k-means by L1 distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.operators.slots import Block, Slots
from spindrel.operators.topics import tokens
from spindrel.plans.catalog import Catalog
from spindrel.plans.scratch import drop, save

CATALOG = Catalog()


class TreeGibbs:
    """Uncollapsed Gibbs sampling of leaf and depth of each slot, leaf and depth shares of each document and word shares of each node.

    ``paths[leaf][depth]`` is a node. A sweep draws, given what else is known: the words of all nodes from their counts (gammas by (seed, sweep, node, term), divided by their sum, so no
    task holds a node's words); then each document by itself: its shares from its counts, its slots' leaves, then their depths. After ``burn_in`` sweeps one sweep is stored, then
    one after every ``lag`` more that are passed over; after ``reset`` stored ones it starts anew with another burn-in.
    """

    def __init__(self, paths: list[list[int]], burn_in: int = 2, lag: int = 1, reset: int | None = None, dl: float = 0.01, dd: float = 1.0, dv: float = 0.1, seed: int = 0) -> None:
        self.paths, self.burn_in, self.lag, self.reset, self.dl, self.dd, self.dv, self.seed = paths, burn_in, lag, reset, dl, dd, dv, seed

    def stored(self, sweeps: int) -> list[int]:
        """Numbers of the sweeps that are stored; a sweep after which it starts anew is one of them."""
        out, wait, since = [], self.burn_in, 0
        for sweep in range(sweeps):
            if wait > 0:
                wait -= 1
                continue
            out.append(sweep)
            since += 1
            if self.reset is not None and since >= self.reset:
                since, wait = 0, self.burn_in
            else:
                wait = self.lag
        return out

    def _slots(self, slots: DataFrame, again: int) -> Slots:
        draw = lambda k, n: F.pmod(F.xxhash64(F.lit(self.seed), F.lit(again), F.lit(k), "doc_id", "pos"), F.lit(n)).cast("int")
        return Slots(slots, {"leaf": draw(0, len(self.paths)), "depth": draw(1, len(self.paths[0]))}, lambda block, x: (x, self._counts(block, *x)))

    def _counts(self, block: Block, leaf: np.ndarray, depth: np.ndarray) -> np.ndarray:
        nodes, place = self._places()
        return block.summed(np.eye(len(nodes))[place[leaf, depth]])

    def _places(self) -> tuple[list[int], np.ndarray]:
        """The nodes in order and the number of each (leaf, depth) among them."""
        nodes = sorted({n for p in self.paths for n in p})
        return nodes, np.array([[nodes.index(n) for n in p] for p in self.paths])

    def _words(self, counts: DataFrame, sweep: int) -> tuple[DataFrame, DataFrame]:
        """(term, x array): the log share of the term in each node; and the table that it is read from."""
        dv, seed, nodes = self.dv, self.seed, self._places()[0]

        def draw(batches: Iterator) -> Iterator:
            import hashlib

            for batch in batches:
                drawn = []
                for term, n in zip(batch["term"], batch["n"]):
                    r = np.random.default_rng([seed, sweep, int.from_bytes(hashlib.md5(str(term).encode()).digest()[:8], "little")])
                    drawn.append(np.maximum(r.gamma(np.asarray(n, float) + dv), 1e-300).tolist())
                batch["g"] = drawn
                yield batch[["term", "g"]]

        drawn = save(counts.mapInPandas(draw, f"term {dict(counts.dtypes)['term']}, g array<double>"), "tree-gibbs-words")
        totals = drawn.agg(*[F.sum(F.col("g")[k]).alias(f"t{k}") for k in range(len(nodes))]).first()  # a number for each node
        return drawn.select("term", F.array(*[F.log(F.col("g")[k]) - float(np.log(totals[k] or 1.0)) for k in range(len(nodes))]).alias("x")), drawn

    def _documents(self, sweep: int):
        """The function that draws shares, leaves and depths of a block's documents, each by its own generator."""
        dl, dd, seed, place = self.dl, self.dd, self.seed, self._places()[1]

        def sample(block: Block, logp: np.ndarray):
            leaf, depth = (x.astype(int) for x in block.kept)
            counts = [block.by_document(np.eye(n)[z]) for z, n in ((leaf, len(place)), (depth, place.shape[1]))]
            shares, draws = [np.empty(c.shape) for c in counts], np.empty((2, len(leaf), 1))
            for i, (doc, a, k) in enumerate(zip(block.ids, block.starts, block.lengths)):
                r = np.random.default_rng([seed, sweep, 7, *([] if doc is None else [int(doc) & 0xFFFFFFFFFFFFFFFF])])
                for share, c, prior in zip(shares, counts, (dl, dd)):
                    share[i] = np.log(np.maximum(r.dirichlet(c[i] + prior), 1e-300))
                for d in draws:
                    d[a : a + k] = r.random((k, 1))

            def pick(x: np.ndarray, u: np.ndarray) -> np.ndarray:
                x = np.exp(x - x.max(1, keepdims=True)).cumsum(1)
                return np.minimum((x < u * x[:, -1:]).sum(1), x.shape[1] - 1)

            rows = block.at[:, None]
            leaf = pick(shares[0][block.document] + logp[rows, place[:, depth].T], draws[0])
            depth = pick(shares[1][block.document] + logp[rows, place[leaf]], draws[1])
            return [leaf, depth], self._counts(block, leaf, depth), []

        return sample

    def fit(self, slots: DataFrame, sweeps: int = 5) -> DataFrame:
        """(sample, doc_id, pos, term, leaf, depth) of the stored sweeps; slots: (doc_id long, pos long, term string), without repeated (doc_id, pos). A document is one task's work at a time."""
        first = slots.select("doc_id", "pos", "term")
        now, kept, out, again = self._slots(first, 0), set(self.stored(sweeps)), [], 0
        rows = lambda n: n.rows("leaf int, depth int", lambda block: [x.astype(np.int32) for x in block.kept])
        free = False
        for sweep in range(sweeps):
            counts = save(now.sums(len(self._places()[0])), "tree-gibbs-counts")
            words, drawn = self._words(counts, sweep)
            before = now.step(words, self._documents(sweep), "tree-gibbs")
            drop(counts, drawn, *([before] if free else []))
            free = sweep not in kept
            if sweep in kept:
                out.append(rows(now).withColumn("sample", F.lit(len(out))))
                if self.reset is not None and len(out) % self.reset == 0 and sweep + 1 < sweeps:
                    again += 1
                    now = self._slots(first, again)
        result = out[0] if out else rows(now).limit(0).withColumn("sample", F.lit(0))
        for more in out[1:]:
            result = result.unionByName(more)
        return result.select("sample", "doc_id", "pos", "term", "leaf", "depth")


@CATALOG.query("tree_gibbs")
def _gibbs(spark, sf_dir):
    slots = tokens(spark, sf_dir).select(F.col("doc_id").cast("long"), F.col("pos").cast("long"), "term")
    return TreeGibbs([[0, 1, 3], [0, 1, 4], [0, 2, 5], [0, 2, 6]], burn_in=1).fit(slots, 2)


def l1_kmeans(points: DataFrame, k: int, rounds: int = 20, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """((id, cluster), centres): each point goes to the centre that is nearest by L1 distance, ties to the lower one, and a centre is the mean of its points; clusters are numbered by falling size.

    It starts from the k points of the least hashes and stops where no centre moves. Centres without points stay. points: (id, v array<double>) of one length; k centres come to the driver.
    """
    first = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()  # k rows
    if len(first) < k:
        raise ValueError(f"{k} clusters need as many points")
    centres = [list(map(float, r["v"])) for r in first]

    def near(c: list[list[float]]) -> F.Column:
        @F.pandas_udf("int")
        def place(v):
            import pandas as pd

            x, best, at = np.stack(v.to_numpy()), np.full(len(v), np.inf), np.zeros(len(v), np.int32)
            for i, row in enumerate(c):
                d = np.abs(x - np.array(row)).sum(1)
                at, best = np.where(d < best, i, at), np.minimum(d, best)
            return pd.Series(at)

        return place("v")

    for _ in range(rounds):
        means = points.withColumn("c", near(centres)).groupBy("c").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(len(centres[0]))]).alias("m")).collect()
        new = list(centres)
        for r in means:
            new[r["c"]] = [float(x) for x in r["m"]]
        moved, centres = new != centres, new
        if not moved:
            break
    sizes = {r["c"]: r["n"] for r in points.groupBy(near(centres).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    centres = [centres[i] for i in sorted(range(k), key=lambda i: (-sizes.get(i, 0), i))]
    return points.select("id", near(centres).alias("cluster")), centres


@CATALOG.query("l1_clusters")
def _l1(spark, sf_dir):
    from spindrel.operators.neighbors import vectors

    return l1_kmeans(vectors(spark, sf_dir), 5)[0]

"""Connected components of an edge table: parts of it are joined in the tasks, what is left by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.scratch import drop, save


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


#: Links that a task joins at once, and up to how many the driver joins by itself (4 MB).
AT_ONCE, LOCAL = 1 << 19, 1 << 18


def _joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, comp) of the nodes of these links: each root goes below its least neighbour's, paths are cut short, until both ends of all links have one root."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y) -> links that join the same nodes, fewer than there are nodes in AT_ONCE rows."""
    x, y = [], []

    def out():
        node, comp = _joined(np.concatenate(x), np.concatenate(y))
        other = node != comp
        return pa.RecordBatch.from_arrays([pa.array(comp[other], pa.int64()), pa.array(node[other], pa.int64())], ["x", "y"])

    for batch in batches:
        x.append(batch.column(0).to_numpy())
        y.append(batch.column(1).to_numpy())
        if sum(map(len, x)) >= AT_ONCE:
            yield out()
            x, y = [], []
    if x:
        yield out()


#: A node counts as a hub from this many links on, or from one of HUBS of all rows on where that is more; so there are no more than HUBS hubs, which reach all tasks.
HUB, HUBS = 4096, 1000


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """Each node hands its larger (large) or its smaller neighbours and itself to the least node that it knows. ``rows`` is no fewer than the edges.

    The links of a hub stay where they are and meet the hub's least node, which is broadcast; all others are joined by node.
    """
    both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).union(edges.select("y", "x"))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    most = max(HUB, -(-2 * rows // HUBS))
    hubs = [(r["u"], r["m"]) for r in least.where(F.col("n") >= most).collect()] if 2 * rows >= most else []  # HUBS rows at most
    each = both.where("v > u") if large else both
    moved = each.join(least.select("u", "m"), "u") if not hubs else None
    if hubs:
        marked = each.join(F.broadcast(edges.sparkSession.createDataFrame(hubs, "u long, hub long")), "u", "left")
        others = marked.where("hub is null").join(least.where(F.col("n") < most).select("u", "m"), "u")
        moved = marked.where("hub is not null").select("v", F.col("hub").alias("m")).union(others.select("v", "m"))
    out = moved.select(F.col("v").alias("y"), F.col("m").alias("x"))
    if not large:
        out = out.union(least.select(F.col("u"), F.col("m")))
    return out.where("x < y").select("x", "y").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(x long, y long) links -> (node, comp): comp is the least node of the node's component.

    Only nodes with links have rows. What the tasks leave of the links goes to the driver if it is LOCAL rows at most. Else each round is written to the scratch folder,
    so a lost executor costs one round at most, and deleted after the next; the number of rounds grows with the logarithm of the component sizes. Nulls, loops and
    repeated links are ignored.
    """
    ordered = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y")
    few = save(ordered.mapInArrow(_contract, "x long, y long"), "contracted")
    if few.count() <= LOCAL:
        got = few.toArrow()
        drop(few)
        node, comp = _joined(*(got.column(k).to_numpy() for k in "xy"))
        return save(edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "comp": pa.array(comp, pa.int64())}), "node long, comp long"), "components")
    now = save(few.distinct(), "edges")
    drop(few)
    before = _state(now)
    while True:
        larger = save(_star(now, before[0], True), "edges")
        drop(now)
        now = save(_star(larger, before[0], False), "edges")
        drop(larger)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("y").alias("node"), F.col("x").alias("comp")).union(now.select("x", "x").distinct())

"""Harmonic packing of documents into sequences of a fixed number of tokens.

Class k holds the pieces of more than capacity / (k + 1) and at most capacity / k tokens, and k of them fill a sequence. As the count alone fills a
sequence, each worker numbers its own pieces of a class; the workers' counts then give every piece its sequence without any search.
A document is cut so that its pieces come close to the upper ends of their classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.bpe import default_path, encoder
from spindrel.llm.scratch import save

#: A piece is cut on when k of it would leave more of a sequence empty than this share.
SLACK = 1 / 64


def cut(tokens: int, capacity: int, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of so many tokens, in order."""
    full, rest = divmod(tokens, capacity)
    out = [capacity] * full
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity or rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def combine(left: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """First-fit decreasing over (class, tokens left): (class, number of the shared sequence, turn in it)."""
    room, turns, out = [], [], []
    for k, n in sorted(left, key=lambda x: (-x[1], x[0])):
        i = next((i for i, r in enumerate(room) if r >= n), len(room))
        if i == len(room):
            room.append(capacity)
            turns.append(0)
        out.append((k, i, turns[i]))
        room[i] -= n
        turns[i] += 1
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, worker = encoder(path).text, TaskContext.get().partitionId()
    tail, seen = np.array([end], np.uint32).tobytes(), {}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "k", "rank"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py()) + tail
            at, n = 0, len(ids) // 4
            for length in cut(n, capacity):
                part, k = ids[4 * at : 4 * (at + length)], capacity // length
                rank = seen[k] = seen.get(k, -1) + 1
                rows.append((doc, at, length, zlib.crc32(part), n, worker, k, rank, *[part] * with_ids))
                at += length
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)


def pack(docs: DataFrame, capacity: int = 2048, end: int = 1, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all texts, each with the id ``end`` after it, into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ``ids`` (binary, little-endian
    uint32) if wanted. start counts the document's ids before the piece, offset the sequence's. Every id lies in exactly one piece. Null or empty texts hold
    the end id alone; null and repeated document ids are rows like others; other columns are not read; an empty docs gives no rows.
    What doesn't fill a sequence of its class, less than one sequence a class however large the corpus, is put together by first fit decreasing.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    path = path or default_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, k int, rank long" + ", ids binary" * with_ids
    pieces = save(rows.mapInArrow(lambda it: _pieces(it, path, end, capacity, with_ids), schema), "pieces")
    counts = pieces.groupBy("worker", "k").agg(F.count(F.lit(1)).alias("n"))
    first = counts.selectExpr("worker", "k", "sum(n) over (partition by k order by worker rows between unbounded preceding and current row) - n as first")
    bins = counts.groupBy("k").agg(F.expr("sum(n) div k").alias("full")).selectExpr("k", "full", "sum(full) over (order by k rows between unbounded preceding and current row) - full as bin0")
    placed = save(pieces.join(first, ["worker", "k"]).join(bins, "k").withColumn("g", F.expr("first + rank")).drop("first", "rank", "worker"), "placed")
    # What is left of each class, less than one sequence: a row for each class, of which there are capacity at most.
    left = placed.where("g >= full * k").groupBy("k").agg(F.sum("length").alias("n")).collect()
    total = placed.sparkSession.createDataFrame(combine([(r["k"], r["n"]) for r in left], capacity) or [(0, 0, 0)], "k int, joined long, turn int")
    whole = bins.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("whole"))
    joined = placed.join(F.broadcast(total.crossJoin(whole)), "k", "left")
    out = joined.selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "if(g < full * k, bin0 + g div k, whole + joined) as sequence_id", f"if(g < full * k, 0, turn) * {capacity} + g % k as place", *["ids"] * with_ids)
    offset = F.expr("sum(length) over (partition by sequence_id order by place rows between unbounded preceding and current row) - length").alias("offset")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *["ids"] * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, lengths array<long>, doc_ids array<long>) from pieces packed with their ids; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("p")
    ids = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")
    return pieces.groupBy("sequence_id").agg(parts).select("sequence_id", ids, F.col("p.length").alias("lengths"), F.col("p.doc_id").alias("doc_ids"))

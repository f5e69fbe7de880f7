"""Token id files: concatenated ids whose document boundaries are Elias-Fano encoded.

A file set is a table of segments. A segment is a self-contained run of whole documents in ascending id order: a header, the
document ids and the boundaries as two Elias-Fano sequences, and the ids with 2 or 4 bytes each. A boundary is found by
a select on the high bits, from the nearest sample; no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.bpe import default_path, encoder
from spindrel.llm.scratch import freed, new_path

MAGIC = b"SPTOK1"
#: Ids that a segment should hold; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 16
#: Every so many ones of the high bits have their place sampled.
SAMPLE = 256
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of n values of 0 or more in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", np.empty(0, np.uint32))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        low = (values[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        return cls(n, width, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        return int.from_bytes(self.low[a // 8 : (b + 7) // 8], "little") >> a % 8 & (1 << self.low_bits) - 1

    def __getitem__(self, i: int) -> int:
        """Value i: the place of one number i in the high bits, less i, over the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        here = self.high[byte] >> at % 8 << at % 8
        while (ones := int(_ONES[here])) <= left:
            left -= ones
            byte += 1
            here = self.high[byte]
        for _ in range(left):
            here &= here - 1
        place = byte * 8 + (here & -here).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """All values, as uint64."""
        if not self.n:
            return np.empty(0, np.uint64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return high + (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def dump(self) -> bytes:
        return struct.pack("<IBII", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes, at: int) -> tuple["EliasFano", int]:
        n, width, a, b = struct.unpack_from("<IBII", raw, at)
        at += struct.calcsize("<IBII")
        samples = np.frombuffer(raw, "<u4", -(-n // SAMPLE), at + a + b)
        return cls(n, width, raw[at : at + a], raw[at + a : at + a + b], samples), at + a + b + samples.nbytes


def dump_segment(doc_ids: list[int | None], docs: list[bytes], width: int) -> bytes:
    """doc_ids ascending, nulls first; docs: each document's ids as little-endian uint32."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(d) // 4 for d in docs])
    ids = np.frombuffer(b"".join(docs), "<u4").astype(f"<u{width}")
    names = (known.astype(np.uint64) - np.uint64(least & 2**64 - 1)).astype(np.uint64)
    return MAGIC + struct.pack("<BIq", width, len(doc_ids) - len(known), least) + EliasFano.of(names).dump() + EliasFano.of(ends).dump() + ids.tobytes()


class Segment:
    """Reads documents of one segment by their place in it."""

    def __init__(self, raw: bytes) -> None:
        if raw[:6] != MAGIC:
            raise ValueError("not a token segment")
        self.raw = raw
        self.width, self.nulls, self.least = struct.unpack_from("<BIq", raw, 6)
        self.names, at = EliasFano.load(raw, 6 + struct.calcsize("<BIq"))
        self.ends, self.at = EliasFano.load(raw, at)

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [x + self.least for x in self.names.all().tolist()]

    def ids(self, i: int) -> np.ndarray:
        """The ids of document i as uint32, found by two selects."""
        a, b = self.ends[i - 1] if i else 0, self.ends[i]
        return np.frombuffer(self.raw, f"<u{self.width}", b - a, self.at + a * self.width).astype(np.uint32)


def _write(batches: Iterator[pa.RecordBatch], path: str, end: int, width: int) -> Iterator[pa.RecordBatch]:
    encode, worker = encoder(path).text, TaskContext.get().partitionId()
    tail = np.array([end], np.uint32).tobytes()
    names, docs, held, number, before = [], [], 0, 0, 0

    def segment():
        return pa.RecordBatch.from_arrays([pa.array([worker], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([dump_segment(names, docs, width)], pa.binary())], ["worker", "number", "before", "n_ids", "segment"])

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py()) + tail
            if names and held + len(ids) // 4 > SEGMENT_IDS:
                yield segment()
                number, before = number + 1, before + held
                names, docs, held = [], [], 0
            names.append(name)
            docs.append(ids)
            held += len(ids) // 4
    if names:
        yield segment()


def write_tokens(docs: DataFrame, out: str, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each with the id ``end`` after it, to the folder ``out`` in ascending id order.

    Ids are those of the tokenizer file ``path`` without special tokens. Null texts are empty, null document ids come first, repeated ids are ordered by
    their texts; an empty docs writes no segment. Ids take 2 bytes if the vocabulary allows it, else 4. Spark's writer commits the segments, so a task that
    is tried again leaves none twice. The shuffle files of the texts are deleted when all is written.
    """
    width = 2 if max(encoder(path).whole.get_vocab_size(), end + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the start of the text goes with the id, so that null ids, or one id of many rows, are cut up too
    ordered = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    with freed(docs.sparkSession):
        ordered.mapInArrow(lambda it: _write(it, path, end, width), "worker int, number int, before long, n_ids long, segment binary").write.option("compression", "none").parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            segment = Segment(raw.as_py())
            n = len(segment)
            ids = [segment.ids(i) for i in range(n)]
            counts = np.array([len(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment.doc_ids(), pa.int64()), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
            )


def read_tokens(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian uint32) of a folder of write_tokens.

    start counts the ids of all documents before; it needs one sum for each writing task. These few numbers go to all tasks, so that the segments are read
    where they lie: left to its own measure, Spark shuffles them all before it knows how small the sums are.
    """
    segments = spark.read.parquet(out)
    ends = segments.groupBy("worker").agg(F.sum("n_ids").alias("n")).withColumn("block", F.expr("worker div 4096"))
    blocks = ends.groupBy("block").agg(F.sum("n").alias("s")).selectExpr("block", "sum(s) over (order by block rows between unbounded preceding and current row) - s as earlier")
    first = ends.join(blocks, "block").selectExpr("worker", "earlier + sum(n) over (partition by block order by worker rows between unbounded preceding and current row) - n as first")
    return segments.join(F.broadcast(first), "worker").select((F.col("first") + F.col("before")).alias("start"), "segment").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, end: int = 2, path: str | None = None) -> DataFrame:
    """Writes docs to a folder of its own in the scratch folder and reads that back."""
    out = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, path or default_path(), end)
    return read_tokens(docs.sparkSession, out)


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw)

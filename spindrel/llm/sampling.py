"""Bounded samples for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 1 << 31


def least_by_hash(df: DataFrame, by: list[str], sample: int) -> DataFrame:
    """The ``sample`` rows of df with the least hash of the columns ``by``, or all of fewer.

    The rows are counted first, and only a share with low hashes, about half as many again as are wanted, is ordered: what tasks hand on doesn't grow with their number.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(_RANGE))
    few = df if n <= 2 * sample else df.where(h < int(_RANGE * (1.5 * sample + 50) / n))
    return few.withColumn("__h", h).orderBy("__h", *[F.col(f"`{c}`") for c in by]).limit(sample).drop("__h")


def _even(counts: dict, sample: int) -> dict:
    """Rows to take of each group, ``sample`` in all, or one of each of more groups: small groups whole, what they leave goes to the larger ones."""
    out, left = {}, sample
    for i, (k, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[k] = max(1, min(n, left // (len(counts) - i)))
        left -= out[k]
    return out


def least_by_hash_within(df: DataFrame, group: str, by: list[str], sample: int) -> DataFrame:
    """Like least_by_hash, with a share of ``sample`` for each value of the column ``group``: every value that any row has keeps rows."""
    counts = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each value
    if not counts:
        return df
    h = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(_RANGE))
    shares = [(k, n, _RANGE if counts[k] <= 2 * n else int(_RANGE * (1.5 * n + 50) / counts[k])) for k, n in _even(counts, sample).items()]
    limits = df.sparkSession.createDataFrame(shares, f"`{group}` string, __n long, __top long")
    few = df.join(F.broadcast(limits), group).withColumn("__h", h).where("__h < __top")
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__h", *[F.col(f"`{c}`") for c in by])))
    return ranked.where("__r <= __n").select(*[F.col(f"`{c}`") for c in df.columns])

"""Sharding by a two-pass external shuffle.

Pass one scatters the records over buckets by a seeded hash, so that each bucket is a uniform
sample that fits in a task's memory; the exchange's files are the buckets. Pass two reads one bucket
a task, permutes it by Fisher-Yates (Spark's ``shuffle`` array function), and deals the
permuted records to the shards by their place in the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a bucket should hold.
BUCKET_BYTES = 16 << 20
#: Buckets whose first places (two numbers each, 4 MB at most) are sent to all tasks; more are joined by bucket.
MOST_SENT = 1 << 18


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffle_shards(df: DataFrame, shards: int = 16, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df in a seeded random order, cut into shards whose row counts differ by one at most.

    Returns df's columns with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).
    The order depends on the rows and the seed alone, not on how df is partitioned: rows are scattered by a
    hash of id and text, and a bucket is sorted before it is permuted. Null ids and null or empty texts are
    rows like others; repeated rows all stay and are interchangeable; columns named ``shard`` or ``slot`` are
    replaced. An empty df gives no rows. Only the counts of the buckets are kept aside; up to MOST_SENT of them
    are sent to all tasks, more are joined by bucket.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    key = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    total = df.agg(F.sum(size_of(key[1])).alias("b"), F.count(F.lit(1)).alias("n")).first()
    rows, buckets = total["n"], max(1, -(-(total["b"] or 0) // bucket_bytes))
    dealt = df.select(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int").alias("__bucket"), F.struct(*key, *[F.col(f"`{c}`") for c in names if c not in (id_col, text_col)]).alias("__row"))
    ends = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # A running sum over the buckets: blocks of 4096 first, so that no task sorts more than one block or the list of blocks.
    ends = ends.withColumn("__block", F.expr("__bucket div 4096"))
    blocks = ends.groupBy("__block").agg(F.sum("__n").alias("__sum")).select("__block", F.expr("sum(__sum) over (order by __block rows between unbounded preceding and current row) - __sum").alias("__before"))
    first = ends.join(blocks, "__block").select("__bucket", F.expr("__before + sum(__n) over (partition by __block order by __bucket rows between unbounded preceding and current row) - __n").alias("__first"))
    # One bucket a partition: the permutation of a bucket is drawn from the seed and its partition's number, so it is the same whenever it is made again.
    lists = dealt.repartitionById(buckets, "__bucket").groupBy("__bucket").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    mixed = lists.withColumn("__rows", F.shuffle("__rows", F.lit(seed)))
    q, r = divmod(rows, shards)
    if buckets <= MOST_SENT:
        first = F.broadcast(first)
    at = mixed.join(first, "__bucket").select("__first", F.posexplode("__rows").alias("__i", "__row")).select((F.col("__first") + F.col("__i")).alias("__at"), "__row.*")
    cut = (q + 1) * r  # the first r shards have one row more
    shard = F.expr(f"case when __at < {cut}L then __at div {q + 1}L else {r}L + (__at - {cut}L) div {max(q, 1)}L end").cast("int")
    slot = F.expr(f"case when __at < {cut}L then __at % {q + 1}L else (__at - {cut}L) % {max(q, 1)}L end").cast("long")
    return at.select(*[F.col(f"`{c}`") for c in names], shard.alias("shard"), slot.alias("slot"))


def write_shards(df: DataFrame, out: str, shards: int = 16, **how) -> None:
    """Writes the rows of df, shuffled as by shuffle_shards (``how`` goes there), to the folder ``out``: a folder ``shard=K`` for each shard, its files in the order of their slots.

    A task writes one bucket, which is a run of slots of one shard or of shards side by side, so nothing is shuffled again. Spark's writer commits the files of a task as a whole, so a lost
    executor leaves none twice. An empty df writes no shard.
    """
    shuffle_shards(df, shards, **how).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)


def read_shard(spark, out: str, shard: int) -> DataFrame:
    """The rows of one shard, with their slots; ordered by slot they are as they were dealt."""
    return spark.read.parquet(f"{out.rstrip('/')}/shard={shard}")

"""Streaming forms: ingestion with a ledger, windows over late events, and a table-count process with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, ledger: str) -> None:
    """Copies what is new in a folder of Parquet files to target and stops; the checkpoint in ``ledger`` knows what is done, and a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", ledger).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and tumbling window of a stream (or table) of (ts, event_type, value)."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = ts.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def seat_guests(guests: DataFrame, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Chinese-restaurant seating of a stream of (room, guest): (room, guest, place); a room's table counts are its state."""
    import numpy as np

    def seat(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts = list(state.get[0]) if state.exists else []
        rows = []
        for batch in batches:
            for g in sorted(batch["guest"]):
                r = np.random.default_rng([seed, int(g)]).random() * (sum(counts) + alpha)
                k = int(np.searchsorted(np.cumsum(counts), r, "right")) if counts else 0
                if k == len(counts):
                    counts.append(0)
                counts[k] += 1
                rows.append((key[0], g, k))
        state.update((counts,))
        yield pd.DataFrame(rows, columns=["room", "guest", "place"])

    return guests.groupBy("room").applyInPandasWithState(seat, "room string, guest long, place int", "counts array<long>", "append", "NoTimeout")

"""Set covers: the greedy one as rounds over tables, the exact one over a few sets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.plans.catalog import Catalog
from spindrel.plans.dialects import run_sql
from spindrel.plans.scratch import save

CATALOG = Catalog()


def greedy_cover(sets: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(step, s, gain): the sets that a greedy cover takes, in order, and how many items each adds.

    sets: (s, item); weights: (s, weight), positive, 1 where it isn't given. A step takes the set with most uncovered items for its weight, ties to the lowest s. Rows repeated or with a null
    count as not there; an empty table has an empty cover. A step groups the pairs that are still uncovered, which are written each time; the driver sees one row a step.
    """
    spark = sets.sparkSession
    left = sets.where("s is not null and item is not null").select("s", "item").distinct()
    if weights is not None:
        bad = weights.where("weight <= 0")
        if bad.limit(1).count():
            raise ValueError("weights must be positive")
        least = weights.groupBy("s").agg(F.min("weight").alias("weight"))
        left = left.join(least, "s", "left").select("s", "item", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    else:
        left = left.withColumn("weight", F.lit(1.0))
    left, taken = save(left, "cover"), []
    kind = left.schema["s"].dataType.simpleString()
    while True:
        best = left.groupBy("s", "weight").agg(F.count(F.lit(1)).alias("gain")).orderBy(F.desc(F.col("gain") / F.col("weight")), "s").limit(1).collect()
        if not best:
            return spark.createDataFrame(taken, f"step int, s {kind}, gain long")
        taken.append((len(taken), best[0]["s"], best[0]["gain"]))
        covered = left.where(F.col("s") == F.lit(best[0]["s"])).select("item")
        left = save(left.join(covered, "item", "left_anti"), "cover")


def exact_cover(sets: list[set]) -> list[int] | None:
    """Places of the first smallest choice of sets, in the order of sizes, that covers all items; exhaustive, so for a few sets only."""
    everything = set().union(*sets) if sets else set()
    for k in range(len(sets) + 1):
        for chosen in combinations(range(len(sets)), k):
            if set().union(*(sets[i] for i in chosen)) == everything:
                return list(chosen)
    return None


#: For each day the nations that ordered on it.
_SETS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS s, c_nationkey AS item FROM orders JOIN customer ON o_custkey = c_custkey)"


@CATALOG.query("set_cover_greedy", f"""
WITH RECURSIVE sets AS MATERIALIZED (SELECT s, list(DISTINCT item) AS items FROM {_SETS} GROUP BY s),
r(step, s, gain, covered) AS (SELECT -1, NULL::DATE, 0::BIGINT, []::INT[] UNION ALL
  SELECT step + 1, best.s, best.gain, best.covered FROM (SELECT r.step, unnest([(SELECT {{'s': x.s, 'gain': len(list_filter(x.items, lambda i: NOT list_contains(r.covered, i))), 'covered': list_concat(r.covered, x.items)}}
    FROM sets x ORDER BY len(list_filter(x.items, lambda i: NOT list_contains(r.covered, i))) DESC, x.s LIMIT 1)]) AS best FROM r) WHERE best.gain > 0)
SELECT step::INT AS step, s, gain::BIGINT AS gain FROM r WHERE step >= 0""")
def _greedy(spark, sf_dir):
    return greedy_cover(run_sql(spark, sf_dir, "SELECT * FROM " + _SETS))

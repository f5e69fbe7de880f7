"""spark-submit entry for hierarchical clustering of a CSV file."""

from __future__ import annotations

import argparse
import json
import logging
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spindrel.operators.trees import HierClust
from spindrel.sources.files import read_csv


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--feature_columns", default=".*", help="regular expression that the names of the features match")
    a.add_argument("--constructor_json", default="{}", help="parameters of the clustering")
    a.add_argument("--random_seed", type=int, default=0)
    a.add_argument("--log", default="WARNING")
    o = a.parse_args(args)
    logging.basicConfig(level=o.log.upper())
    spark = SparkSession.builder.getOrCreate()
    rows = read_csv(spark, o.input)
    features = [c for c in rows.columns if re.match(o.feature_columns, c)]
    points = rows.select(F.monotonically_increasing_id().alias("id"), F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("v"))
    HierClust(**json.loads(o.constructor_json)).fit(points).orderBy("id").write.mode("overwrite").option("header", True).csv(o.output)


if __name__ == "__main__":
    main()

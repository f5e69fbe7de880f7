"""Registry that pairs each query with the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries; ``sql`` is the equivalent for DuckDB, None where SQL has no words for it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None):
        """Decorator form of :meth:`add`."""

        def register(f: Query) -> Query:
            self.add(name, f, sql)
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

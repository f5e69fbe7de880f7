"""SQL fragments that Spark and DuckDB spell differently, so that one text serves as a query and as its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrel.plans.catalog import Catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class SparkSql:
    text = "STRING"
    #: One row for each element of each vector.
    vec = "(SELECT vec_id, label, CAST(pos AS BIGINT) AS pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x)"

    @staticmethod
    def tok(table: str = "documents", key: str = "doc_id") -> str:
        return f"(SELECT {key}, CAST(pos AS BIGINT) AS pos, term FROM {table} LATERAL VIEW posexplode(regexp_extract_all(lower(text), '[a-z]+', 0)) t AS pos, term)"

    @staticmethod
    def hu(e: str) -> str:
        """A number in [0, 1) that the text e fixes."""
        return f"(CAST(conv(substr(md5({e}), 1, 8), 16, 10) AS DOUBLE) / 4294967296D)"

    @staticmethod
    def seq(n: str | int, start: str | int = 0) -> str:
        return f"(SELECT id AS i FROM range({start}, {n}))"

    @staticmethod
    def div(a: str, b: str | int) -> str:
        return f"(({a}) div ({b}))"

    @staticmethod
    def quantile(x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    @staticmethod
    def lower_quantile(x: str, q: float) -> str:
        return f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})"

    @staticmethod
    def starts(a: str, b: str) -> str:
        return f"startswith({a}, {b})"

    @staticmethod
    def values(names: str, rows: str) -> str:
        return f"(SELECT * FROM VALUES {rows} AS v({names}))"

    @staticmethod
    def joined(e: str, order: str, by: str = ",") -> str:
        """Texts e of a group, in order."""
        return f"listagg({e}, '{by}') WITHIN GROUP (ORDER BY {order})"


class DuckSql:
    text = "VARCHAR"
    vec = "(SELECT vec_id, label, pos, embedding[pos + 1]::DOUBLE AS x FROM (SELECT *, unnest(range(len(embedding))) AS pos FROM embeddings))"

    @staticmethod
    def tok(table: str = "documents", key: str = "doc_id") -> str:
        return f"(SELECT {key}, pos, t[pos + 1] AS term FROM (SELECT {key}, t, unnest(range(len(t))) AS pos FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z]+') AS t FROM {table})))"

    @staticmethod
    def hu(e: str) -> str:
        return f"(('0x' || substr(md5({e}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

    @staticmethod
    def seq(n: str | int, start: str | int = 0) -> str:
        return f"(SELECT range AS i FROM range({start}, {n}))"

    @staticmethod
    def div(a: str, b: str | int) -> str:
        return f"(({a}) // ({b}))"

    @staticmethod
    def quantile(x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    @staticmethod
    def lower_quantile(x: str, q: float) -> str:
        return f"quantile_disc({x}, {q})"

    @staticmethod
    def starts(a: str, b: str) -> str:
        return f"starts_with({a}, {b})"

    @staticmethod
    def values(names: str, rows: str) -> str:
        return f"(SELECT * FROM (VALUES {rows}) AS v({names}))"

    @staticmethod
    def joined(e: str, order: str, by: str = ",") -> str:
        return f"string_agg({e}, '{by}' ORDER BY {order})"


SPARK, DUCK = SparkSql(), DuckSql()


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Names the tables that sql reads."""
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views(spark, sf_dir, sql)
    return spark.sql(sql)


def both(catalog: Catalog, name: str):
    """Registers f(dialect) -> SQL as a query and as its check."""

    def register(f: Callable):
        catalog.add(name, lambda spark, sf_dir: run_sql(spark, sf_dir, f(SPARK)), f(DUCK))
        return f

    return register

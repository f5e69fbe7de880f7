"""Readers and writers of the file formats that the pipelines take in and give out.

All readers return DataFrames and leave the reading to Spark, so any store that Spark knows will do.
"""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates fields.
BLANKS = "[ \t]+"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, text: bool = False, strict: bool = False, skip_columns: int = 0, rows: int | None = None) -> DataFrame:
    """A CSV table; ``text`` keeps all columns as strings, ``strict`` fails on a field that doesn't fit the schema, the first ``skip_columns`` are left out, ``rows`` limits the rows."""
    reader = spark.read.option("header", header).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", not text).csv(path)
    df = df.select(*[F.col(f"`{c}`") for c in df.columns[skip_columns:]])
    return df if rows is None else df.limit(rows)


def read_csv_after_comments(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose header is its last line that starts with '#': names are stripped, all columns are strings."""
    lines = spark.read.text(path).where("value <> ''")
    marked = numbered_lines(spark, path).where(F.col("value").startswith("#"))
    header = marked.agg(F.max_by("value", "line")).first()[0]
    if header is None:
        raise ValueError(f"{path} has no line that starts with '#'")
    names = [n.strip() for n in header.lstrip("#").split(",")]
    parts = F.split("value", ",")
    return lines.where(~F.col("value").startswith("#")).select(*[F.trim(F.try_element_at(parts, F.lit(i + 1))).alias(n) for i, n in enumerate(names)])


def read_blank_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields apart by any white space."""
    parts = F.split(F.trim("value"), BLANKS)
    fields = T._parse_datatype_string(schema).fields
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.try_element_at(parts, F.lit(i + 1)).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def read_bag_of_words(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, idx, n) of lines ``pairs idx:n idx:n ..``; a line whose pairs don't match their number fails; repeated indexes add up. doc_id is the line's place."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parts = lines.select(F.col("line").alias("doc_id"), F.split(F.trim("value"), BLANKS).alias("p"))
    sure = parts.withColumn("p", F.when(F.element_at("p", 1).cast("int") == F.size("p") - 1, F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1)))).otherwise(F.raise_error(F.lit("a line's number of pairs is wrong")).cast("array<string>")))
    pair = F.split("pair", ":")
    return sure.select("doc_id", F.explode("p").alias("pair")).groupBy("doc_id", pair[0].cast("int").alias("idx")).agg(F.sum(pair[1].cast("long")).alias("n"))


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, word, n) of lines ``word:n word:n ..``."""
    pair = F.split("pair", ":(?=[0-9]+$)")
    return numbered_lines(spark, path).where(F.trim("value") != "").select(F.col("line").alias("doc_id"), F.explode(F.split(F.trim("value"), BLANKS)).alias("pair")).groupBy("doc_id", pair[0].alias("word")).agg(F.sum(pair[1].cast("long")).alias("n"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line from 0, value) of a text file, of several in the order of their names. Splits are numbered by themselves and begin where the splits before them end, so a file has no limit of size."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file", "split", (F.sum("n").over(Window.orderBy("file", "split")) - F.col("n")).alias("before"))  # a row for each split
    place = F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1
    return rows.withColumn("place", place).join(before, ["file", "split"]).select((F.col("before") + F.col("place")).cast("long").alias("line"), "value")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, term): one term a line."""
    return numbered_lines(spark, path).where("value <> ''").select(F.col("line").alias("term_id"), F.rtrim("value").alias("term"))


def read_xml_texts(spark: SparkSession, path: str, row_tag: str, inner: str) -> DataFrame:
    """(text): of each row_tag element the first match of the xpath ``inner``, stripped."""
    whole = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("x"))
    rows = whole.select(F.explode(F.regexp_extract_all("x", F.lit(f"(?s)(<{row_tag}[ >].*?</{row_tag}>)"), F.lit(1))).alias("x"))
    return rows.select(F.trim(F.xpath_string("x", F.lit(f"/{row_tag}/{inner}"))).alias("text"))


def xml_tags(spark: SparkSession, path: str) -> DataFrame:
    """(depth, tag): the tags that stand at each depth."""

    def explore(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for page in pages:
            for raw in page["content"]:
                found, level, depth = set(), [ElementTree.fromstring(raw)], 0
                while level:
                    found |= {(depth, e.tag) for e in level}
                    level, depth = [c for e in level for c in e], depth + 1
                yield pd.DataFrame(sorted(found), columns=["depth", "tag"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(explore, "depth int, tag string").distinct()


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """(row, values array<int>) of IDX files, gzipped or not: labels (magic 2049) or images (magic 2051)."""

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in files:
            for raw in f["content"]:
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bytes(raw)
                magic, n = struct.unpack(">II", raw[:8])
                if magic not in (2049, 2051):
                    raise ValueError(f"not an IDX file of bytes: magic {magic}")
                dims = struct.unpack(f">{magic - 2049}I", raw[8 : 8 + 4 * (magic - 2049)])
                size = int(np.prod(dims)) if dims else 1
                data = np.frombuffer(raw, np.uint8, n * size, 8 + 4 * (magic - 2049)).reshape(n, size)
                for a in range(0, n, 1000):
                    yield pd.DataFrame({"row": np.arange(a, min(a + 1000, n)), "values": [v.astype(int).tolist() for v in data[a : a + 1000]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row long, values array<int>")


def read_labelled_records(spark: SparkSession, path: str, size: int = 3072) -> DataFrame:
    """(row, label, values) of binary records of one label byte and ``size`` value bytes."""

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in files:
            for raw in f["content"]:
                data = np.frombuffer(raw, np.uint8).reshape(-1, size + 1)
                for a in range(0, len(data), 500):
                    part = data[a : a + 500]
                    yield pd.DataFrame({"row": np.arange(a, a + len(part)), "label": part[:, 0].astype(int), "values": [v.astype(int).tolist() for v in part[:, 1:]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row long, label int, values array<int>")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(term, v) of lines ``term x x x``."""
    parts = F.split(F.trim("value"), " ")
    return spark.read.text(path).select(parts[0].alias("term"), F.transform(F.slice(parts, 2, 1 << 20), lambda x: x.cast("double")).alias("v"))


def wide_to_long(df: DataFrame, pattern: str = r"wavelength_([0-9]+\.?[0-9]*)") -> DataFrame:
    """Columns whose names match pattern become rows (wavelength, intensity); the others stay."""
    wide = [c for c in df.columns if re.match(pattern, c)]
    cells = F.array(*[F.struct(F.lit(float(re.match(pattern, c)[1])).alias("wavelength"), F.col(f"`{c}`").cast("double").alias("intensity")) for c in wide])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in wide], F.inline(cells))


def checked_replace(text: F.Column, old: str, new: str) -> F.Column:
    """replace() that fails where nothing is replaced."""
    return F.when(F.contains(text, F.lit(old)), F.replace(text, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.concat(F.lit(f"no {old} in "), text)).cast("string"))


def write_csv(df: DataFrame, path: str, header: bool = True, append: bool = False) -> None:
    df.write.mode("append" if append else "error").option("header", header).csv(path)


def write_by_leaf(df: DataFrame, path: str, leaf: str = "leaf_path") -> None:
    """One folder for each leaf of a tree; the rows of a leaf are first brought together, and large leaves spread."""
    df.repartition(leaf, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(8))).write.partitionBy(leaf).parquet(path)


def write_csv_by_leaf(df: DataFrame, path: str, leaf: str = "leaf_path") -> None:
    """A folder for each leaf with one CSV file that has its header; a leaf is as small as its tree says, so one task writes it."""
    df.repartition(leaf).write.partitionBy(leaf).option("header", True).csv(path)


def write_documents(tokens: DataFrame, path: str) -> None:
    """Text files with a document a line, its terms in order with blanks between, in ascending doc_id; tokens: (doc_id, pos, term). A document without terms has no line."""
    lines = tokens.where("term is not null").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda t: t["term"]), " ").alias("value"))
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)


def write_snapshot(tables: dict[str, object], root: str, stamp: str) -> list[str]:
    """Writes the DataFrames among ``tables`` as Parquet to root/stamp/name; returns the names of what isn't one and was left out."""
    left_out = []
    for name, t in tables.items():
        if isinstance(t, DataFrame):
            t.write.parquet(f"{root.rstrip('/')}/{stamp}/{name}")
        else:
            left_out.append(name)
    return sorted(left_out)


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """Does nothing where the output is there, unless forced."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def write_metrics(rows: DataFrame, path: str, reset: bool = False) -> None:
    """Appends an epoch's metrics, arrays as texts with ';' between; reset starts afresh."""
    flat = rows.select(*[F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), ";").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema.fields])
    flat.write.mode("overwrite" if reset else "append").json(path)


def newick(text: str) -> list[tuple[str, str]]:
    """(path, name) of the leaves of a Newick tree, with more than two children folded from the left."""
    text = re.sub(r"\s|:[^,()]*|\)[^,();]+(?=[,();])", lambda m: ")" if m[0].startswith(")") else "", text.strip().rstrip(";"))
    stack, now = [], []
    for token in re.findall(r"[(),]|[^(),]+", text):
        if token == "(":
            stack.append(now)
            now = []
        elif token == ")":
            node = reduce(lambda a, b: (a, b), now)
            now = stack.pop()
            now.append(node)
        elif token != ",":
            now.append(token)

    def leaves(node, path=""):
        return [(path, node)] if isinstance(node, str) else leaves(node[0], path + "L") + leaves(node[1], path + "R")

    return leaves(now[0])

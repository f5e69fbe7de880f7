"""From documents to packed sequences: language ID, quality, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm import decontaminate, langid, ngram_jaccard, packing, quality
from spindrel.llm.scratch import save
from spindrel.plans.catalog import table

#: Pooled probability below which a document's language counts as unknown, and score below which a document counts as bad.
LEAST_LANGUAGE, LEAST_QUALITY = 0.3, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; it learns from those of them that have a language and aren't held out."""
    network = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, network, docs.columns)
    return found.where(f"lang_pred <> '{langid.UNDETERMINED}' and score >= {LEAST_LANGUAGE}").select(*[f"`{c}`" for c in docs.columns])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = table(spark, sf_dir, "labels").where(~langid.held_out(mod=4, rest=2))
    scored = quality.score(docs, quality.train(docs, labels), docs.columns)
    return scored.where(f"score >= {LEAST_QUALITY}").select(*[f"`{c}`" for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, likeness 0.8): the one with the smallest id, of several such by a hash of the text; documents without words stay.

    Rows are told apart by id and text, so other texts of an id that repeats stay or go by themselves. A document without id goes by a negative number made from its text;
    rows that repeat whole count once.
    """
    keyed = docs.withColumn("__id", F.coalesce("doc_id", -F.abs(F.xxhash64("text") % (1 << 62)) - 1)).withColumn("__key", F.xxhash64("__id", "text"))
    found, _ = ngram_jaccard.ngram_jaccard_join(keyed.select("__key", "text"), words=5, percent=80, id_col="__key")
    members = save(found.select(F.col("doc_id").alias("__key"), "component_id").groupBy("__key", "component_id").agg(F.count(F.lit(1)).alias("n")).join(keyed.select("__key", "__id").distinct(), "__key"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct("__id", "__key")).alias("first"))
    members = members.join(first, "component_id").select("__key", "n", (F.col("first.__key") == F.col("__key")).alias("stays"))
    kept = keyed.join(members.where("not stays or n > 1").select("__key"), "__key", "left_anti")
    again = keyed.join(members.where("stays and n > 1").select("__key"), "__key", "left_semi").dropDuplicates(["__id", "text"])
    return kept.unionByName(again).select(*[f"`{c}`" for c in docs.columns])


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, capacity=2048, end=1)


STAGES = [("language", language), ("quality", good), ("near_copies", distinct), ("benchmark", unleaked), ("packing", packed)]

#: No SQL: networks and aligned searches aren't expressible; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the scratch folder and read again."""
    out = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = save(out, f"stage-{name}")
    return out

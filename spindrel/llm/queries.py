"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrel.plans.catalog import Catalog, table

CATALOG = Catalog()


@CATALOG.query("op4_external_shuffle")
def op4_external_shuffle(spark, sf_dir):
    from spindrel.llm.sharding import shuffle_shards, size_of

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle_shards(docs, shards=16, seed=20240601)
    return out.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB's words for op1: shingle sets, overlap counts by shingle, and components by repeated relabelling.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
classes AS (SELECT c, min(doc_id) AS rep FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS c FROM s GROUP BY 1) GROUP BY c),
member AS (SELECT d.doc_id, rep FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS c FROM s GROUP BY 1) d JOIN classes USING (c)),
r AS (SELECT s.* FROM s JOIN classes ON s.doc_id = rep),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
walk(a, b) AS (SELECT x, y FROM e UNION SELECT walk.a, e.y FROM walk JOIN e ON walk.b = e.x),
comp AS (SELECT a, min(b) AS b FROM walk GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(rep, comp.b), rep, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN member ON member.doc_id = d.doc_id LEFT JOIN comp ON comp.a = rep
"""


@CATALOG.query("op1_ngram_jaccard", OP1_SQL)
def op1_ngram_jaccard(spark, sf_dir):
    from spindrel.llm.ngram_jaccard import ngram_jaccard_join

    members, _ = ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)
    return members.select("doc_id", "n_shingles", "component_id")


@CATALOG.query("op2_elias_fano")
def op2_elias_fano(spark, sf_dir):
    from spindrel.llm.elias_fano import token_files

    out = token_files(table(spark, sf_dir, "documents"), end=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@CATALOG.query("op5_harmonic_packing")
def op5_harmonic_packing(spark, sf_dir):
    from spindrel.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=2048, end=1)


@CATALOG.query("op8_byte_network_langid")
def op8_byte_network_langid(spark, sf_dir):
    from spindrel.llm.langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    return identify(docs, train(docs.where("not held_out")), ["doc_id", "held_out"])


@CATALOG.query("op9_quadratic_quality")
def op9_quadratic_quality(spark, sf_dir):
    from spindrel.llm.langid import held_out
    from spindrel.llm.quality import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(mod=4, rest=2).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(mod=4, rest=2))
    out = score(docs, train(docs, labels), ["doc_id", "held_out"])
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


@CATALOG.query("op3_merkle_fingerprints")
def op3_merkle_fingerprints(spark, sf_dir):
    from spindrel.llm.merkle import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@CATALOG.query("op10_edit_aware_counts")
def op10_edit_aware_counts(spark, sf_dir):
    """Counts before and after three edits: 20 code points go at a third, a phrase comes in at half, the first 50 are added at the end. The trees are kept as a table in between."""
    from spindrel.llm.scratch import save
    from spindrel.llm.token_counts import build_trees, edit_trees

    edits = F.expr("""array(named_struct('at', length(text) div 3, 'cut', 20, 'put', ''), named_struct('at', length(text) div 2, 'cut', 0, 'put', 'an inserted phrase, of 42 marks'),
        named_struct('at', length(text) + 100, 'cut', 0, 'put', substring(text, 1, 50)))""")
    trees = save(build_trees(table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits")), ["doc_id", "edits"]), "trees")
    return edit_trees(trees, ["doc_id", "n_tokens"]).drop("tree")


@CATALOG.query("op6_qgram_decontamination")
def op6_qgram_decontamination(spark, sf_dir):
    from spindrel.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@CATALOG.query("op7_recurrent_blocks")
def op7_recurrent_blocks(spark, sf_dir):
    from spindrel.llm.html_blocks import main_text

    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])

"""Text to counts, topic-model updates, co-occurrence theory, tree recovery, simulators and small probability models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.functions.special import digamma, digamma_sql, lgamma_sql, pair_moment
from spindrel.operators.slots import Block, Slots
from spindrel.operators.terms import by_counts
from spindrel.plans.catalog import Catalog, table
from spindrel.plans.dialects import DUCK, both
from spindrel.plans.scratch import drop, freed, save

CATALOG = Catalog()


def q(name):
    return both(CATALOG, name)


# Text


def tokenize(text: Column, filters: tuple = (), transforms: tuple = (), pattern: str = "[a-z]+") -> Column:
    """Array of the tokens of a text in lower case: those that pass every filter (Column -> Column), put through every transform in turn."""
    out = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    for keep in filters:
        out = F.filter(out, keep)
    for change in transforms:
        out = F.transform(out, change)
    return out


def vocabulary(tokens: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """(term, term_id) of (doc_id, pos, term): ids by first appearance; terms of seed (term, term_id) keep their ids and come first.

    The order is over distinct terms, in ranges of 4096 documents, so that no task orders them all.
    """
    first = tokens.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    start = 0
    if seed is not None:
        first = first.join(seed, "term", "left_anti")
        start = (seed.agg(F.max("term_id")).first()[0] or -1) + 1
    part = F.expr("at.doc_id div 4096")
    sizes = first.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = first.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("at", "term"))).join(before, "part")
    out = ranked.select("term", (F.col("before") + F.col("r") - 1 + start).cast("long").alias("term_id"))
    return out if seed is None else seed.select("term", F.col("term_id").cast("long").alias("term_id")).unionByName(out)


def tokens(spark, sf_dir, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), F.posexplode(tokenize(F.col("text"))).alias("pos", "term"))


@CATALOG.query("tokenize", f"SELECT doc_id, count(*) AS n, count(DISTINCT term) AS kinds FROM {DUCK.tok()} GROUP BY doc_id")
def _tokenize(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("kinds"))


STOP = ["the", "and", "of", "to", "in", "le", "la", "de", "der", "die", "und", "el", "los"]


@CATALOG.query("token_filters", f"SELECT doc_id, left(term, 4) AS stem, count(*) AS n FROM {DUCK.tok()} WHERE term NOT IN ({', '.join(repr(w) for w in STOP)}) AND length(term) > 2 GROUP BY ALL")
def _filters(spark, sf_dir):
    words = tokenize(F.col("text"), (lambda t: ~t.isin(STOP), lambda t: F.length(t) > 2), (lambda t: F.substring(t, 1, 4),))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("stem")).groupBy("doc_id", "stem").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query("vocab_first_seen", f"SELECT term, row_number() OVER (ORDER BY doc_id, pos, term) - 1 AS term_id FROM (SELECT term, arg_min(doc_id, doc_id * 1000000 + pos) AS doc_id, min(doc_id * 1000000 + pos) - arg_min(doc_id, doc_id * 1000000 + pos) * 1000000 AS pos FROM {DUCK.tok()} GROUP BY term)")
def _vocab(spark, sf_dir):
    return vocabulary(tokens(spark, sf_dir))


@q("term_counts")
def _(d):
    return f"SELECT doc_id, term, count(*) AS n FROM {d.tok()} t GROUP BY doc_id, term"


@by_counts(CATALOG, "term_doc", lambda parts: f"WITH c AS (SELECT /*+ REPARTITION({parts}, term) */ doc_id, term, n FROM counted_words), v AS (SELECT term FROM c GROUP BY term HAVING count(*) >= 2) SELECT /*+ MERGE(v) */ c.doc_id, c.term, c.n FROM c JOIN v ON c.term = v.term")
def _(d):
    return f"WITH v AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM {d.tok()} a) b GROUP BY term HAVING count(*) >= 2) SELECT t.doc_id, t.term, count(*) AS n FROM {d.tok()} t JOIN v ON t.term = v.term GROUP BY t.doc_id, t.term"


@q("corpus_stats")
def _(d):
    return f"SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang"


@q("bow_parse")
def _(d):
    lines = f"(SELECT doc_id, {d.joined('concat(CAST(k AS ' + d.text + '), ' + chr(39) + ':' + chr(39) + ', CAST(n AS ' + d.text + '))', 'k', ' ')} AS line FROM (SELECT doc_id, length(term) AS k, count(*) AS n FROM {d.tok()} t GROUP BY doc_id, length(term)) x GROUP BY doc_id)"
    if d.text == "STRING":
        return f"SELECT doc_id, CAST(split(p, ':')[0] AS INT) AS idx, sum(CAST(split(p, ':')[1] AS BIGINT)) AS n FROM (SELECT doc_id, explode(split(line, ' ')) AS p FROM {lines}) GROUP BY doc_id, CAST(split(p, ':')[0] AS INT)"
    return f"SELECT doc_id, CAST(split_part(p, ':', 1) AS INT) AS idx, CAST(sum(CAST(split_part(p, ':', 2) AS BIGINT)) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS p FROM {lines}) GROUP BY 1, 2"


@q("pages_text")
def _(d):
    g = "" if d.text == "STRING" else ", 'g'"
    return f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '{g}), '[ ]+', ' '{g})) AS plain FROM pages"


#: Pairs of terms that a task holds and sums up at once before they are handed on.
HELD = 1 << 23


def _summed(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """(i, j, v) with equal pairs summed. Pairs become one number each by places among the terms at hand, so that one plain sort orders pairs and counts together."""
    names, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    bits = max(1, int(len(names) - 1).bit_length())
    key, room = at[: len(i)].astype(np.uint64) << np.uint64(bits) | at[len(i) :].astype(np.uint64), np.uint64(64 - 2 * bits)
    small = v < 1 << min(40, 64 - 2 * bits) if bits < 32 else np.zeros(len(v), bool)
    packed = key[small] << room | v[small].astype(np.uint64)
    packed.sort()
    k = packed >> room if len(packed) else packed
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    sums = np.add.reduceat((packed & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64), first) if len(k) else np.empty(0, np.int64)
    k = k[first]
    out = names[(k >> np.uint64(bits)).astype(np.int64)], names[(k & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1))).astype(np.int64)], sums
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((x, y[~small]))) for x, y in zip(out, (i, j, v))], ["i", "j", "v"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ids, ns) of one document each -> (i, j, v) for i <= j: the products of the counts, n (n - 1) for a term with itself, summed over as many documents as HELD allows."""
    held, size = [], 0
    for batch in batches:
        for ids, ns in zip(batch.column(0), batch.column(1)):
            ids, ns = ids.values.to_numpy(), ns.values.to_numpy()
            order = np.argsort(ids)
            ids, ns = ids[order], ns[order]
            rows = max(1, HELD // (2 * len(ids)))  # rows of the document's matrix at a time
            for a in range(0, len(ids), rows):
                x, y = np.triu_indices(min(rows, len(ids) - a), 0, len(ids) - a)
                held.append((ids[a + x], ids[a + y], ns[a + x] * (ns[a + y] - (x == y))))
                size += len(x)
                if size >= HELD:
                    yield _summed(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
    if held:
        yield _summed(*map(np.concatenate, zip(*held)))


def _half(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((i, j, v) for i <= j over all documents, (id, term, total)) of (doc_id, pos, term); i and j are ids of terms, total the ordered pairs of places that hold the term and another place."""
    counts = save(tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    lengths = counts.groupBy("doc_id").agg(F.sum("n").alias("length"))
    totals = counts.join(lengths, "doc_id").groupBy("term").agg(F.sum(F.expr("n * (length - 1)")).alias("total"))
    terms = save(totals.select(F.monotonically_increasing_id().alias("id"), "term", "total"), "terms")
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the documents are few bytes but much work
    documents = counts.join(terms.select("term", "id"), "term").repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("id", "n")).alias("t")).select(F.col("t.id").alias("ids"), F.col("t.n").alias("ns"))
    return documents.mapInArrow(_pairs, "i long, j long, v long").groupBy("i", "j").agg(F.sum("v").alias("v")), terms


def _mirrored(half: DataFrame) -> DataFrame:
    return half.select(F.explode(F.expr("CASE WHEN i = j THEN array(struct(i, j)) ELSE array(struct(i, j), struct(j AS i, i AS j)) END")).alias("at"), "v").select("at.i", "at.j", "v")


def cooccurrence(tokens: DataFrame) -> DataFrame:
    """(i, j, v, p) over all terms of (doc_id, pos, term): v ordered pairs of places in one document that hold i and j, p their share of those of i.

    A sparse product: each task multiplies out its documents and sums up equal pairs of one half of the symmetric matrix before the shuffle; totals by term come from document lengths. p is null for a term
    that only stands alone.
    """
    half, terms = _half(tokens)
    name = lambda k: terms.select(F.col("id").alias(k), F.col("term").alias(f"{k}_term"))
    both = _mirrored(half).join(terms.select(F.col("id").alias("i"), F.col("term").alias("i_term"), "total"), "i").join(name("j"), "j")
    return both.select(F.col("i_term").alias("i"), F.col("j_term").alias("j"), "v", F.expr("v / nullif(total, 0)").alias("p"))


#: Pairs that a task sums up at once, pairs of a range of terms, and pairs of a wave of ranges.
SUMMED, RANGE, WAVE = 1 << 20, 1 << 20, 1 << 28


def _merged(keys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, v = keys[order], v[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(v, first)


def _range_pairs(batches: Iterator[pa.RecordBatch], cuts: list[int]) -> Iterator[pa.RecordBatch]:
    """Documents (ids in order, ns) -> (part, keys, vs): sums of the pairs i <= j with i in each range between the cuts, keys are i << 32 | j."""
    edges, held, size = np.array(cuts, np.int64) << 32, [], 0

    def flush():
        keys, v = _merged(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))
        at = np.searchsorted(keys, edges)
        for part in np.flatnonzero(np.diff(at)):
            k, x = keys[at[part] : at[part + 1]], v[at[part] : at[part + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["part", "keys", "vs"])

    for batch in batches:
        for ids, ns in zip(batch.column(0), batch.column(1)):
            ids, ns = ids.values.to_numpy(), ns.values.to_numpy()
            a, b = np.searchsorted(ids, (cuts[0], cuts[-1]))
            while a < b:
                many = min(b - a, max(1, SUMMED // (len(ids) - a)))
                x, y = np.triu_indices(many, 0, len(ids) - a)
                held.append((ids[a + x] << 32 | ids[a + y], ns[a + x] * (ns[a + y] - (x == y))))
                size += len(x)
                a += many
                if size >= SUMMED:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def _row_sums(t: pa.Table) -> pa.Table:
    """(id, partners, squares) of a range, each whole pair counted at both its ends."""
    keys, v = _merged(*(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t[k]]) for k in ("keys", "vs")))
    i, j = keys >> 32, keys & 0xFFFFFFFF
    other = i != j
    ends = np.concatenate((i, j[other]))
    names, at = np.unique(ends, return_inverse=True)
    v = np.concatenate((v, v[other]))
    return pa.table([pa.array(names), pa.array(np.bincount(at, v > 0, len(names)).astype(np.int64)), pa.array(np.bincount(at, v.astype(float) ** 2, len(names)))], names=["id", "partners", "squares"])


def cooccurrence_rows(tokens: DataFrame) -> DataFrame:
    """A row for each term, summed over its whole row of cooccurrence: (term, partners, total, norm): terms it stands with, pairs of places, and the length of the row of shares p; null where total is 0.

    Terms are numbered from rare to common and cut into ranges of bounded work; the pairs whose rarer term is in a range meet in one task as packed sums. Ranges go in waves, and a wave's shuffle files go with it.
    """
    spark = tokens.sparkSession
    counts = save(tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    lengths = counts.groupBy("doc_id").agg(F.sum("n").alias("length"))
    totals = counts.join(lengths, "doc_id").groupBy("term").agg(F.sum(F.expr("n * (length - 1)")).alias("total"), F.floor(F.log2(F.count(F.lit(1)).cast("double")) * 4).alias("level"), F.pmod(F.xxhash64("term"), F.lit(64)).alias("deal"))
    totals = save(totals, "term-totals")
    before, start = [], 0
    for r in sorted(totals.groupBy("level", "deal").agg(F.count(F.lit(1)).alias("n")).collect()):  # 64 numbers for each level
        before.append((r["level"], r["deal"], start))
        start += r["n"]
    common = next((x for level, _, x in before if level >= 24), start)  # terms of 64 documents and more go alone
    first = F.broadcast(spark.createDataFrame(before, "level long, deal long, before long"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("level", "deal").orderBy("term")) - 1
    terms = save(totals.join(first, ["level", "deal"]).select(number.alias("id"), "term", "total"), "terms")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # given, as the documents are few bytes but much work
    documents = counts.join(terms.select("term", "id"), "term").repartition(parts, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("t"))
    documents = save(documents.select(F.col("t.id").alias("ids"), F.col("t.n").alias("ns")), "documents")
    work = documents.select(F.size("ids").alias("k"), F.posexplode("ids").alias("pos", "id")).groupBy(F.when(F.col("id") < common, F.expr("id div 64 * 64")).otherwise(F.col("id")).alias("g")).agg(F.sum(F.col("k") - F.col("pos")).alias("pairs"))
    waves, in_range, in_wave, work = [[0, 0]], 0, 0, sorted(work.collect())  # a number for 64 rare terms or a common one
    for r, end in zip(work, [*[r["g"] for r in work[1:]], start]):
        if in_range and in_range + r["pairs"] > RANGE:
            if in_wave > WAVE:
                waves.append([waves[-1][-1]])
                in_wave = 0
            waves[-1].append(waves[-1][-1])
            in_range = 0
        waves[-1][-1] = end
        in_range += r["pairs"]
        in_wave += r["pairs"]
    sums = spark.createDataFrame([], "id long, partners long, squares double")
    read = documents.repartition(4 * parts) if documents.rdd.getNumPartitions() < parts else documents
    for cuts in waves:
        with freed(spark):
            packed = read.mapInArrow(lambda it, cuts=cuts: _range_pairs(it, cuts), "part int, keys binary, vs binary").repartition(max(1, len(cuts) - 1), "part")
            rows = packed.groupBy("part").applyInArrow(_row_sums, "id long, partners long, squares double")
            sums = sums.unionByName(save(rows.groupBy("id").agg(F.sum("partners").alias("partners"), F.sum("squares").alias("squares")), "row-sums"))
    sums = sums.groupBy("id").agg(F.sum("partners").alias("partners"), F.sum("squares").alias("squares"))
    return sums.join(terms, "id").select("term", "partners", "total", F.expr("sqrt(squares) / nullif(total, 0)").alias("norm"))


_ROWS_SQL = f"""WITH c AS (SELECT doc_id, term, count(*) AS n FROM {DUCK.tok()} t GROUP BY ALL),
r AS (SELECT a.term AS i, b.term AS j, sum(CASE WHEN a.term = b.term THEN a.n * (a.n - 1) ELSE a.n * b.n END)::BIGINT AS v FROM c a JOIN c b ON a.doc_id = b.doc_id GROUP BY ALL),
p AS (SELECT i AS term, count(*) FILTER (v > 0) AS partners, sum(v)::BIGINT AS total, round(sqrt(sum(v::DOUBLE * v)) / nullif(sum(v), 0)::DOUBLE, 8) AS norm FROM r GROUP BY i)"""


@CATALOG.query("word_cooccurrence", f"{_ROWS_SQL} SELECT * FROM p")
def _word_cooccurrence(spark, sf_dir):
    """The rows' sums over the whole matrix, which itself has a row for each pair of terms (60 million on sf0.01): cooccurrence returns it."""
    return cooccurrence_rows(tokens(spark, sf_dir)).withColumn("norm", F.round("norm", 8))


@CATALOG.query("anchor_first", f"{_ROWS_SQL} SELECT term, norm FROM p ORDER BY norm DESC NULLS LAST, term LIMIT 1")
def _anchor_first(spark, sf_dir):
    return cooccurrence_rows(tokens(spark, sf_dir)).select("term", F.round("norm", 8).alias("norm")).orderBy(F.desc_nulls_last("norm"), "term").limit(1)


@q("pair_cooccurrence")
def _(d):
    return f"SELECT a, b, count(*) AS n FROM (SELECT doc_id, pos, term AS a, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {d.tok()} t) x WHERE pos % 2 = 0 AND b IS NOT NULL GROUP BY a, b"


@q("topic_word_dist")
def _(d):
    return f"WITH c AS (SELECT lang, term, count(*) + 0.01 AS n FROM {d.tok()} t JOIN documents x ON t.doc_id = x.doc_id GROUP BY lang, term) SELECT lang, term, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE), 9) AS p FROM c"


@q("topic_cooccurrence")
def _(d):
    # topics are languages; a document's shares are those of its words' most frequent languages
    return f"""WITH c AS (SELECT t.term, x.lang, count(*) AS n FROM {d.tok()} t JOIN documents x ON t.doc_id = x.doc_id GROUP BY t.term, x.lang), m AS (SELECT term, lang FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, lang) AS r FROM c) y WHERE r = 1),
    h AS (SELECT doc_id, lang, count(*) AS n FROM {d.tok()} t JOIN m ON t.term = m.term GROUP BY doc_id, lang), p AS (SELECT doc_id, lang, n / CAST(sum(n) OVER (PARTITION BY doc_id) AS DOUBLE) AS p FROM h),
    r AS (SELECT a.lang AS i, b.lang AS j, sum(a.p * b.p) AS v FROM p a JOIN p b ON a.doc_id = b.doc_id GROUP BY a.lang, b.lang) SELECT i, j, round(v / sum(v) OVER (), 8) AS v FROM r"""


# Special functions and Dirichlet statistics


@q("digamma")
def _(d):
    return f"SELECT CAST(i AS BIGINT) AS i, round({digamma_sql('i * CAST(0.25 AS DOUBLE)')}, 8) AS psi FROM {d.seq(80, 1)} s"


@CATALOG.query("lgamma", "SELECT range AS i, round(lgamma(range * 0.25::DOUBLE), 8) AS lg FROM range(1, 80)")
def _lgamma(spark, sf_dir):
    return spark.range(1, 80).selectExpr("id AS i", f"round({lgamma_sql('id * CAST(0.25 AS DOUBLE)')}, 8) AS lg")


@q("elog_dirichlet")
def _(d):
    return f"WITH a AS (SELECT vec_id, pos, 0.5 + abs(x) AS a FROM {d.vec}), s AS (SELECT *, sum(a) OVER (PARTITION BY vec_id) AS s FROM a) SELECT vec_id, pos, round({digamma_sql('a')} - {digamma_sql('s')}, 6) AS e FROM s"


@q("dirichlet_stats")
def _(d):
    return f"WITH a AS (SELECT vec_id, pos, 0.5 + abs(x) AS a FROM {d.vec}), s AS (SELECT *, sum(a) OVER (PARTITION BY vec_id) AS s FROM a) SELECT vec_id, round(sum(pos * a / s), 6) AS mean, round(sqrt(sum(power(a * (s - a) / (s * s * (s + 1)), 2))), 8) AS norm FROM s GROUP BY vec_id"


@q("dirichlet_moments")
def _(d):
    return f"""WITH p AS (SELECT vec_id, label, pos, greatest(x, 0.000001) / sum(greatest(x, 0.000001)) OVER (PARTITION BY vec_id) AS p FROM {d.vec}), m AS (SELECT label, pos, avg(p) AS m1, avg(p * p) AS m2 FROM p GROUP BY label, pos)
    SELECT label, pos, round(m1, 8) AS m1, round(m2, 8) AS m2, round((m1 - m2) / nullif(m2 - m1 * m1, 0), 4) AS s FROM m WHERE pos = 0"""


@q("phi_bound")
def _(d):
    v = d.values("low, high", "(1.0, 8.0), (0.01, 100.0), (0.1, 10.0)")
    return f"SELECT CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, round(CAST(low AS DOUBLE) / ((1 + CAST(high AS DOUBLE)) * (1 + CAST(high AS DOUBLE) + CAST(low AS DOUBLE))), 10) AS phi FROM {v} AS v"


@q("pair_moment")
def _(d):
    a = d.values("k, a", "(0, 1.0), (1, 0.5), (2, 2.5)")
    moment = pair_moment("CAST(x.a AS DOUBLE)", "CAST(y.a AS DOUBLE)", "x.k = y.k", "CAST(4 AS DOUBLE)")
    return f"SELECT x.k AS i, y.k AS j, round({moment}, 8) AS v FROM {a} AS x CROSS JOIN {a} AS y"


@q("stick_lengths")
def _(d):
    return f"WITH b AS (SELECT vec_id, pos, 0.05 + 0.9 / (1 + exp(-x)) AS b FROM {d.vec}) SELECT vec_id, pos, round(b * exp(coalesce(sum(ln(1 - b)) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 10) AS share FROM b"


@q("categorical_draw")
def _(d):
    return f"""WITH p AS (SELECT vec_id, pos, greatest(x, 0) / sum(greatest(x, 0)) OVER (PARTITION BY vec_id) AS p FROM {d.vec}), c AS (SELECT vec_id, pos, sum(p) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM p)
    SELECT vec_id, min(pos) AS k FROM c WHERE c > {d.hu(f'CAST(vec_id AS {d.text})')} GROUP BY vec_id"""


@q("crp_step")
def _(d):
    # chance of each table, and of a new one, for the next guest of each event type
    return "WITH n AS (SELECT event_type, user_id % 10 AS t, count(*) AS n FROM events GROUP BY event_type, user_id % 10) SELECT event_type, t, round(n / (sum(n) OVER (PARTITION BY event_type) + CAST(1.5 AS DOUBLE)), 8) AS p FROM n UNION ALL SELECT event_type, CAST(-1 AS BIGINT), round(1.5 / (sum(n) + CAST(1.5 AS DOUBLE)), 8) FROM n GROUP BY event_type"


# Variational updates: slots are tokens, leaves are four, each leaf has a path of three nodes (root, middle, leaf)


def _slots(d) -> str:
    return f"(SELECT t.doc_id, t.pos, t.term FROM {d.tok('benchmark', 'item_id').replace('item_id, CAST', 'item_id AS doc_id, CAST').replace('SELECT item_id, pos, t[', 'SELECT item_id AS doc_id, pos, t[')} t)"


_LEAVES = "(0, 0, 0), (0, 1, 1), (0, 2, 3), (1, 0, 0), (1, 1, 1), (1, 2, 4), (2, 0, 0), (2, 1, 2), (2, 2, 5), (3, 0, 0), (3, 1, 2), (3, 2, 6)"


def _weight(d, *key: str) -> str:
    """A parameter in (0.5, 1.5) that its key fixes."""
    return f"(0.5 + {d.hu('concat(' + ', '.join(f'''CAST({k} AS {d.text}), ':' ''' for k in key) + ')')})"


def _scores(d, what: str) -> str:
    """Softmax over leaves (L) or depths (D) of a slot, from fixed parameters and a fixed other factor."""
    dv, leaf = _weight(d, "'v'", "node", "term"), d.values("leaf, depth, node", _LEAVES)
    if what == "L":
        e = f"SELECT doc_id, pos, k, {digamma_sql('w')} + e AS e FROM (SELECT doc_id, pos, leaf AS k, max({_weight(d, chr(39) + 'l' + chr(39), 'doc_id', 'leaf')}) AS w, sum(ln({dv}) / 3) AS e FROM {_slots(d)} s CROSS JOIN {leaf} AS l GROUP BY doc_id, pos, leaf) y"
    else:
        e = f"SELECT doc_id, pos, k, {digamma_sql('w')} + e AS e FROM (SELECT doc_id, pos, depth AS k, max({_weight(d, chr(39) + 'd' + chr(39), 'doc_id', 'depth')}) AS w, sum(ln({dv}) / 4) AS e FROM {_slots(d)} s CROSS JOIN {leaf} AS l GROUP BY doc_id, pos, depth) y"
    return f"(SELECT doc_id, pos, k, x / sum(x) OVER (PARTITION BY doc_id, pos) AS p FROM (SELECT doc_id, pos, k, exp(e - max(e) OVER (PARTITION BY doc_id, pos)) AS x FROM ({e}) z) u)"


@q("vi_update_L")
def _(d):
    return f"SELECT doc_id, pos, k AS leaf, round(p, 8) AS p FROM {_scores(d, 'L')} r"


@q("vi_update_D")
def _(d):
    return f"SELECT doc_id, pos, k AS depth, round(p, 8) AS p FROM {_scores(d, 'D')} r"


@q("vi_update_DL")
def _(d):
    return f"SELECT doc_id, k AS leaf, round(1 + sum(p), 6) AS v FROM {_scores(d, 'L')} r GROUP BY doc_id, k"


@q("scatter_add")
def _(d):
    return f"SELECT k AS leaf, term, round(sum(p), 6) AS v FROM {_scores(d, 'L')} r JOIN {_slots(d)} s ON r.doc_id = s.doc_id AND r.pos = s.pos GROUP BY k, term"


@q("vi_update_DV")
def _(d):
    leaf = d.values("leaf, depth, node", _LEAVES)
    return f"SELECT node, term, round(0.1 + sum(l.p * x.p), 6) AS v FROM {_scores(d, 'L')} l JOIN {_scores(d, 'D')} x ON l.doc_id = x.doc_id AND l.pos = x.pos JOIN {leaf} AS t ON t.leaf = l.k AND t.depth = x.k JOIN {_slots(d)} s ON s.doc_id = l.doc_id AND s.pos = l.pos GROUP BY node, term"


@q("svi_step")
def _(d):
    # step 3 of a stochastic fit: old value and the scaled batch sum meet at rate (t + 1) ** -0.5
    leaf = "SELECT k AS leaf, term, sum(p) AS v FROM {l} r JOIN {s} s ON r.doc_id = s.doc_id AND r.pos = s.pos WHERE r.doc_id % 2 = 0 GROUP BY k, term".format(l=_scores(d, "L"), s=_slots(d))
    return f"SELECT leaf, term, round((1 - power(CAST(4 AS DOUBLE), -0.5)) * {_weight(d, chr(39) + 'o' + chr(39), 'leaf', 'term')} + power(CAST(4 AS DOUBLE), -0.5) * (0.1 + 2 * v), 6) AS v FROM ({leaf}) b"


@q("elbo_terms")
def _(d):
    return f"SELECT doc_id, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 6) AS entropy FROM {_scores(d, 'L')} r GROUP BY doc_id"


@q("gibbs_conditional")
def _(d):
    # collapsed conditional of each word of a document over languages as topics: (alpha + n_dk) (beta + n_wk) / (V beta + n_k)
    return f"""WITH w AS (SELECT term, lang, count(*) AS n FROM {d.tok()} t JOIN documents x ON t.doc_id = x.doc_id GROUP BY term, lang), k AS (SELECT lang, sum(n) AS n FROM w GROUP BY lang), v AS (SELECT count(DISTINCT term) AS v FROM w), s AS (SELECT DISTINCT doc_id, term FROM {_slots(d)} b),
    e AS (SELECT s.doc_id, s.term, k.lang, 0.5 * (0.1 + coalesce(w.n, 0)) / (v * CAST(0.1 AS DOUBLE) + k.n) AS p FROM s CROSS JOIN k CROSS JOIN v LEFT JOIN w ON w.term = s.term AND w.lang = k.lang)
    SELECT doc_id, term, lang, round(p / sum(p) OVER (PARTITION BY doc_id, term), 6) AS p FROM e"""


@q("gmm_estep")
def _(d):
    m = d.values("k, m, s", "(0, 20.0, 10.0), (1, 50.0, 15.0), (2, 100.0, 30.0)")
    return f"WITH e AS (SELECT event_id, k, -(value - CAST(m AS DOUBLE)) * (value - CAST(m AS DOUBLE)) / (2 * CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) - ln(CAST(s AS DOUBLE)) AS e FROM events CROSS JOIN {m} AS m), x AS (SELECT event_id, k, exp(e - max(e) OVER (PARTITION BY event_id)) AS x FROM e) SELECT event_id, k, round(x / sum(x) OVER (PARTITION BY event_id), 8) AS p FROM x"


@q("gmm_mstep")
def _(d):
    m = d.values("k, m, s", "(0, 20.0, 10.0), (1, 50.0, 15.0), (2, 100.0, 30.0)")
    return f"WITH e AS (SELECT event_id, value, k, -(value - CAST(m AS DOUBLE)) * (value - CAST(m AS DOUBLE)) / (2 * CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) - ln(CAST(s AS DOUBLE)) AS e FROM events CROSS JOIN {m} AS m), x AS (SELECT event_id, value, k, exp(e - max(e) OVER (PARTITION BY event_id)) AS x FROM e), p AS (SELECT value, k, x / sum(x) OVER (PARTITION BY event_id) AS p FROM x) SELECT k, round(sum(p), 4) AS n, round(sum(p * value) / sum(p), 6) AS m, round(sum(p * value * value) / sum(p) - power(sum(p * value) / sum(p), 2), 4) AS v FROM p GROUP BY k"


@q("leaves_to_hierarchy")
def _(d):
    # what all class means share goes to the root; the rest of each, brought to sum 1, stays
    return f"WITH m AS (SELECT label, pos, avg(greatest(x, 0)) AS p FROM {d.vec} GROUP BY label, pos), r AS (SELECT pos, min(p) AS r FROM m GROUP BY pos) SELECT label, m.pos, round((p - r) / sum(p - r) OVER (PARTITION BY label), 7) AS p FROM m JOIN r ON m.pos = r.pos"


@q("topic_l1_matrix")
def _(d):
    return f"WITH m AS (SELECT label, pos, avg(greatest(x, 0)) AS p FROM {d.vec} GROUP BY label, pos) SELECT a.label AS i, b.label AS j, round(sum(abs(a.p - b.p)) / 2, 7) AS l1 FROM m a JOIN m b ON a.pos = b.pos GROUP BY a.label, b.label"


# Co-occurrence theory


_R = "(0, 0, 0.30), (0, 1, 0.20), (0, 2, 0.05), (0, 3, 0.05), (1, 0, 0.20), (1, 1, 0.30), (1, 2, 0.05), (1, 3, 0.05), (2, 0, 0.05), (2, 1, 0.05), (2, 2, 0.30), (2, 3, 0.22), (3, 0, 0.05), (3, 1, 0.05), (3, 2, 0.22), (3, 3, 0.30)"


@q("ratio_matrix")
def _(d):
    r = d.values("i, j, v", _R)
    return f"WITH r AS (SELECT i, j, CAST(v AS DOUBLE) / sum(CAST(v AS DOUBLE)) OVER () AS v FROM {r} AS r), p AS (SELECT i, sum(v) AS p FROM r GROUP BY i) SELECT r.i, r.j, round(v, 8) AS joint, round(v / a.p, 8) AS conditional, round(v - a.p * b.p, 8) AS covariance, round(v / (a.p * b.p), 8) AS ratio FROM r JOIN p a ON a.i = r.i JOIN p b ON b.i = r.j"


@q("triplet_constraints")
def _(d):
    r = d.values("i, j, v", _R)
    return f"SELECT a.i, a.j, b.j AS k, round(CAST(a.v AS DOUBLE) - greatest(CAST(b.v AS DOUBLE), CAST(c.v AS DOUBLE)), 6) AS strength FROM {r} AS a JOIN {r} AS b ON a.i = b.i AND b.j <> a.i AND b.j <> a.j JOIN {r} AS c ON c.i = a.j AND c.j = b.j WHERE a.i > a.j AND a.v > b.v + 0.01 AND a.v > c.v + 0.01"


@q("min_offdiag_gap")
def _(d):
    r = d.values("i, j, v", _R)
    return f"SELECT round(min(gap), 6) AS gap FROM (SELECT lead(v) OVER (ORDER BY v) - v AS gap FROM (SELECT DISTINCT CAST(v AS DOUBLE) AS v FROM {r} AS r WHERE i <> j) x) y"


@q("permute_matrix")
def _(d):
    r, p = d.values("i, j, v", _R), d.values("a, b", "(0, 2), (1, 0), (2, 3), (3, 1)")
    return f"SELECT p.b AS i, s.b AS j, round(CAST(v AS DOUBLE), 4) AS v FROM {r} AS r JOIN {p} AS p ON p.a = r.i JOIN {p} AS s ON s.a = r.j"


@q("greedy_root")
def _(d):
    r = d.values("i, j, v", _R)
    return f"SELECT i, round(avg(CAST(v AS DOUBLE)), 6) AS m FROM {r} AS r GROUP BY i ORDER BY m DESC, i LIMIT 1"


@q("tree_constraints")
def _(d):
    n = d.values("leaf", "('LLL'), ('LLR'), ('LR'), ('RL'), ('RR')")
    common = lambda a, b: "CASE " + " ".join(f"WHEN substr({a}, 1, {k}) = substr({b}, 1, {k}) AND length({a}) >= {k} AND length({b}) >= {k} THEN {k}" for k in (3, 2, 1)) + " ELSE 0 END"
    return f"SELECT a.leaf AS i, b.leaf AS j, c.leaf AS k FROM {n} AS a JOIN {n} AS b ON a.leaf < b.leaf JOIN {n} AS c ON c.leaf <> a.leaf AND c.leaf <> b.leaf WHERE {common('a.leaf', 'b.leaf')} > {common('a.leaf', 'c.leaf')}"


@q("lca_check")
def _(d):
    n = d.values("leaf", "('LLL'), ('LLR'), ('LR'), ('RL'), ('RR')")
    return f"SELECT a.leaf AS a, b.leaf AS b, max(substr(a.leaf, 1, CAST(s.i AS INT))) AS lca FROM {n} AS a JOIN {n} AS b ON a.leaf < b.leaf JOIN {d.seq(4)} s ON s.i <= length(a.leaf) AND substr(a.leaf, 1, CAST(s.i AS INT)) = substr(b.leaf, 1, CAST(s.i AS INT)) GROUP BY a.leaf, b.leaf"


@q("edge_alphas")
def _(d):
    e = d.values("parent, child, alpha", "(0, 1, 1.0), (0, 2, 2.0), (1, 3, 0.5), (1, 4, 0.5), (2, 5, 1.5), (2, 6, 1.0)")
    return f"SELECT parent, child, round(CAST(alpha AS DOUBLE) / (1 + sum(CAST(alpha AS DOUBLE)) OVER (PARTITION BY parent)), 8) AS share FROM {e} AS e"


def _combos(d, leaves_only: bool) -> str:
    """Probability that two draws of one Polya urn tree end in two given leaves, by where their paths part."""
    e = d.values("leaf, mid, a, b", "(3, 1, 1.0, 0.5), (4, 1, 1.0, 0.5), (5, 2, 2.0, 1.5), (6, 2, 2.0, 1.0)")
    mids = "CASE x.mid WHEN 1 THEN 1.0 ELSE 2.5 END"
    root = "CAST(x.a AS DOUBLE) / 3 * CASE WHEN x.mid = y.mid THEN (CAST(y.a AS DOUBLE) + 1) / 4 ELSE CAST(y.a AS DOUBLE) / 4 END"
    low = f"CAST(x.b AS DOUBLE) / {mids} * CASE WHEN x.mid <> y.mid THEN CAST(y.b AS DOUBLE) / CASE y.mid WHEN 1 THEN 1.0 ELSE 2.5 END WHEN x.leaf = y.leaf THEN (CAST(y.b AS DOUBLE) + 1) / ({mids} + 1) ELSE CAST(y.b AS DOUBLE) / ({mids} + 1) END"
    return f"(SELECT x.leaf AS i, y.leaf AS j, {root} * {low} AS p FROM {e} AS x CROSS JOIN {e} AS y)"


@q("combo_prob")
def _(d):
    return f"SELECT i, j, round(CAST(p AS DOUBLE), 8) AS p FROM {_combos(d, True)} c"


@q("combo_tensor")
def _(d):
    # with the exit at the root: a path stops there with weight 1 beside the edges' 3
    return f"SELECT i, j, round(CAST(p AS DOUBLE) * 9 / 20, 8) AS p FROM {_combos(d, False)} c"


@q("combo_tensor_pam")
def _(d):
    return f"SELECT i, round(CAST(sum(p) AS DOUBLE), 8) AS p FROM {_combos(d, True)} c GROUP BY i"


@q("shtm_cooccurrence")
def _(d):
    # nodes r, s meet when leaves below them and their depths do: pair moments over leaves (4 of 1) and depths (3 of 1)
    leaf = d.values("leaf, depth, node", _LEAVES)
    l, k = pair_moment("CAST(1 AS DOUBLE)", "CAST(1 AS DOUBLE)", "a.leaf = b.leaf", "CAST(4 AS DOUBLE)"), pair_moment("CAST(1 AS DOUBLE)", "CAST(1 AS DOUBLE)", "a.depth = b.depth", "CAST(3 AS DOUBLE)")
    return f"SELECT a.node AS i, b.node AS j, round(sum({l} * {k}), 8) AS p FROM {leaf} AS a CROSS JOIN {leaf} AS b GROUP BY a.node, b.node"


@q("separation_diagnosis")
def _(d):
    r = d.values("i, j, v", _R)
    return f"SELECT a.i, a.j, round(min(CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE)), 6) AS least FROM {r} AS a JOIN {r} AS b ON a.i = b.i AND b.j <> a.i AND b.j <> a.j WHERE a.i < a.j GROUP BY a.i, a.j"


@q("alpha_from_R")
def _(d):
    # a symmetric pair under one node: with p = (1/2, 1/2), E[p_i p_j] = a / (2 (2 a + 1)) gives a = 2 m / (1 - 4 m)
    return f"SELECT CAST(i AS BIGINT) AS n, round(2 * m / (1 - 4 * m), 8) AS a FROM (SELECT i, (i * CAST(0.5 AS DOUBLE)) / (2 * (2 * (i * CAST(0.5 AS DOUBLE)) + 1)) AS m FROM {d.seq(10, 1)} s) x"


# Simulators and probability models


@q("heavy_words")
def _(d):
    return f"SELECT CAST(k.i AS BIGINT) AS topic, CAST(w.i AS BIGINT) AS word, CASE WHEN {d.div('w.i', 10)} = k.i THEN CAST(0.09 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) / 90 END AS p FROM {d.seq(10)} k CROSS JOIN {d.seq(100)} w"


@q("node_distrib")
def _(d):
    leaf = d.values("leaf, depth, node", _LEAVES)
    return f"SELECT node, round(count(*) / CAST(12 AS DOUBLE), 8) AS p FROM {leaf} AS l GROUP BY node"


@q("gs_topics")
def _(d):
    # words are cells of a 5 x 5 grid; topics are its rows and columns
    return f"SELECT CAST(k.i AS BIGINT) AS topic, CAST(w.i AS BIGINT) AS word, CAST(0.2 AS DOUBLE) AS p FROM {d.seq(10)} k JOIN {d.seq(25)} w ON (k.i < 5 AND {d.div('w.i', 5)} = k.i) OR (k.i >= 5 AND w.i % 5 = k.i - 5)"


@q("ensure_anchor_words")
def _(d):
    h = f"(SELECT k.i AS topic, w.i AS word, CASE WHEN w.i < 5 AND w.i <> k.i THEN CAST(0 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) + {d.hu(f'''concat(CAST(k.i AS {d.text}), ':', CAST(w.i AS {d.text}))''')} END AS p FROM {d.seq(5)} k CROSS JOIN {d.seq(40)} w)"
    return f"SELECT CAST(topic AS BIGINT) AS topic, CAST(word AS BIGINT) AS word, round(p / sum(p) OVER (PARTITION BY topic), 8) AS p FROM {h} x"


_RAIN, _SPRINKLER, _WET = "(1, 0.2), (0, 0.8)", "(1, 1, 0.01), (1, 0, 0.99), (0, 1, 0.4), (0, 0, 0.6)", "(0, 0, 1, 0.0), (0, 0, 0, 1.0), (1, 0, 1, 0.9), (1, 0, 0, 0.1), (0, 1, 1, 0.8), (0, 1, 0, 0.2), (1, 1, 1, 0.99), (1, 1, 0, 0.01)"


def _joint(d) -> str:
    return f"(SELECT a.r, b.s, c.w, CAST(a.p AS DOUBLE) * CAST(b.p AS DOUBLE) * CAST(c.p AS DOUBLE) AS p FROM {d.values('r, p', _RAIN)} AS a JOIN {d.values('r, s, p', _SPRINKLER)} AS b ON a.r = b.r JOIN {d.values('s, r, w, p', _WET)} AS c ON c.s = b.s AND c.r = a.r)"


@q("bayes_query")
def _(d):
    return f"SELECT r AS rain, round(sum(CASE WHEN w = 1 THEN p ELSE 0 END) / max(e), 8) AS p FROM {_joint(d)} j CROSS JOIN (SELECT nullif(sum(p), 0) AS e FROM {_joint(d)} k WHERE w = 1) x GROUP BY r"


@q("factor_query")
def _(d):
    return f"SELECT s AS sprinkler, round(sum(p) / (SELECT sum(p) FROM {_joint(d)} k WHERE r = 0), 8) AS p FROM {_joint(d)} j WHERE r = 0 GROUP BY s"


# Whole fits (their steps have SQL above)


#: Documents from which on a sampler goes place by place through all of them at once, and below which one by one.
TOGETHER = 24


def _sampled(block, z: np.ndarray, nw: np.ndarray, n: np.ndarray, v: int, alpha: float, beta: float, seed: int, sweep: int) -> np.ndarray:
    """The topics of a block's slots, drawn anew; each document goes by its own generator and counts, whatever stands beside it."""
    topics, draws = len(n), np.empty(len(z))
    for i, a, k in zip(block.ids, block.starts, block.lengths):
        draws[a : a + k] = np.random.default_rng([seed, sweep, int(i) & 0xFFFFFFFF]).random(k)
    nd = np.stack([np.bincount(block.document, z == t, len(block.lengths)) for t in range(topics)], 1)
    order = np.argsort(-block.lengths, kind="stable")
    starts, lengths, nd, z = block.starts[order], block.lengths[order], nd[order], z.copy()
    words, below, rows = beta + nw, v * beta + n, np.arange(len(order))
    i = 0
    while (active := int(np.searchsorted(-lengths, -i, "left"))) and (active >= TOGETHER or topics >= 8):
        at, own = starts[:active] + i, rows[:active]
        nd[own, z[at]] -= 1
        p = (alpha + nd[:active]) * words[block.at[at]] / below
        new = np.minimum((np.cumsum(p, 1) < (draws[at] * p.sum(1))[:, None]).sum(1), topics - 1)
        z[at] = new
        nd[own, new] += 1
        i += 1
    from bisect import bisect_left

    low = below.tolist()
    for k in range(active):
        at = slice(int(starts[k]) + i, int(starts[k] + lengths[k]))
        own, old, out = nd[k].tolist(), z[at].tolist(), []
        for t, u, w in zip(old, draws[at].tolist(), words[block.at[at]].tolist()):
            own[t] -= 1
            run, sums = 0.0, []
            for j in range(topics):
                run += (alpha + own[j]) * w[j] / low[j]
                sums.append(run)
            t = min(bisect_left(sums, u * run), topics - 1)
            out.append(t)
            own[t] += 1
        z[at] = out
    return z


def collapsed_gibbs(tokens: DataFrame, topics: int, sweeps: int = 5, alpha: float = 0.5, beta: float = 0.1, seed: int = 0) -> DataFrame:
    """(doc_id, pos, term, topic) after some sweeps of collapsed Gibbs sampling; tokens: (doc_id, pos, term).

    A sweep holds the topic-word counts of the sweep before and samples each document by itself, so blocks of documents go in parallel; a block meets the counts of its own terms.
    """
    count = lambda block, z: block.summed(np.eye(topics)[z])
    topic = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "pos"), F.lit(topics)).cast("int")
    slots = Slots(tokens, {"topic": topic}, lambda block, x: ([x[0]], count(block, x[0])))
    v = slots.terms.count()
    for sweep in range(sweeps):
        words = save(slots.sums(topics), "gibbs-words")
        totals = np.array([x or 0.0 for x in words.agg(*[F.sum(F.col("n")[k]) for k in range(topics)]).first()])  # a number for each topic

        def change(block, x, sweep=sweep, totals=totals):
            z = _sampled(block, block.kept[0].astype(int), x, totals, v, alpha, beta, seed, sweep)
            return [z], count(block, z), []

        before = slots.step(words.withColumnRenamed("n", "x"), change, "gibbs")
        drop(words, *([before] if sweep else []))
    return slots.rows("topic int", lambda block: [block.kept[0].astype(np.int32)])


@CATALOG.query("lda_collapsed_gibbs")
def _gibbs(spark, sf_dir):
    t = tokens(spark, sf_dir).select(F.col("doc_id").cast("long"), F.col("pos").cast("long"), "term")
    return collapsed_gibbs(t, 4)


class SimpleHierarchicalTopicModel:
    """Mean-field fit of a topic tree: each slot has a leaf and a depth, and the node on the leaf's path at that depth draws its word.

    ``paths`` lists the node of each (leaf, depth). What is known of slots and documents lies in blocks, what is known of words in tables; an epoch is one meeting of both, and its tables are written.
    The tables of an epoch that isn't the last are gone once the next has ended.
    """

    def __init__(self, paths: list[list[int]], dl: float = 1.0, dd: float = 1.0, dv: float = 0.1, seed: int = 0) -> None:
        self.paths, self.dl, self.dd, self.dv, self.seed = paths, dl, dd, dv, seed

    def fit(self, slots: DataFrame, epochs: int = 3, start: Callable[[Column, Column], Column] | None = None, after: Callable[[int, dict], bool] | None = None) -> DataFrame:
        """(node, term, val): the words' weights of each node; slots: (doc_id, pos, term).

        ``start`` gives what a (node, term) weighs at first beside the prior, numbers hashed from both if it isn't given; ``after`` sees each epoch's number and tables and stops the fit by
        True. ``history`` has a row of numbers for each epoch: the mass of each node and the mean entropy of the documents' leaf shares.
        """
        nodes = sorted({n for p in self.paths for n in p})
        place = np.array([[nodes.index(n) for n in p] for p in self.paths])
        uniform = lambda *key: (F.pmod(F.xxhash64(F.lit(self.seed), *key), F.lit(1 << 20)) / (1 << 20))
        # slots of one document that hold the same word begin alike and so stay alike: one of them stands for all, with their number
        kinds = slots.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("many")).withColumn("pos", F.lit(0))
        (leaves, depths), prior_l, prior_d = place.shape, self.dl, self.dd  # tasks get numbers, not this fit with its tables

        def first(block, x):
            n = len(block.lengths)
            return [x[0], np.full((len(x[0]), leaves), 1 / leaves), np.full((len(x[0]), depths), 1 / depths), np.full((n, leaves), prior_l), np.full((n, depths), prior_d)], np.zeros((block.terms, len(nodes)))

        def change(block, e):
            many, _, d, dl, dd = (x.reshape(-1, k) for x, k in zip(block.kept, (1, leaves, depths, leaves, depths)))
            elog = lambda x: digamma(x, np.log) - digamma(x.sum(1, keepdims=True), np.log)

            def soft(x):
                x = np.exp(x - x.max(1, keepdims=True))
                return x / x.sum(1, keepdims=True)

            word = [[e[block.at, place[a, k]] for k in range(depths)] for a in range(leaves)]
            l = soft(np.stack([sum(d[:, k] * word[a][k] for k in range(depths)) for a in range(leaves)], 1) + elog(dl)[block.document])
            d = soft(np.stack([sum(l[:, a] * word[a][k] for a in range(leaves)) for k in range(depths)], 1) + elog(dd)[block.document])
            dl, dd = prior_l + block.by_document(many * l), prior_d + block.by_document(many * d)
            seen = np.zeros((len(d), len(nodes)))
            for a in range(leaves):
                for k in range(depths):
                    seen[:, place[a, k]] += many[:, 0] * l[:, a] * d[:, k]
            share = dl / dl.sum(1, keepdims=True)
            return [many, l, d, dl, dd], block.summed(seen), [float((-share * np.log(share)).sum()), float(len(dl))]

        state = Slots(kinds, {"many": F.col("many")}, first)
        self.history: list[dict] = []
        begin = [(self.dv + (start or uniform)(F.lit(n), F.col("term"))).cast("double") for n in nodes]
        dv = save(state.terms.select("term", F.array(*begin).alias("val")), "dv")
        for epoch in range(epochs):
            total = dv.agg(*[F.sum(F.col("val")[k]) for k in range(len(nodes))]).first()  # a number for each node
            elog = F.array(*[digamma(F.col("val")[k]) - (digamma(F.lit(float(x)))) for k, x in enumerate(total)]) if total[0] is not None else F.col("val")
            before = state.step(dv.select("term", elog.alias("x")), change, "shtm")
            last, dv = dv, save(state.sums(len(nodes)).select("term", F.transform("n", lambda x: self.dv + x).alias("val")), "dv")
            drop(last, *([before] if epoch else []))
            mass = dv.agg(*[F.sum(F.col("val")[k]) for k in range(len(nodes))]).first()
            entropy = state.work.agg(F.sum(F.col("stats")[0]) / F.sum(F.col("stats")[1])).first()[0]
            self.history.append({"epoch": epoch, "mass": {n: x for n, x in zip(nodes, mass) if x is not None}, "entropy": entropy})
            tables = self._tables(state, slots, dv, nodes, leaves, depths)
            self.leaf_shares, self.slot_leaves, self.slot_depths = tables["dl"], tables["l"], tables["d"]
            if after is not None and after(epoch, tables):
                break
        return self._values(dv, nodes)

    def _values(self, dv: DataFrame, nodes: list[int]) -> DataFrame:
        return dv.select(F.explode(F.arrays_zip(F.array(*map(F.lit, nodes)).alias("node"), F.col("val").alias("val"))).alias("x"), "term").select("x.node", "term", "x.val")

    def _tables(self, state: Slots, slots: DataFrame, dv: DataFrame, nodes: list[int], leaves: int, depths: int) -> dict[str, DataFrame]:
        """An epoch's tables by name, read from its blocks when they are asked for."""

        def by_slot(k: int, size: int, name: str) -> DataFrame:
            known = state.rows("p array<double>", lambda block: [pa.ListArray.from_arrays(np.arange(0, block.kept[k].size + 1, size, dtype=np.int32), block.kept[k])])
            known = known.select(F.col("doc_id").alias("own"), F.col("term").alias("word"), F.posexplode("p").alias(name, "p"))
            return slots.join(known, slots["doc_id"].eqNullSafe(F.col("own")) & (slots["term"] == F.col("word"))).select(slots["doc_id"], "pos", slots["term"], name, "p")

        def by_document(k: int, size: int, name: str) -> DataFrame:
            def unpack(batches):
                for batch in batches:
                    for i in range(batch.num_rows):
                        block = Block(pa.Table.from_batches([batch.slice(i, 1)]), 0)
                        n = len(block.lengths)
                        yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values.take(pa.array(np.repeat(np.arange(n), size))), pa.array(np.tile(np.arange(size, dtype=np.int32), n)), pa.array(block.kept[k])], ["doc_id", name, "val"])

            return state.work.drop("stats").mapInArrow(unpack, f"doc_id {state.kinds['doc_id']}, {name} int, val double")

        return {"dv": self._values(dv, nodes), "dl": by_document(3, leaves, "leaf"), "dd": by_document(4, depths, "depth"), "l": by_slot(1, leaves, "leaf"), "d": by_slot(2, depths, "depth")}


@CATALOG.query("shtm_fit")
def _shtm(spark, sf_dir):
    return SimpleHierarchicalTopicModel([[0, 1, 3], [0, 1, 4], [0, 2, 5], [0, 2, 6]]).fit(tokens(spark, sf_dir))


def build_tree(leaves: list[int], triplets: list[tuple[int, int, int]]) -> tuple | None:
    """Nested tuples of a tree in which each (i, j, k) has i and j meet below where k joins them; None if none exists. The items are few (topics)."""
    if len(leaves) <= 2:
        return tuple(sorted(leaves)) if len(leaves) > 1 else leaves[0]
    own = [t for t in triplets if set(t) <= set(leaves)]
    if not own:
        return tuple(sorted(leaves))
    label = {x: x for x in leaves}
    for i, j, _ in own:
        a, b = label[i], label[j]
        label = {x: min(a, b) if y in (a, b) else y for x, y in label.items()}
    groups = sorted({y: sorted(x for x in leaves if label[x] == y) for y in label.values()}.values())
    if len(groups) == 1:
        return None
    parts = [build_tree(g, own) for g in groups]
    return None if any(p is None for p in parts) else tuple(parts)


def extract_tree(leaves: list[int], ranked: list[tuple[int, int, int]]) -> tuple[tuple, int]:
    """The tree of the longest prefix of ranked constraints that has one, by bisection, and that prefix's length."""
    low, high = 0, len(ranked)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if build_tree(leaves, ranked[:mid]) is not None else (low, mid - 1)
    return build_tree(leaves, ranked[:low]), low


@CATALOG.query("aho_step")
def _aho(spark, sf_dir):
    rows = CATALOG.queries["triplet_constraints"](spark, sf_dir).orderBy(F.desc("strength"), "i", "j", "k").collect()  # constraints among few topics
    tree, used = extract_tree([0, 1, 2, 3], [(r["i"], r["j"], r["k"]) for r in rows])
    return spark.createDataFrame([(str(tree), used)], "tree string, used int")

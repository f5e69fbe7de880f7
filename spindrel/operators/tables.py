"""Scans, projections, filters, samples, joins, grouped and ordered computations over tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrel.operators.terms import by_counts
from spindrel.plans.catalog import Catalog, table
from spindrel.plans.dialects import both

CATALOG = Catalog()


def q(name):
    return both(CATALOG, name)


@q("cast_filter_scan")
def _(d):
    return f"SELECT CAST(o_orderkey AS {d.text}) AS key, CAST(o_totalprice AS {d.text}) AS price, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'"


@q("column_slice")
def _(d):
    return "SELECT l_suppkey, l_linenumber, l_quantity FROM lineitem"


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names the regular expression matches from their start, in their order; none is an error."""
    names = [c for c in df.columns if re.match(pattern, c)]
    if not names:
        raise ValueError(f"no column matches {pattern}")
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])


@CATALOG.query("regex_project", "SELECT p_name, p_size FROM part")
def _columns_like(spark, sf_dir):
    return columns_like(table(spark, sf_dir, "part"), "p_(name|size)")


@q("range_filter")
def _(d):
    return "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 50"


@q("wide_to_long")
def _(d):
    wide = "SELECT s_suppkey AS shot, s_acctbal AS wavelength_240_5, s_acctbal * 2 AS wavelength_241_0, s_nationkey * 1.0 AS wavelength_241_5 FROM supplier"
    if d.text == "STRING":
        return f"SELECT shot, CAST(regexp_replace(regexp_extract(name, 'wavelength_([0-9_]+)', 1), '_', '.') AS DOUBLE) AS wavelength, round(CAST(y AS DOUBLE), 4) AS y FROM (SELECT shot, CAST(wavelength_240_5 AS DOUBLE) AS wavelength_240_5, CAST(wavelength_241_0 AS DOUBLE) AS wavelength_241_0, CAST(wavelength_241_5 AS DOUBLE) AS wavelength_241_5 FROM ({wide})) UNPIVOT (y FOR name IN (wavelength_240_5, wavelength_241_0, wavelength_241_5))"
    return f"SELECT shot, replace(regexp_extract(name, 'wavelength_([0-9_]+)', 1), '_', '.')::DOUBLE AS wavelength, round(y, 4) AS y FROM (UNPIVOT (SELECT shot, wavelength_240_5::DOUBLE AS wavelength_240_5, wavelength_241_0::DOUBLE AS wavelength_241_0, wavelength_241_5::DOUBLE AS wavelength_241_5 FROM ({wide})) ON wavelength_240_5, wavelength_241_0, wavelength_241_5 INTO NAME name VALUE y)"


@q("spectrum_gaps")
def _(d):
    return f"""WITH p AS (SELECT vec_id, pos * CASE WHEN pos > 31 THEN 3 ELSE 1 END AS x, x AS y FROM {d.vec}),
    g AS (SELECT *, x - lag(x) OVER (PARTITION BY vec_id ORDER BY x) AS gap FROM p)
    SELECT vec_id, CAST(x AS DOUBLE) AS x, round(y, 6) AS y FROM g UNION ALL SELECT vec_id, x - gap / CAST(2 AS DOUBLE), CAST(NULL AS DOUBLE) FROM g WHERE gap > 2"""


@q("transpose_shots")
def _(d):
    # places become rows, the mean spectrum of each class a column, beside a constant one
    cells = ", ".join(f"round(avg(CASE WHEN label = {i} THEN x END), 6) AS shot_{i}" for i in range(10))
    return f"SELECT pos, 'a' AS sensor, {cells} FROM {d.vec} GROUP BY pos"


@q("l1_normalize")
def _(d):
    return f"SELECT vec_id, pos, round(greatest(x, 0) / nullif(sum(greatest(x, 0)) OVER (PARTITION BY vec_id), 0), 6) AS y FROM {d.vec}"


@q("zscore")
def _(d):
    return f"WITH m AS (SELECT pos, avg(x) AS a, stddev_pop(x) AS s FROM {d.vec} GROUP BY pos) SELECT vec_id, v.pos, round((x - a) / nullif(s, 0), 6) AS z FROM {d.vec} v JOIN m ON v.pos = m.pos"


@q("ordinal_encode")
def _(d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return "SELECT event_id, CAST(CASE event_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds)) + " ELSE -1 END AS INT) AS code FROM events"


@q("threshold_points")
def _(d):
    return f"SELECT pos, count(*) AS n FROM {d.vec} WHERE x >= 0.1 GROUP BY pos"


@q("nonempty_docs")
def _(d):
    return f"SELECT DISTINCT doc_id FROM {d.tok()}"


@q("bernoulli_sample")
def _(d):
    return f"SELECT o_orderkey FROM orders WHERE {d.hu(f'CAST(o_orderkey AS {d.text})')} < 0.05"


@q("sample_k")
def _(d):
    return f"SELECT o_orderkey FROM orders ORDER BY md5(concat('k:', CAST(o_orderkey AS {d.text}))), o_orderkey LIMIT 100"


@q("shuffle_rank")
def _(d):
    # places in a random order: a place within one of 256 hash ranges, after all places of the ranges before
    h = f"md5(concat('p:', CAST(doc_id AS {d.text})))"
    return f"""WITH h AS (SELECT doc_id, {h} AS h, substr({h}, 1, 2) AS part FROM documents), c AS (SELECT part, count(*) AS n FROM h GROUP BY part),
    b AS (SELECT part, sum(n) OVER (ORDER BY part) - n AS b FROM c)
    SELECT doc_id, CAST(b + row_number() OVER (PARTITION BY h.part ORDER BY h, doc_id) AS BIGINT) AS place FROM h JOIN b ON h.part = b.part"""


@q("minibatches")
def _(d):
    h = f"md5(concat('e1:', CAST(doc_id AS {d.text})))"
    return f"""WITH h AS (SELECT doc_id, {h} AS h, substr({h}, 1, 2) AS part FROM documents), c AS (SELECT part, count(*) AS n FROM h GROUP BY part),
    b AS (SELECT part, sum(n) OVER (ORDER BY part) - n AS b FROM c), r AS (SELECT doc_id, b + row_number() OVER (PARTITION BY h.part ORDER BY h, doc_id) - 1 AS r FROM h JOIN b ON h.part = b.part)
    SELECT doc_id, CAST({d.div('r', 64)} AS BIGINT) AS batch FROM r"""


CENTERS = "0, 0.0), (1, 15.0), (2, 40.0), (3, 63.0"


@q("reduce_dim")
def _(d):
    c = d.values("c, center", f"({CENTERS})")
    near = f"(SELECT p.i AS pos, c FROM (SELECT i, c, row_number() OVER (PARTITION BY i ORDER BY abs(i - center), c) AS r FROM {d.seq(64)} CROSS JOIN {c} AS k) p WHERE r = 1)"
    return f"SELECT vec_id, c, round(sum(x), 6) AS y FROM {d.vec} v JOIN {near} n ON v.pos = n.pos GROUP BY vec_id, c"


@q("nearest_center")
def _(d):
    c = d.values("c, center", f"({CENTERS})")
    return f"SELECT CAST(i AS BIGINT) AS pos, CAST(c AS INT) AS c, center, concat('wavelength_', CAST(CAST(center AS INT) AS {d.text})) AS name FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(i - center), c) AS r FROM (SELECT i, c, CAST(center AS DOUBLE) AS center FROM {d.seq(64)} CROSS JOIN {c} AS k) AS x) AS y WHERE r = 1"


@q("proportional_bins")
def _(d):
    c = d.values("c, center", "(0, 5.0), (1, 15.0), (2, 40.0)")
    return f"""WITH k AS (SELECT c, CAST(center AS DOUBLE) AS lo, lead(CAST(center AS DOUBLE)) OVER (ORDER BY center) AS hi FROM {c} AS k),
    w AS (SELECT i, c, 1 - (i - lo) / (hi - lo) AS w FROM {d.seq(64)} JOIN k ON i >= lo AND i < hi UNION ALL SELECT i, c + 1, (i - lo) / (hi - lo) FROM {d.seq(64)} JOIN k ON i >= lo AND i < hi
      UNION ALL SELECT i, 0, 1.0 FROM {d.seq(64)} WHERE i < 5 UNION ALL SELECT i, 2, 1.0 FROM {d.seq(64)} WHERE i >= 40)
    SELECT CAST(i AS BIGINT) AS pos, CAST(c AS INT) AS c, round(CAST(w AS DOUBLE), 6) AS share FROM w WHERE w > 0"""


@q("discretize")
def _(d):
    c = d.values("c, center", f"({CENTERS})")
    near = f"(SELECT p.i AS pos, c FROM (SELECT i, c, row_number() OVER (PARTITION BY i ORDER BY abs(i - center), c) AS r FROM {d.seq(64)} CROSS JOIN {c} AS k) p WHERE r = 1)"
    return f"SELECT label, c, round(sum(greatest(x, 0)), 4) AS y FROM {d.vec} v JOIN {near} n ON v.pos = n.pos GROUP BY label, c"


LINES = "(10.0, 'A'), (20.0, 'A'), (20.0, 'B'), (30.0, 'C'), (35.0, 'D')"


@q("band_join")
def _(d):
    # closed band of 0.25 about each line: rows and lines meet in cells as wide as the band
    l = d.values("w, elt", LINES)
    cells = f"(SELECT elt, w, CAST(floor(w / 0.25) AS BIGINT) + i - 1 AS cell FROM {l} AS l CROSS JOIN {d.seq(3)} AS s)"
    return f"SELECT event_id, elt, CAST(w AS DOUBLE) AS w FROM (SELECT event_id, value, CAST(floor(value / 0.25) AS BIGINT) AS cell FROM events) e JOIN {cells} c ON e.cell = c.cell WHERE abs(value - w) <= 0.25"


@q("band_counts")
def _(d):
    return "SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_retailprice RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS near FROM part"


@q("grid_band_groups")
def _(d):
    l = d.values("w, elt", LINES)
    return f"SELECT CAST(i AS BIGINT) AS x, elt, count(DISTINCT w) AS lines FROM {d.seq(40, 5)} g JOIN {l} AS l ON abs(w - i) < 1.5 GROUP BY i, elt"


@q("filter_groups_by_fraction")
def _(d):
    l = d.values("w, elt", LINES)
    cells = f"(SELECT elt, w, CAST(floor(w / 0.25) AS BIGINT) + i - 1 AS cell FROM {l} AS l CROSS JOIN {d.seq(3)} AS s)"
    hit = f"(SELECT DISTINCT elt, w FROM (SELECT value, CAST(floor(value / 0.25) AS BIGINT) AS cell FROM events) e JOIN {cells} c ON e.cell = c.cell WHERE abs(value - w) <= 0.25)"
    return f"SELECT l.elt, round(avg(CASE WHEN h.w IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END), 6) AS share FROM {l} AS l LEFT JOIN {hit} h ON l.elt = h.elt AND l.w = h.w GROUP BY l.elt HAVING avg(CASE WHEN h.w IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) >= 0.5"


@q("ledger_antijoin")
def _(d):
    day = "date_format(ts, 'yyyy-MM-dd')" if d.text == "STRING" else "strftime(ts, '%Y-%m-%d')"
    return f"SELECT e.event_id FROM (SELECT event_id, {day} AS day FROM events) e LEFT JOIN (SELECT day FROM (SELECT DISTINCT {day} AS day FROM events) x WHERE substr(md5(day), 1, 1) < '8') l ON e.day = l.day WHERE l.day IS NULL"


@q("relation_diff")
def _(d):
    a, b = "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'", "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'"
    return f"SELECT s, p, 'only_a' AS side FROM (({a}) EXCEPT ({b})) AS x UNION ALL SELECT s, p, 'only_b' FROM (({b}) EXCEPT ({a})) AS y"


@q("column_quantiles")
def _(d):
    qs = [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1]
    return f"SELECT pos, sum(CASE WHEN x < 0 THEN 1 ELSE 0 END) * CAST(1 AS BIGINT) AS negatives, " .replace("sum(CASE WHEN x < 0 THEN 1 ELSE 0 END) * CAST(1 AS BIGINT)", "count(CASE WHEN x < 0 THEN 1 END)") + ", ".join(f"round({d.quantile('x', v)}, 6) AS q{i}" for i, v in enumerate(qs)) + f" FROM {d.vec} GROUP BY pos"


@q("lower_median")
def _(d):
    return f"SELECT o_orderpriority, {d.lower_quantile('o_totalprice', 0.5)} AS m FROM orders GROUP BY o_orderpriority"


@q("select_rank")
def _(d):
    return "SELECT o_orderpriority, o_totalprice FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r FROM orders) x WHERE r = 6"


@q("select_quantile")
def _(d):
    # the three rank rules: round(n a), floor(n a) - 1, floor(n a), each held within 0 and n - 1
    ranks = ", ".join(f"least(greatest({e}, 0), n - 1) AS r{i}" for i, e in enumerate(("CAST(round(n * 0.3) AS BIGINT)", "CAST(floor(n * 0.3) AS BIGINT) - 1", "CAST(floor(n * 0.3) AS BIGINT)")))
    return f"""WITH r AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), w AS (SELECT *, {ranks} FROM r)
    SELECT l_suppkey, max(CASE WHEN k = r0 THEN x END) AS by_round, max(CASE WHEN k = r1 THEN x END) AS by_floor_less_1, max(CASE WHEN k = r2 THEN x END) AS by_floor FROM w GROUP BY l_suppkey"""


@q("group_mean_std")
def _(d):
    return "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type"


@q("confusion_matrix")
def _(d):
    return "SELECT lang, count(CASE WHEN quality = 0 THEN 1 END) AS bad, count(CASE WHEN quality = 1 THEN 1 END) AS good FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang"


@q("marginals")
def _(d):
    return f"SELECT pos, round(sum(x), 5) AS total, count(CASE WHEN x > 0 THEN 1 END) AS prevalence FROM {d.vec} GROUP BY pos"


@q("cumsum")
def _(d):
    return f"SELECT vec_id, pos, round(sum(x) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS s FROM {d.vec}"


@q("wavelength_deltas")
def _(d):
    # first difference; the first row takes the second's, a gap of more than 1 takes the difference before it
    return f"""WITH p AS (SELECT vec_id, pos * 0.5 + CASE WHEN pos > 31 THEN 7 ELSE 0 END AS w, pos FROM {d.vec}), a AS (SELECT *, w - lag(w) OVER (PARTITION BY vec_id ORDER BY pos) AS e, lead(w) OVER (PARTITION BY vec_id ORDER BY pos) - w AS f FROM p),
    b AS (SELECT vec_id, pos, coalesce(e, f) AS e FROM a) SELECT vec_id, pos, CAST(CASE WHEN e > 1 THEN lag(e) OVER (PARTITION BY vec_id ORDER BY pos) ELSE e END AS DOUBLE) AS delta FROM b"""


@q("local_maxima")
def _(d):
    return f"""WITH n AS (SELECT vec_id, pos, x, lag(x) OVER (PARTITION BY vec_id ORDER BY pos) AS a, lead(x) OVER (PARTITION BY vec_id ORDER BY pos) AS b, max(x) OVER (PARTITION BY vec_id) AS m FROM {d.vec})
    SELECT vec_id, pos, round(x, 6) AS x FROM n WHERE x > a AND x > b AND x > 0.5 * m"""


@q("softmax")
def _(d):
    return f"WITH e AS (SELECT vec_id, pos, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM {d.vec}) SELECT vec_id, pos, round(e / sum(e) OVER (PARTITION BY vec_id), 8) AS p FROM e"


@by_counts(CATALOG, "word_slots", lambda parts: "SELECT doc_id, term, first AS first_slot, n FROM counted_words")
def _(d):
    return f"WITH n AS (SELECT doc_id, term, count(*) AS n FROM {d.tok()} GROUP BY doc_id, term), b AS (SELECT doc_id, term, n, sum(n) OVER (PARTITION BY doc_id ORDER BY term) - n AS first FROM n) SELECT doc_id, term, CAST(first AS BIGINT) AS first_slot, n FROM b"


@q("sort_by")
def _(d):
    return "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey"


@q("top_words")
def _(d):
    return f"SELECT lang, term, n FROM (SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM (SELECT lang, term, count(*) AS n FROM {d.tok()} t JOIN documents d ON d.doc_id = t.doc_id GROUP BY lang, term) a) b WHERE r <= 10"


@q("mask_top_k")
def _(d):
    return f"SELECT vec_id, pos, round(x, 6) AS x FROM {d.vec} ORDER BY x DESC, vec_id, pos LIMIT 200"


@q("map_assignment")
def _(d):
    return f"SELECT vec_id, pos FROM (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS r FROM {d.vec}) a WHERE r = 1"


@q("union_samples")
def _(d):
    return " UNION ALL ".join(f"SELECT o_orderkey, {i} AS chunk FROM orders WHERE {d.hu(f'''concat('{i}:', CAST(o_orderkey AS {d.text}))''')} < 0.05" for i in range(3))


@q("set_ops")
def _(d):
    a, b = "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'"
    return f"SELECT k, 'both' AS part FROM (({a}) INTERSECT ({b})) AS x UNION ALL SELECT k, 'less' FROM (({a}) EXCEPT ({b})) AS y UNION ALL SELECT k, 'any' FROM (({a}) UNION ({b})) AS z"


@q("set_cover_greedy_step")
def _(d):
    # one greedy step: the supplier with most parts that supplier 1 doesn't cover; ties go to the lowest
    return "WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), u AS (SELECT s.* FROM s LEFT JOIN (SELECT p FROM s WHERE s = 1) c ON s.p = c.p WHERE c.p IS NULL) SELECT s, count(*) AS gain FROM u GROUP BY s ORDER BY gain DESC, s LIMIT 1"


@q("filename_parse")
def _(d):
    return f"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, lpad(CAST(page_id AS {d.text}), 8, '0') AS padded, regexp_replace(url, '[0-9]', '#'{'' if d.text == 'STRING' else ', ' + chr(39) + 'g' + chr(39)}) AS masked FROM pages"


def json_text(c: Column, sort: bool = True) -> Column:
    """A map as JSON text, its keys sorted so that equal maps give equal texts; null stays null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))) if sort else c)


@CATALOG.query("json_roundtrip", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN props IS NULL THEN NULL ELSE '{"event_type":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '"}' END AS written FROM events""")
def _json(spark, sf_dir):
    read = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return read.select("event_id", F.col("m")["k"].cast("long").alias("k"), json_text(F.map_concat("m", F.create_map(F.lit("event_type"), "event_type"))).alias("written"))


@q("exceeds_n")
def _(d):
    return "SELECT count(*) > 1000 AS exceeds FROM (SELECT 1 AS one FROM orders LIMIT 1001) x"


@q("num_representatives")
def _(d):
    return "SELECT l_suppkey, CAST(CASE WHEN count(*) < 500 THEN count(*) ELSE ceil(500 + 5 * power(count(*) - 500, 1.0 / 3)) END AS BIGINT) AS k FROM lineitem GROUP BY l_suppkey"


@q("entropy_rank")
def _(d):
    return f"""WITH p AS (SELECT vec_id, greatest(x, 0) / nullif(sum(greatest(x, 0)) OVER (PARTITION BY vec_id), 0) AS p FROM {d.vec}), h AS (SELECT vec_id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS h FROM p GROUP BY vec_id)
    SELECT vec_id, h, CAST(row_number() OVER (PARTITION BY {d.div('vec_id', 100)} ORDER BY h, vec_id) AS BIGINT) AS place FROM h"""


@q("uniform_centers")
def _(d):
    return f"WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT CAST(i AS BIGINT) AS i, round(a + (b - a) * i / 49, 4) AS center FROM r CROSS JOIN {d.seq(50)} AS s"


@q("q1_pricing_summary")
def _(d):
    return "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"


@q("q3_open_orders")
def _(d):
    return "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10"


@q("grouping_cube")
def _(d):
    return "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) * 2 AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)".replace("grouping(l_returnflag) + grouping(l_linestatus) * 2", "CAST(grouping(l_returnflag) + grouping(l_linestatus) * 2 AS INT)")


@q("session_windows")
def _(d):
    gap = "unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER w AS TIMESTAMP)) > 1800000000" if d.text == "STRING" else "epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000"
    return f"WITH g AS (SELECT user_id, event_id, ts, CASE WHEN {gap} THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g) SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n FROM s GROUP BY user_id, s"

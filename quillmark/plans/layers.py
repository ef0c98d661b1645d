"""Queries of page geometry, layered scores and dated documents; the driver's tables stand in for pages and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, geometry, resume
from .catalogue import query, t, values

# --- pages: an order is a page, its lines are words ------------------------------------------------------------------

_WORDS = "w AS (SELECT l_orderkey AS page, concat(l_returnflag, l_linenumber, '-', l_partkey) AS text, l_quantity AS x0, l_quantity + l_discount * 50 AS x1, l_suppkey % 20 * 1.5 AS top, l_suppkey % 20 * 1.5 + 2 AS bottom FROM lineitem)"
_BOXES = "b AS (SELECT l_orderkey AS page, l_quantity - 5 AS x0, l_quantity + 10 AS x1, 3.0 AS top, 20.0 AS bottom FROM lineitem WHERE l_linenumber = 1)"


def _words(spark, sf):
    top = F.col("l_suppkey") % 20 * 1.5
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat("l_returnflag", "l_linenumber", F.lit("-"), "l_partkey").alias("text"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + F.col("l_discount") * 50).alias("x1"), top.alias("top"), (top + 2).alias("bottom"))


def _boxes(spark, sf):
    first = t(spark, sf, "lineitem").where("l_linenumber = 1")
    return first.select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") - 5).alias("x0"), (F.col("l_quantity") + 10).alias("x1"), F.lit(3.0).alias("top"), F.lit(20.0).alias("bottom"))


@query("page_word_lines", f"WITH {_WORDS}, s AS (SELECT *, CASE WHEN top - lag(top) OVER o > 3 THEN 1 ELSE 0 END AS opens FROM w WINDOW o AS (PARTITION BY page ORDER BY top, x0, text)), n AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS line_no FROM s) SELECT page, CAST(line_no AS BIGINT) AS line_no, string_agg(text, ' ' ORDER BY x0, top, text) AS line FROM n GROUP BY page, line_no")
def page_word_lines(spark, sf):
    return geometry.text_lines(_words(spark, sf), ["page"])


@query("words_outside_boxes", f"WITH {_WORDS}, {_BOXES} SELECT page, count(*) AS n_outside, max(text) AS last_text FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN b.x0 AND b.x1 AND (w.top + w.bottom) / 2 BETWEEN b.top AND b.bottom) GROUP BY page")
def words_outside_boxes(spark, sf):
    return geometry.outside(_words(spark, sf), _boxes(spark, sf), ["page"]).groupBy("page").agg(F.count("*").alias("n_outside"), F.max("text").alias("last_text"))


def _islands(src: str) -> str:
    return f"(SELECT page, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(nw) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT page, x0, x1, CASE WHEN max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= x0 THEN 0 ELSE 1 END AS nw FROM {src} WHERE x1 > x0)) GROUP BY page, isl)"


def _split(src: str) -> str:
    return f"(SELECT page, (x0 + e) / 2 AS split FROM (SELECT *, lag(x1) OVER (PARTITION BY page ORDER BY x0) AS e FROM {_islands(src)}) WHERE x0 - e >= 8 AND (x0 + e) / 2 BETWEEN 6 AND 54 QUALIFY row_number() OVER (PARTITION BY page ORDER BY x0 - e DESC, x0 + e) = 1)"


@query("page_ink_width", f"WITH {_WORDS} SELECT page, round(sum(x1 - x0), 4) AS union_length FROM {_islands('w')} GROUP BY page")
def page_ink_width(spark, sf):
    return geometry.union_length(_words(spark, sf), ["page"], "x0", "x1").withColumn("union_length", F.round("union_length", 4))


@query("page_gutters", f"WITH {_WORDS}, z AS (SELECT * FROM w WHERE NOT (x0 < 30 AND x1 > 30)) SELECT o_orderkey AS page, round(coalesce(a.split, c.split, 30.0), 4) AS split, a.split IS NOT NULL OR c.split IS NOT NULL AS found FROM orders LEFT JOIN {_split('w')} a ON a.page = o_orderkey LEFT JOIN {_split('z')} c ON c.page = o_orderkey")
def page_gutters(spark, sf):
    pages = t(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.lit(60.0).alias("width"))
    return geometry.gutter(_words(spark, sf), pages, ["page"], 8.0).withColumn("split", F.round("split", 4))


@query("page_columns", """WITH b AS (SELECT l_orderkey AS page, CAST(l_partkey % 2 * 40 + 2 AS DOUBLE) AS x0, CAST(l_partkey % 2 * 40 + 2 + l_quantity * 0.6 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0, CAST(l_suppkey * 7 % 700 + 40 AS DOUBLE) AS y1 FROM lineitem),
pg AS (SELECT page, g, 80.0 * g / 100 AS x FROM (SELECT page FROM b GROUP BY page HAVING count(*) >= 4), (SELECT unnest(range(25, 76, 2)) AS g)),
j AS (SELECT b.*, g, x FROM b JOIN pg USING (page)),
cr AS (SELECT page, g, y0, y1, max(y1) OVER (PARTITION BY page, g ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM j WHERE x0 < x AND x1 > x),
isl AS (SELECT page, g, min(y0) AS y0, max(y1) AS y1 FROM (SELECT *, sum(CASE WHEN reach IS NULL OR y0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY page, g ORDER BY y0, y1) AS k FROM cr) GROUP BY page, g, k),
band AS (SELECT pg.page, pg.g, 0.0 AS lo, coalesce(min(isl.y0), 800.0) AS hi FROM pg LEFT JOIN isl USING (page, g) GROUP BY ALL UNION ALL SELECT page, g, y1, coalesce(lead(y0) OVER (PARTITION BY page, g ORDER BY y0), 800.0) FROM isl),
s AS (SELECT j.*, lo, hi, CASE WHEN x1 <= x THEN 'left' ELSE 'right' END AS side FROM j JOIN band USING (page, g) WHERE hi > lo AND (x1 <= x OR x0 >= x) AND y1 > lo AND y0 < hi),
c AS (SELECT *, greatest(y0, lo) AS a, least(y1, hi) AS z, max(x1) OVER (PARTITION BY page, g, lo, hi, side) AS edge, max(least(y1, hi)) OVER (PARTITION BY page, g, lo, hi, side ORDER BY greatest(y0, lo), least(y1, hi) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
k AS (SELECT page, g, lo, hi, side, count(*) AS n, avg(CASE WHEN edge - x1 <= 2 THEN 1.0 ELSE 0.0 END) AS flush, max(x1 - x0) AS wide, sum(greatest(0.0, z - greatest(a, coalesce(reach, a)))) AS cover FROM c GROUP BY ALL),
good AS (SELECT * FROM k WHERE n >= 3 AND cover >= 40 AND NOT (side = 'right' AND flush >= 0.8 AND wide < 24)),
yes AS (SELECT DISTINCT page FROM (SELECT page, g, lo, hi FROM good GROUP BY ALL HAVING count(*) = 2))
SELECT o_orderkey AS page, o_orderkey IN (SELECT page FROM yes) AS columns FROM orders""")
def page_columns(spark, sf):
    li = t(spark, sf, "lineitem")
    boxes = li.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 2 * 40 + 2).cast("double").alias("x0"), (F.col("l_partkey") % 2 * 40 + 2 + F.col("l_quantity") * 0.6).alias("x1"), (F.col("l_suppkey") * 7 % 700).cast("double").alias("y0"), (F.col("l_suppkey") * 7 % 700 + 40).cast("double").alias("y1"))
    pages = t(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.lit(80.0).alias("width"), F.lit(800.0).alias("height"))
    return geometry.has_columns(boxes, pages, ["page"])


@query("margin_lines", "SELECT l_orderkey AS doc, lower(l_returnflag || ' ' || l_linestatus) AS line, count(DISTINCT l_linenumber) AS n_pages FROM lineitem WHERE l_quantity > 46 OR l_quantity + 2 < 4 GROUP BY ALL HAVING count(DISTINCT l_linenumber) >= 2")
def margin_lines(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.concat_ws("  ", "l_returnflag", "l_linestatus").alias("text"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 2).alias("y1"))
    return geometry.repeated_margin_lines(li, li.select("doc", "page").distinct().withColumn("height", F.lit(50.0)), "doc", "page")


# --- layered scores ---------------------------------------------------------------------------------------------------

_PLATFORMS = ["workday", "successfactors", "taleo", "greenhouse", None]
_NAMED = ", ".join(f"'{h}'" for h in resume.HEADERS)


@query("doc_format_findings", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE doc_id % 5 WHEN 0 THEN 'workday' WHEN 1 THEN 'successfactors' WHEN 2 THEN 'taleo' WHEN 3 THEN 'greenhouse' ELSE 'unknown' END AS p FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM d),
f AS (SELECT doc_id, 'MULTI_COLUMN_LAYOUT' AS code, CASE WHEN p IN ('successfactors', 'taleo', 'greenhouse') THEN 'high_attention' ELSE 'warning' END AS severity FROM l WHERE len(list_filter(x, lambda y: length(y) < 40)) >= 3 AND len(list_filter(x, lambda y: length(y) > 80)) >= 2
 UNION ALL SELECT doc_id, 'NON_STANDARD_SKILLS_HEADER', 'warning' FROM l WHERE p = 'successfactors' AND NOT list_contains(list_transform(x, lambda y: lower(y)), 'skills')
 UNION ALL SELECT doc_id, 'CUSTOM_SECTION_HEADERS', 'warning' FROM l WHERE len(list_filter(x, lambda y: y LIKE '%:' AND length(trim(rtrim(y, ':'))) BETWEEN 1 AND 50 AND lower(trim(rtrim(y, ':'))) NOT IN ({_NAMED}))) > 0
 UNION ALL SELECT doc_id, 'EM_DASH_DETECTED', 'warning' FROM l WHERE contains(t, '—')
 UNION ALL SELECT doc_id, 'FILE_FORMAT_ADVISORY', 'info' FROM l WHERE p = 'taleo')
SELECT code, severity, count(*) AS n, min(doc_id) AS first_doc FROM f GROUP BY ALL""")
def doc_format_findings(spark, sf):
    platform = F.get(F.array(*[F.lit(p) for p in _PLATFORMS]), (F.col("doc_id") % 5).cast("int"))
    found = resume.format_findings(F.col("text"), text.lines(F.col("text")), platform, F.lit(False))
    each = t(spark, sf, "documents").select("doc_id", F.inline(found))
    return each.groupBy("code", "severity").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


_ROLES = ["the", "der und", "house of", "de la"]
_TW = "list_filter(list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')), lambda w: w NOT IN ('a', 'an', 'and', 'the', 'of', 'for', 'in', 'to', 'at'))"


@query("doc_title_match", f"""WITH d AS (SELECT doc_id, role, split_part(coalesce(text, ''), chr(10), 1) AS h, array_to_string(string_split(coalesce(text, ''), chr(10))[2:], chr(10)) AS s FROM documents, {values([(r,) for r in _ROLES], 'role')}),
m AS (SELECT *, '(^|[^\\p{{L}}\\p{{N}}_])' || role || '($|[^\\p{{L}}\\p{{N}}_])' AS p FROM d)
SELECT doc_id, role, CAST(CASE WHEN regexp_matches(lower(h), p) THEN 100 WHEN regexp_matches(lower(s), p) THEN 75 ELSE round_even(coalesce(len(list_intersect({_TW.format('role')}, {_TW.format('h')})) / nullif(len({_TW.format('role')}), 0), 0) * 50, 1) END AS DOUBLE) AS title_match FROM m""")
def doc_title_match(spark, sf):
    # the first line is the headline, all others the summary
    whole = F.coalesce("text", F.lit(""))
    d = t(spark, sf, "documents").select("doc_id", F.substring_index(whole, "\n", 1).alias("h"), F.array_join(F.slice(F.split(whole, "\n"), 2, 1 << 30), "\n").alias("s"), F.explode(F.array(*[F.lit(r) for r in _ROLES])).alias("role"))
    return d.select("doc_id", "role", resume.title_match(F.col("role"), F.col("h"), F.col("s")).alias("title_match"))


@query("date_style_share", """WITH c AS (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%b %Y') ELSE strftime(o_orderdate, '%Y') END AS k, o_orderkey % 4 AS style FROM orders),
n AS (SELECT o_custkey, style, count(*) AS n FROM c GROUP BY ALL) SELECT o_custkey, CASE WHEN sum(n) >= 2 THEN round_even(100.0 * max(n) / sum(n), 1) END AS consistency FROM n GROUP BY o_custkey""")
def date_style_share(spark, sf):
    form = F.col("o_orderkey") % 4
    one = F.when(form == 0, F.date_format("o_orderdate", "yyyy-MM")).when(form == 1, F.date_format("o_orderdate", "MM/yyyy")).when(form == 2, F.date_format("o_orderdate", "MMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy"))
    texts = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(one), "; ").alias("dates"))
    return texts.select("o_custkey", resume.date_consistency(F.col("dates")).alias("consistency"))


@query("service_scores", """WITH c AS (SELECT o_custkey, CAST(count(*) * 3 AS INTEGER) AS months, count(DISTINCT o_orderpriority) AS vessels, count(DISTINCT o_orderstatus) AS held FROM orders GROUP BY o_custkey),
r AS (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'chief officer' WHEN 1 THEN 'third officer' ELSE 'unknown' END AS rank, CASE o_custkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 12 ELSE 6 END AS least FROM c),
b AS (SELECT *, least(20, CASE WHEN months >= 3 * least THEN 8 WHEN months >= 2 * least THEN 5 WHEN months >= least THEN 2 ELSE 0 END + least(vessels, 4) + CASE WHEN held = 3 THEN 4 ELSE 0 END + CASE WHEN rank = 'chief officer' THEN 4 ELSE 0 END) AS bonus FROM r),
s AS (SELECT *, CAST(floor(held * 25 / 3) + CASE WHEN months >= least THEN 20 ELSE floor(months * 20 / least) END + 10 + CASE WHEN rank <> 'unknown' THEN 10 ELSE 0 END + bonus AS INTEGER) AS score FROM b)
SELECT o_custkey, score, CASE WHEN score >= 55 THEN 'STRONG' WHEN score >= 35 THEN 'ADEQUATE' ELSE 'WEAK' END AS grade, CAST(bonus AS INTEGER) AS bonus, held || '/3' AS coverage FROM s""")
def service_scores(spark, sf):
    c = t(spark, sf, "orders").groupBy("o_custkey").agg((F.count("*") * 3).cast("int").alias("months"), F.collect_set("o_orderpriority").alias("vessels"), F.collect_set("o_orderstatus").alias("held"))
    pick = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), (F.col("o_custkey") % 3).cast("int"))
    s = resume.service_score(pick("chief officer", "third officer", "unknown"), F.array(*[F.lit(x) for x in "FOP"]), F.col("held"), F.col("months"), pick(24, 12, 6), F.col("vessels"))
    return c.select("o_custkey", s.alias("s")).select("o_custkey", "s.score", "s.grade", "s.bonus", "s.coverage")


@query("rewrite_verdicts", """WITH k AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w, length(coalesce(text, '')) AS score FROM conversations),
p AS (SELECT conv_id, turn, w AS new, score AS after, lag(w) OVER o AS old, lag(score) OVER o AS before FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT *, len(list_filter(new, lambda x: NOT list_contains(old, x))) AS added, len(list_filter(old, lambda x: NOT list_contains(new, x))) AS removed FROM p)
SELECT conv_id, turn, CASE WHEN before IS NULL THEN NULL WHEN added > 0 THEN 'factual_integrity_risk' WHEN after < before OR removed > 0 THEN 'degraded' WHEN after > before THEN 'improved' ELSE 'neutral' END AS verdict FROM f""")
def rewrite_verdicts(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    k = t(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(text.tokens(F.col("text"))).alias("new"), F.length(F.coalesce("text", F.lit(""))).alias("after"))
    p = k.withColumn("old", F.lag("new").over(w)).withColumn("before", F.lag("after").over(w))
    return p.select("conv_id", "turn", resume.rewrite_verdict(F.col("before"), F.col("after"), F.array_except("new", "old"), F.array_except("old", "new")).alias("verdict"))


# --- dated documents --------------------------------------------------------------------------------------------------

_CERTS = [("urgent", "1-urgent"), ("urgent", "urgent"), ("high", "2-high"), ("medium", "3-medium")]


@query("certificate_lines", """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders),
f AS (SELECT o_custkey, lower(substr(o_orderpriority, 3)) AS certificate, arg_min(o_orderkey, o_orderkey) AS k, arg_min(d, o_orderkey) AS d FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL),
e AS (SELECT *, CASE k % 3 WHEN 0 THEN last_day(d) WHEN 1 THEN d END AS expiry FROM f)
SELECT o_custkey, certificate, CAST(expiry AS VARCHAR) AS expiry_date, CAST(CASE k % 3 WHEN 2 THEN d END AS VARCHAR) AS issue_date,
 CASE WHEN k % 3 = 2 THEN 'EXPIRY_UNKNOWN' WHEN expiry < DATE '1998-01-01' THEN 'EXPIRED' WHEN date_diff('day', DATE '1998-01-01', expiry) <= 183 THEN 'EXPIRING_SOON' ELSE 'VALID' END AS status FROM e""")
def certificate_lines(spark, sf):
    form = F.col("o_orderkey") % 3
    dated = F.when(form == 0, F.concat(F.lit("expires "), F.date_format("o_orderdate", "MM/yyyy"))).when(form == 1, F.concat(F.lit("valid until "), F.date_format("o_orderdate", "dd/MM/yyyy"))).otherwise(F.concat(F.lit("issued "), F.date_format("o_orderdate", "d-M-yyyy")))
    line = F.concat_ws(" ", "o_orderpriority", dated)
    docs = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))
    found = documents.certificate_validity(docs, "o_custkey", "text", spark.createDataFrame(_CERTS, "certificate string, alias string"), F.lit("1998-01-01").cast("date"))
    return found.select("o_custkey", "certificate", F.col("expiry_date").cast("string").alias("expiry_date"), F.col("issue_date").cast("string").alias("issue_date"), "status")


@query("sailing_records", """WITH s AS (SELECT l_orderkey AS book, l_linenumber AS page_number, CASE l_returnflag WHEN 'A' THEN 'second officer' WHEN 'N' THEN 'third officer' END AS rank, 'Star ' || l_suppkey AS vessel, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_partkey % 2 = 0 THEN 0.95 ELSE 0.7 END AS confidence FROM lineitem),
e AS (SELECT *, CAST(date_trunc('month', d) AS DATE) AS sign_on, CAST(d + 90 AS DATE) AS sign_off FROM s)
SELECT book, CAST(page_number AS INTEGER) AS page_number, rank, vessel, CAST(sign_on AS VARCHAR) AS sign_on, CAST(sign_off AS VARCHAR) AS sign_off, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY book ORDER BY sign_off DESC, page_number, coalesce(rank, 'passenger'), vessel) = 1 AS is_last FROM e""")
def sailing_records(spark, sf):
    rank = F.when(F.col("l_returnflag") == "A", "Second Officer").when(F.col("l_returnflag") == "N", "Third Officer").otherwise("Passenger")
    body = F.concat(rank, F.lit("\nMV Star "), F.col("l_suppkey").cast("string"), F.lit("\n"), F.date_format("l_shipdate", "MM/yyyy"), F.lit(" - "), F.date_format(F.date_add("l_shipdate", 90), "dd/MM/yyyy"))
    # rank and vessel stand in the line before the dates
    body = F.regexp_replace(body, r"\n(MV)", ", $1")
    pages = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").cast("int").alias("page_number"), body.alias("raw_text"), F.when(F.col("l_partkey") % 2 == 0, "text").otherwise("ocr").alias("method"))
    out = documents.sailings(pages, "book", ["second officer", "third officer"], F.lit("2024-01-01").cast("date"))
    return out.select("book", "page_number", "rank", "vessel", F.col("sign_on").cast("string").alias("sign_on"), F.col("sign_off").cast("string").alias("sign_off"), F.col("confidence").cast("double").alias("confidence"), "is_last")

"""Queries of field extraction, repair and lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import records
from .catalogue import query, t, values

_KEYWORDS = [(c, d, k) for c, d, terms in [("acme", "deck", ["the", "of the", "released under"]), ("acme", "engine", ["der", "die und", "das", "von"]), ("other", "deck", ["de la", "et"])] for k in terms]


@query("keyword_scores", f"""WITH k AS (SELECT * FROM {values(_KEYWORDS, 'company, department, keyword')}),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') || ' ' AS x FROM documents),
n AS (SELECT company, department, count(*) AS n FROM k GROUP BY ALL)
SELECT doc_id, company, department, string_agg(keyword, '|' ORDER BY keyword) AS matches, CAST(least(100, round_even(150.0 * count(*) / any_value(n), 1)) AS DOUBLE) AS score
FROM d JOIN k ON contains(x, ' ' || keyword || ' ') JOIN n USING (company, department) GROUP BY doc_id, company, department""")
def keyword_scores(spark, sf):
    kw = spark.createDataFrame(_KEYWORDS, "company string, department string, keyword string")
    found = records.keyword_scores(t(spark, sf, "documents"), "doc_id", "text", F.broadcast(kw), ["company", "department"], 1.5, 2)
    return found.select("doc_id", "company", "department", F.array_join("matches", "|").alias("matches"), "score")


@query("portal_lookup", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'active' ELSE 'unknown' END AS status, CASE c_mktsegment WHEN 'BUILDING' THEN 'workday' WHEN 'MACHINERY' THEN 'taleo' ELSE 'unknown' END AS platform FROM customer")
def portal_lookup(spark, sf):
    registry = spark.createDataFrame([("building", "active", "workday"), ("machinery", "active", "taleo")], "company string, status string, platform string")
    rows = t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("company"))
    return records.looked_up(rows, F.broadcast(registry), "company", {"status": "unknown", "platform": "unknown"}).select("c_custkey", "status", "platform")


_L = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)"


@query("source_lines", f"""WITH {_L}, w AS (SELECT doc_id, trim(x) AS x, string_split_regex(trim(x), '\\s+') AS w FROM l WHERE trim(x) <> '')
SELECT doc_id, count(*) FILTER (WHERE NOT regexp_full_match(x, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}') AND NOT (NOT contains(x, ' ') AND regexp_matches(x, '[A-Za-z]{{2,}}\\d{{5,}}|\\d{{5,}}[A-Za-z]{{2,}}'))
 AND NOT (len(w) <= 2 AND NOT regexp_matches(x, '\\d') AND len(list_filter(w, lambda y: length(y) >= 2 AND upper(y) = y AND lower(y) <> y)) = 0)) AS n_real, count(*) AS n_lines FROM w GROUP BY doc_id""")
def source_lines(spark, sf):
    x = t(spark, sf, "documents").select("doc_id", F.explode(text.lines(F.col("text"))).alias("x")).where(F.trim("x") != "")
    return x.groupBy("doc_id").agg(F.count_if(records.real_line(F.col("x"))).alias("n_real"), F.count("*").alias("n_lines"))


@query("service_order", """WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, lead(year(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders)
SELECT o_custkey, coalesce(bool_or(y < nxt), false) AS out_of_order FROM s GROUP BY o_custkey""")
def service_order(spark, sf):
    line = F.concat(F.date_format("o_orderdate", "MM/yyyy"), F.lit(" - now"))
    one = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("x")))), lambda s: s["x"]), "\n").alias("text"))
    return one.select("o_custkey", records.out_of_order(F.col("text")).alias("out_of_order"))


@query("service_rows", """SELECT o_custkey, o_orderkey, 'Chief Cook' AS role, 'Firm ' || o_custkey AS company, strftime(o_orderdate, '%m/%Y') || ' - ' || strftime(o_orderdate + INTERVAL 90 DAY, '%m/%Y') AS dates, 'Served aboard ' || o_orderpriority || '.' AS bullet FROM orders""")
def service_rows(spark, sf):
    row = F.concat_ws(" | ", F.concat(F.lit("Firm "), F.col("o_custkey").cast("string")), "o_orderpriority", "o_orderstatus", F.lit("1"), F.lit("cook"), F.date_format("o_orderdate", "MM/yyyy"), F.date_format(F.date_add("o_orderdate", 90), "MM/yyyy"), F.lit("90"))
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.inline(records.service_rows(F.concat(F.lit("Company | Vessel | Type | GRT | Rank | On | Off | Days\n"), row), F.lit("chief cook"))))
    return o.select("o_custkey", "o_orderkey", "role", "company", "dates", F.get("bullets", F.lit(0)).alias("bullet"))


@query("protected_signals", """WITH e AS (SELECT l_orderkey, 1 AS k, 'flag' AS kind, l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey, 2, 'status', l_linestatus FROM lineitem UNION ALL SELECT l_orderkey, 3, 'kind', lower(l_returnflag) FROM lineitem)
SELECT l_orderkey, value, arg_min(kind, k) AS kind FROM (SELECT l_orderkey, k, kind, lower(value) AS value FROM e) GROUP BY ALL""")
def protected_signals(spark, sf):
    g = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flag"), F.collect_set("l_linestatus").alias("status"), F.collect_set(F.lower("l_returnflag")).alias("kind"))
    s = g.select("l_orderkey", F.inline(records.signals({k: F.col(k) for k in ("flag", "status", "kind")})))
    return s.select("l_orderkey", F.lower("value").alias("value"), "kind")


@query("department_counts", "SELECT CASE o_custkey % 4 WHEN 0 THEN 'eto' WHEN 1 THEN 'engine' WHEN 2 THEN 'deck' ELSE '' END AS department, count(*) AS n FROM orders GROUP BY ALL")
def department_counts(spark, sf):
    rank = F.get(F.array(*[F.lit(r) for r in ("Chief_ETO", "second engineer", "Third Officer", "cook")]), (F.col("o_custkey") % 4).cast("int"))
    return t(spark, sf, "orders").groupBy(records.department(rank).alias("department")).agg(F.count("*").alias("n"))

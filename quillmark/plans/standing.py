"""Queries of certificate states and officers' reports from texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import standing, workflow
from .catalogue import query, t

REGISTRY = [("Basic Safety Training", "urgent"), ("Basic Safety Training", "bst"), ("Tanker Operation", "high"), ("Radar", "medium"), ("Radio", "low")]
WANTED = ["Basic Safety", "advanced tanker operation", "radar", "Medical"]
#: An order is a line of its customer's text.
_LINE = "CASE o_orderkey % 9 WHEN 0 THEN 'does not have ' WHEN 1 THEN 'lapsed: ' ELSE 'holds ' END || substr(o_orderpriority, 3)"

_STATES = f"""l AS (SELECT o_custkey AS cust, o_orderkey AS k, {_LINE} AS line, lower(substr(o_orderpriority, 3)) AS p FROM orders),
m AS (SELECT cust, k, line, CASE p WHEN 'urgent' THEN 'Basic Safety' WHEN 'high' THEN 'advanced tanker operation' WHEN 'medium' THEN 'radar' END AS wanted, CASE WHEN line LIKE 'does not have%' THEN 0 WHEN line LIKE 'lapsed%' THEN 1 ELSE 2 END AS r FROM l),
b AS (SELECT cust, wanted, min(r) AS r, arg_min(line, r * 100000000 + k) AS line FROM m WHERE wanted IS NOT NULL GROUP BY ALL),
need AS (SELECT cust, wanted FROM (SELECT DISTINCT cust FROM l), (VALUES {', '.join(f"('{w}')" for w in WANTED)}) v(wanted)),
st AS (SELECT need.cust, need.wanted, CASE r WHEN 0 THEN 'confirmed_missing' WHEN 1 THEN 'expired' WHEN 2 THEN 'evidenced_unverified' ELSE CASE WHEN need.wanted = 'radar' AND need.cust % 2 = 0 THEN 'evidenced_unverified' ELSE 'not_evidenced' END END AS state, coalesce(line, '') AS evidence FROM need LEFT JOIN b USING (cust, wanted))"""


def _states(spark, sf):
    k = F.col("o_orderkey") % 9
    line = F.concat(F.when(k == 0, "does not have ").when(k == 1, "lapsed: ").otherwise("holds "), F.substring("o_orderpriority", 3, 20))
    docs = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("x")))), lambda s: s["x"]), "\n").alias("text"))
    wanted = docs.select("cust", F.explode(F.array(*[F.lit(w) for w in WANTED])).alias("wanted"))
    claimed = docs.where("cust % 2 = 0").select("cust", F.lit("Radar").alias("certificate"))
    return standing.certificate_states(docs, "cust", "text", wanted, spark.createDataFrame(REGISTRY, "certificate string, alias string"), claimed)


@query("certificate_states", f"WITH {_STATES} SELECT cust, wanted, state, evidence FROM st")
def certificate_states(spark, sf):
    return _states(spark, sf).fillna("", ["evidence"])


@query("text_suitability", f"""WITH {_STATES}, c AS (SELECT DISTINCT cust FROM l),
req AS (SELECT cust, wanted AS text FROM c, (VALUES ('Basic Safety'), ('radar')) v(wanted) WHERE cust % 3 <> 0 UNION ALL SELECT cust, 'Medical' FROM c WHERE cust % 3 = 0),
g AS (SELECT req.cust, coalesce(string_agg(text, ',' ORDER BY text) FILTER (WHERE state = 'not_evidenced'), '') AS missing, coalesce(string_agg(text, ',' ORDER BY text) FILTER (WHERE state = 'confirmed_missing'), '') AS gone FROM req LEFT JOIN st ON st.cust = req.cust AND st.wanted = req.text GROUP BY req.cust)
SELECT cust, missing, gone, CASE WHEN gone <> '' THEN 'ineligible_confirmed_requirement' WHEN cust % 4 = 0 THEN 'potentially_eligible' ELSE 'needs_manual_review' END AS status FROM g""")
def text_suitability(spark, sf):
    s = _states(spark, sf)
    c = s.select("cust").distinct()
    req = c.where("cust % 3 <> 0").select("cust", F.lit("certificate").alias("type"), F.lit("mandatory").alias("priority"), F.explode(F.array(F.lit("Basic Safety"), F.lit("radar"))).alias("text"))
    req = req.unionByName(c.select("cust", F.lit("experience").alias("type"), F.lit("mandatory").alias("priority"), F.lit("at least 2 years").alias("text")))
    every = standing.with_states(req, c.select("cust", F.lit("Medical").alias("certificate")), s, "cust")
    people = c.select("cust", F.lit("mate").alias("rank"), F.lit("mate").alias("target"), F.lit(30).alias("rank_months"), F.when(F.col("cust") % 4 == 0, 24.0).otherwise(12.0).alias("relevant_months"))
    r = workflow.suitability(people, every, "cust")
    return r.select("cust", F.array_join("missing_evidence", ",").alias("missing"), F.array_join("confirmed_missing", ",").alias("gone"), "status")


@query("text_officers", f"""WITH l AS (SELECT l_orderkey AS ord, l_linenumber AS p, CASE WHEN l_returnflag = 'A' THEN 'master' WHEN l_returnflag = 'R' THEN 'mate' END AS rank, CAST(date_trunc('month', l_shipdate) AS DATE) AS a, CAST(date_trunc('month', l_shipdate) + INTERVAL 2 MONTH AS DATE) AS b, l_suppkey FROM lineitem),
o AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 2 = 0 THEN 'master' END AS rank, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS b FROM orders),
h AS (SELECT ord, coalesce(string_agg(DISTINCT rank, ',' ORDER BY rank), '') AS history, arg_max(coalesce(rank, '-'), strftime(b, '%Y%m') || strftime(a, '%Y%m') || p || coalesce(rank, '')) AS latest FROM l GROUP BY ord),
q AS (SELECT ord, 'all' AS g, a, b FROM (SELECT ord, a, b FROM l UNION ALL SELECT o.ord, o.a, o.b FROM o JOIN h USING (ord)) UNION ALL SELECT ord, rank, a, b FROM (SELECT ord, rank, a, b FROM l UNION ALL SELECT o.ord, rank, o.a, o.b FROM o JOIN h USING (ord)) WHERE rank IS NOT NULL),
e AS (SELECT ord, g, unnest(range(CAST(year(a) * 12 + month(a) AS BIGINT), CAST(year(b) * 12 + month(b) AS BIGINT))) AS m FROM q),
n AS (SELECT ord, g, count(DISTINCT m) AS n FROM e GROUP BY ALL),
lack AS (SELECT ord FROM l JOIN o USING (ord) WHERE l.rank IS NOT NULL AND l.rank IS DISTINCT FROM o.rank GROUP BY ord),
dup AS (SELECT ord FROM l GROUP BY ord, a, b, rank HAVING count(*) > 1)
SELECT h.ord, history, nullif(latest, '-') AS latest_rank, CASE WHEN h.ord IN (SELECT ord FROM lack) OR h.ord IN (SELECT ord FROM dup) OR h.ord NOT IN (SELECT ord FROM o) AND history <> '' THEN 'review_required' ELSE 'consistent' END AS status,
 CAST((SELECT n.n FROM n WHERE n.ord = h.ord AND g = 'all') AS DOUBLE) AS months, coalesce((SELECT string_agg(g || ':' || n.n, ',' ORDER BY g) FROM n WHERE n.ord = h.ord AND g <> 'all'), '') AS months_by_rank FROM h""")
def text_officers(spark, sf):
    span = lambda c, n: F.concat(F.date_format(c, "MM/yyyy"), F.lit(" - "), F.date_format(F.add_months(F.date_trunc("month", c), n), "'01'/MM/yyyy"))
    rank = F.when(F.col("l_returnflag") == "A", "Master").when(F.col("l_returnflag") == "R", "Mate").otherwise("Guest")
    books = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").cast("int").alias("page_number"), F.concat(rank, F.lit(" "), span("l_shipdate", 2)).alias("raw_text"), F.lit("text").alias("method"))
    resumes = t(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.lit(1).alias("page_number"), F.concat(F.when(F.col("o_custkey") % 2 == 0, "as master ").otherwise("as guest "), span("o_orderdate", 1)).alias("raw_text"), F.lit("text").alias("method"))
    r = standing.officer_from_text(resumes, books, "ord", ["master", "mate"], F.lit("2024-01-01").cast("date"))
    by = F.array_join(F.transform("months_by_rank", lambda x: F.concat(x["rank"], F.lit(":"), x["service_months"].cast("int").cast("string"))), ",")
    return r.select("ord", F.array_join("rank_history", ",").alias("history"), "latest_rank", "status", F.col("service_months").alias("months"), F.coalesce(by, F.lit("")).alias("months_by_rank"))

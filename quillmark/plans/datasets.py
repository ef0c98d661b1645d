"""Queries of training datasets and filled lists over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets
from .catalogue import query, t


def _prepared(spark, sf):
    d = t(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "correction").otherwise("rewrite_preference")
    feedback = d.select(kind.alias("kind"), F.col("text").alias("prompt"), F.col("lang").alias("preferred"), F.lit(None).cast("string").alias("rejected"), F.col("source").alias("split_group"), F.concat(F.lit("ref-"), "doc_id").alias("consent_record_ref"))
    rankings = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("vacancy_ref"), F.col("o_custkey").cast("string").alias("candidate_ref"), (F.col("o_orderkey") % 4).cast("int").alias("relevance"))
    return datasets.prepared(feedback, rankings, 0.2)


@query("dataset_rewrites", r"""WITH f AS (SELECT source, doc_id, regexp_replace(regexp_replace(text, '\b[0-9A-Za-z_.+-]+@[0-9A-Za-z_.-]+\.[A-Za-z]{2,}\b', '[redacted email]', 'g'), '(^|[^0-9A-Za-z_])(\+?[0-9][0-9 ().\-\s]{7,}[0-9])', '\1[redacted number]', 'g') AS prompt FROM documents WHERE doc_id % 3 <> 0),
g AS (SELECT DISTINCT source FROM f), n AS (SELECT count(*) AS g, greatest(1, least(count(*) - 1, round_even(count(*) * 0.2, 0))) AS n FROM g),
s AS (SELECT source, CASE WHEN n.g > 1 AND row_number() OVER (ORDER BY source DESC) <= n.n THEN 'rewrite_valid' ELSE 'rewrite_train' END AS dataset FROM g, n)
SELECT dataset, source AS source_group, 'ref-' || doc_id AS consent_record_ref FROM f JOIN s USING (source)""")
def dataset_rewrites(spark, sf):
    p = _prepared(spark, sf)
    return p["rewrite_train"].withColumn("dataset", F.lit("rewrite_train")).unionByName(p["rewrite_valid"].withColumn("dataset", F.lit("rewrite_valid"))).select("dataset", "source_group", "consent_record_ref")


@query("dataset_rankings", """WITH k AS (SELECT 'c:' || o_custkey AS comp FROM orders), g AS (SELECT DISTINCT comp FROM k), n AS (SELECT greatest(1, least(count(*) - 1, round_even(count(*) * 0.2, 0))) AS n FROM g),
s AS (SELECT comp, row_number() OVER (ORDER BY comp DESC) <= n.n AS held FROM g, n)
SELECT CASE WHEN held THEN 'ranking_valid' ELSE 'ranking_train' END AS dataset, count(*) AS n FROM k JOIN s USING (comp) GROUP BY ALL""")
def dataset_rankings(spark, sf):
    p = _prepared(spark, sf)
    both = p["ranking_train"].select(F.lit("ranking_train").alias("dataset")).unionByName(p["ranking_valid"].select(F.lit("ranking_valid").alias("dataset")))
    return both.groupBy("dataset").agg(F.count("*").alias("n"))


#: An order's parts are its skills, the parts of its customer's other order the defaults.
@query("filled_lists", """WITH i AS (SELECT l_orderkey AS ord, list(CASE WHEN l_linenumber % 2 = 0 THEN ' a' || l_suppkey % 5 ELSE 'A' || l_suppkey % 5 || ' ' END ORDER BY l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN ' a' || l_suppkey % 5 ELSE 'A' || l_suppkey % 5 || ' ' END) AS items FROM lineitem GROUP BY 1),
u AS (SELECT ord, unnest(items) AS x, generate_subscripts(items, 1) AS k FROM i),
own AS (SELECT ord, x, k, lower(trim(x)) AS y FROM u QUALIFY row_number() OVER (PARTITION BY ord, lower(trim(x)) ORDER BY k) = 1),
d AS (SELECT ord, x, k FROM (SELECT DISTINCT ord FROM u), (VALUES ('a0', 1), ('b', 2), ('A3', 3), ('B', 4), ('c', 5), ('d', 6)) v(x, k)),
more AS (SELECT d.ord, d.x, row_number() OVER (PARTITION BY d.ord ORDER BY d.k) AS k FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ord, lower(trim(x)) ORDER BY k) = 1) d WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.ord = d.ord AND lower(own.x) = lower(d.x))),
n AS (SELECT ord, count(*) AS n FROM own GROUP BY ord),
r AS (SELECT ord, x, k, 'source' AS origin, 0 AS p FROM own UNION ALL SELECT more.ord, x, k, 'padded', 1 FROM more JOIN n USING (ord) WHERE k <= greatest(5 - n, 0))
SELECT ord, string_agg(origin || ':' || x, ',' ORDER BY p, k) AS filled FROM r GROUP BY ord""")
def filled_lists(spark, sf):
    li = t(spark, sf, "lineitem")
    x = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" a"), (F.col("l_suppkey") % 5).cast("string"))).otherwise(F.concat(F.lit("A"), (F.col("l_suppkey") % 5).cast("string"), F.lit(" ")))
    g = li.groupBy(F.col("l_orderkey").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", x.alias("x")))).alias("a"))
    f = datasets.filled(F.col("items"), F.array(*[F.lit(v) for v in ("a0", "b", "A3", "B", "c", "d")]), F.lit(5))
    g = g.select("ord", F.transform("a", lambda s: s["x"]).alias("items"))
    return g.select("ord", F.array_join(F.transform(f, lambda s: F.concat_ws(":", s["origin"], s["item"])), ",").alias("filled"))

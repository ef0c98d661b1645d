"""Queries of column splits and of the stages of a rewrite over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, stages
from .catalogue import query, t
from .layers import _split

#: Eight orders are a page of about thirty words.
_TEXT = "CASE l_partkey % 11 WHEN 0 THEN 'SKILLS' WHEN 1 THEN 'Education' WHEN 2 THEN 'courses' WHEN 3 THEN 'a' WHEN 4 THEN 'Summary' ELSE concat(l_returnflag, lower(l_linestatus), l_linenumber) END"
_PAGES = f"""w AS (SELECT l_orderkey // 8 AS page, {_TEXT} AS text, CAST(l_quantity AS DOUBLE) + l_suppkey / 1000.0 AS x0, CAST(l_quantity AS DOUBLE) + l_suppkey / 1000.0 + 3 AS x1, l_suppkey % 20 * 1.5 AS top FROM lineitem WHERE l_quantity NOT BETWEEN 24 AND 33),
z AS (SELECT * FROM w WHERE NOT (x0 < 30 AND x1 > 30)),
two AS (SELECT page FROM w GROUP BY page HAVING count(*) FILTER (WHERE x0 < 30) / count(*) > 0.25 AND count(*) FILTER (WHERE x0 < 30) / count(*) < 0.75 AND count(*) FILTER (WHERE x0 >= 30) > 10)"""


@query("page_best_split", f"""WITH {_PAGES}, g AS (SELECT two.page, coalesce(a.split, c.split, 30.0) AS split FROM two LEFT JOIN {_split('w')} a ON a.page = two.page LEFT JOIN {_split('z')} c ON c.page = two.page),
k AS (SELECT page, 0 AS choice, split FROM g UNION ALL SELECT page, n, r * 60 FROM two, (VALUES (1, 0.45), (2, 0.50), (3, 0.55), (4, 0.60), (5, 0.65)) v(n, r)),
s AS (SELECT w.*, choice, split, CAST(x0 >= split AS INTEGER) AS side FROM w JOIN k USING (page)),
o AS (SELECT *, CASE WHEN top - lag(top) OVER q > 3 THEN 1 ELSE 0 END AS opens FROM s WINDOW q AS (PARTITION BY page, choice, side ORDER BY top, x0, text)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY page, choice, side ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS line_no FROM o),
l AS (SELECT page, choice, any_value(split) AS split, side, line_no, string_agg(text, ' ' ORDER BY x0, top, text) AS line FROM n GROUP BY page, choice, side, line_no),
c AS (SELECT page, choice, any_value(split) AS split, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE side = 0), '') || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE side = 1), '') AS text,
  count(*) FILTER (WHERE NOT contains(line, ' ') AND NOT (upper(line) = line AND lower(line) <> line) AND length(line) < 15) AS stray FROM l WHERE NOT regexp_matches(line, '^[A-Za-z]$') GROUP BY page, choice),
h AS (SELECT *, {' + '.join(f"CAST(contains(lower(text), '{x}') AS INTEGER)" for x in geometry.HEADINGS)} AS headings FROM c)
SELECT page, choice, round(split, 4) AS split, headings, stray, md5(text) AS text_md5 FROM h QUALIFY row_number() OVER (PARTITION BY page ORDER BY headings DESC, stray, length(text) DESC, choice) = 1""")
def page_best_split(spark, sf):
    li = t(spark, sf, "lineitem").where("l_quantity NOT BETWEEN 24 AND 33")
    x0 = F.col("l_quantity").cast("double") + F.col("l_suppkey") / 1000.0
    words = li.select(F.floor(F.col("l_orderkey") / 8).alias("page"), F.expr(_TEXT).alias("text"), x0.alias("x0"), (x0 + 3).alias("x1"), (F.col("l_suppkey") % 20 * 1.5).alias("top"))
    pages = words.select("page").distinct().withColumn("width", F.lit(60.0))
    b = geometry.best_split(words, pages, ["page"], 8.0)
    return b.select("page", "choice", F.round("split", 4).alias("split"), "headings", "stray", F.md5("text").alias("text_md5"))


#: The first turn of a conversation is the original, the next two are the attempts; words of three letters stand for claims.
_STAGES = r"""c AS (SELECT conv_id, turn, CASE WHEN turn = 1 AND conv_id % 7 = 0 THEN NULL ELSE text || CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN ' also 42' ELSE '' END END AS text FROM conversations WHERE turn < 3),
s AS (SELECT conv_id, turn, text, length(text) * 7 % 60 AS score, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\d[\d,.]*%?'), lambda x: replace(regexp_replace(x, '[,.]+(%?)$', '\1'), ',', ''))) AS facts, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: length(x) = 3 AND x <> 'the') AS w FROM c),
w AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS x FROM s WHERE text IS NOT NULL) GROUP BY ALL),
inv AS (SELECT a.conv_id, a.turn, bool_or(a.n > coalesce(b.n, 0)) AS bad FROM w a LEFT JOIN w b ON b.conv_id = a.conv_id AND b.turn = 0 AND b.x = a.x WHERE a.turn > 0 AND a.x < 'n' GROUP BY ALL),
j AS (SELECT o.conv_id, o.score AS s0, f.score AS s1, g.score AS s2, o.facts AS f0, f.facts AS f1, g.facts AS f2, CASE WHEN f.text IS NULL THEN 'failed' WHEN coalesce(i1.bad, FALSE) THEN 'rejected' ELSE 'written' END AS o1, CASE WHEN g.text IS NULL THEN 'failed' WHEN coalesce(i2.bad, FALSE) THEN 'rejected' ELSE 'written' END AS o2
  FROM s o LEFT JOIN s f ON f.conv_id = o.conv_id AND f.turn = 1 LEFT JOIN s g ON g.conv_id = o.conv_id AND g.turn = 2 LEFT JOIN inv i1 ON i1.conv_id = o.conv_id AND i1.turn = 1 LEFT JOIN inv i2 ON i2.conv_id = o.conv_id AND i2.turn = 2 WHERE o.turn = 0),
v AS (SELECT *, o1 = 'written' AND len(list_filter(f1, lambda x: NOT list_contains(f0, x))) > 0 AS risk1, o2 = 'written' AND len(list_filter(f2, lambda x: NOT list_contains(f0, x))) > 0 AS risk2, CASE WHEN o1 = 'written' THEN s1 ELSE s0 END AS after1 FROM j),
a AS (SELECT *, risk1 OR (o1 = 'written' AND after1 - s0 < 15) AS again FROM v),
k AS (SELECT *, again AND o2 = 'written' AND NOT risk2 AND (risk1 OR s2 > after1) AS took FROM a),
z AS (SELECT *, CASE WHEN took THEN s2 ELSE after1 END AS after, risk1 AND NOT took AS risk FROM k),
y AS (SELECT *, CASE WHEN risk OR after < s0 THEN 'original' WHEN took THEN 'strict' WHEN o1 <> 'written' THEN 'fallback' ELSE 'rewritten' END AS state, CASE WHEN risk THEN 'facts_added' WHEN after < s0 THEN 'score_fell' WHEN o1 <> 'written' THEN 'first_' || o1 END AS reason FROM z)"""


def _staged(spark, sf):
    c = t(spark, sf, "conversations").where("turn < 3")
    text = F.when((F.col("turn") == 1) & (F.col("conv_id") % 7 == 0), F.lit(None).cast("string")).otherwise(F.concat("text", F.when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 0), " also 42").otherwise("")))
    c = c.select("conv_id", "turn", text.alias("text")).withColumn("score", F.length("text") * 7 % 60)

    def claims(docs, key, column):
        words = F.filter(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), 0), lambda x: (F.length(x) == 3) & (x != "the"))
        each = docs.select(key, F.explode(words).alias("w")).select(key, F.concat(F.when(F.col("w") < "n", "w").otherwise(""), F.lit(":"), "w").alias("claim"))
        return each.groupBy(key, "claim").agg(F.count("*").alias("n"))

    return stages.run(c.where("turn = 0").select("conv_id", "text", "score"), c.where("turn > 0").select("conv_id", (F.col("turn") == 2).alias("strict"), "text", "score"), "conv_id", claims)


@query("rewrite_stages", f"WITH {_STAGES} SELECT conv_id, state, CAST(CASE WHEN state = 'original' THEN s0 ELSE after END AS INTEGER) AS score, CAST(CASE WHEN state = 'original' THEN 0 ELSE after - s0 END AS INTEGER) AS improvement, coalesce(reason, '') AS reason, 3 + 1 + CAST(again AS INTEGER) + CAST(state = 'original' AS INTEGER) AS n_steps FROM y")
def rewrite_stages(spark, sf):
    return _staged(spark, sf).select("conv_id", "state", "score", "improvement", F.coalesce("reason", F.lit("")).alias("reason"), F.size("trail").alias("n_steps"))


@query("stage_audit", f"""WITH {_STAGES}, r AS (SELECT 'rewrite' AS stage, o1 AS outcome FROM y UNION ALL SELECT 'strict', CASE WHEN took THEN 'taken' WHEN o2 <> 'written' THEN o2 WHEN risk2 THEN 'facts_added' ELSE 'not_better' END FROM y WHERE again UNION ALL SELECT 'rollback', reason FROM y WHERE state = 'original' UNION ALL SELECT 'fallback', 'original content' FROM y WHERE o1 <> 'written' UNION ALL SELECT 'done', state FROM y)
SELECT stage, outcome, count(*) AS n FROM r GROUP BY ALL""")
def stage_audit(spark, sf):
    return stages.stage_counts(stages.audit(_staged(spark, sf), "conv_id").where("stage NOT IN ('score', 'rescore')"))

"""Queries of entities with their places, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence
from .catalogue import query, t, values

#: (kind, canonical, term, ord): no term of two words overlaps another one of two words.
ENTITIES = [("rank", "article", "the", 1), ("rank", "article", "la", 0), ("rank", "Head", "of the", 0), ("rank", "Head", "de la", 1), ("ship", "link", "of", 0), ("ship", "link", "von", 1), ("ship", "chain", "and the", 0), ("ship", "Chain", "and", 1), ("ship", "fuer", "für", 0)]
METHODS = {"first_term": ["rank"], "longest_first": None, "every_term": ["ship"]}

_TOKENS = r"""raw AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])')) AS x, generate_subscripts(regexp_extract_all(text, '\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])'), 1) AS i FROM documents),
tok AS (SELECT doc_id, i, lower(trim(x, chr(32) || chr(10) || chr(9) || chr(13))) AS w, sum(length(x)) OVER o AS e, sum(length(x)) OVER o - length(trim(x, chr(32) || chr(10) || chr(9) || chr(13))) AS s FROM raw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
two AS (SELECT doc_id, i, s, e, w, lead(w) OVER o AS w2, lead(e) OVER o AS e2 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""
_SPANS = f"""dict AS (SELECT * FROM {values(ENTITIES, 'kind, canonical, term, ord')}),
hit AS (SELECT doc_id, i, 1 AS n, kind, canonical, term, ord, s, e FROM two JOIN dict ON w = term UNION ALL SELECT doc_id, i, 2, kind, canonical, term, ord, s, e2 FROM two JOIN dict ON w || ' ' || w2 = term)"""
_MASK = r"(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-z]{2,}"


@query("doc_spans", f"WITH {_TOKENS}, {_SPANS} SELECT hit.doc_id, kind, canonical, term, CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, md5(substring(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))) AS surface_md5, md5(substring(text, CAST(greatest(s - 80, 0) + 1 AS BIGINT), CAST(least(s, 80) AS BIGINT))) AS before_md5, md5(substring(text, CAST(e + 1 AS BIGINT), 80)) AS after_md5 FROM hit JOIN documents USING (doc_id)")
def doc_spans(spark, sf):
    d = spark.createDataFrame(ENTITIES, "kind string, canonical string, term string, ord int")
    s = evidence.spans(t(spark, sf, "documents"), "doc_id", "text", d)
    return s.select("doc_id", "kind", "canonical", "term", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.md5("surface").alias("surface_md5"), F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query("doc_entities", f"""WITH {_TOKENS}, {_SPANS},
f AS (SELECT *, 0 AS place FROM hit WHERE kind = 'rank' QUALIFY row_number() OVER (PARTITION BY doc_id, kind, canonical ORDER BY ord, s, term) = 1),
l AS (SELECT *, 1 AS place FROM hit WHERE n = 2 OR NOT EXISTS (SELECT 1 FROM hit h WHERE h.n = 2 AND h.doc_id = hit.doc_id AND h.i IN (hit.i, hit.i - 1))),
u AS (SELECT * FROM f UNION ALL SELECT * FROM l UNION ALL SELECT *, 2 FROM hit WHERE kind = 'ship'),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, kind, lower(canonical), s ORDER BY place, e DESC, canonical, term) = 1)
SELECT b.doc_id, kind, canonical, CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, ['first_term', 'longest_first', 'every_term'][place + 1] AS method,
 md5(left(regexp_replace(regexp_replace(substring(text, CAST(greatest(s - 80, 0) + 1 AS BIGINT), CAST(e - greatest(s - 80, 0) + 80 AS BIGINT)), '[0-9A-Za-z_.+-]+@[0-9A-Za-z_.-]+\\.[A-Za-z]{{2,}}', '[REDACTED]', 'g'), '\\b\\d{{7,}}\\b', '[REDACTED]', 'g'), 240)) AS evidence_md5
FROM b JOIN documents USING (doc_id)""")
def doc_entities(spark, sf):
    d = spark.createDataFrame(ENTITIES, "kind string, canonical string, term string, ord int")
    e = evidence.entities(evidence.spans(t(spark, sf, "documents"), "doc_id", "text", d), "doc_id", METHODS)
    return e.select("doc_id", "kind", "canonical", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "method", F.md5("evidence").alias("evidence_md5"))


@query("doc_snippets", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
dict AS (SELECT * FROM {values(ENTITIES, 'kind, canonical, term, ord')}),
w AS (SELECT doc_id, line_no, line, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS w, generate_subscripts(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'), 1) AS i FROM l),
w2 AS (SELECT doc_id, line_no, line, w, w || ' ' || lead(w) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS ww FROM w),
h AS (SELECT doc_id, kind, canonical, term, line_no, line FROM w2 JOIN dict ON w = term UNION ALL SELECT doc_id, kind, canonical, term, line_no, line FROM w2 JOIN dict ON ww = term)
SELECT doc_id, kind, canonical, term, CAST(line_no AS INTEGER) AS line_no, md5(regexp_replace(regexp_replace(left(trim(line), 300), '[0-9A-Za-z_.+-]+@[0-9A-Za-z_.-]+\\.[A-Za-z]{{2,}}', '[REDACTED]', 'g'), '\\b\\d{{7,}}\\b', '[REDACTED]', 'g')) AS snippet_md5
FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, kind, canonical ORDER BY length(term) DESC, line_no, term) = 1""")
def doc_snippets(spark, sf):
    d = spark.createDataFrame(ENTITIES, "kind string, canonical string, term string, ord int")
    s = evidence.snippets(t(spark, sf, "documents"), "doc_id", "text", d)
    return s.select("doc_id", "kind", "canonical", "term", "line_no", F.md5("snippet").alias("snippet_md5"))


@query("ship_experience", f"""WITH {_TOKENS}, {_SPANS},
need AS (SELECT DISTINCT doc_id, unnest(['link', CASE WHEN doc_id % 2 = 0 THEN 'CHAIN' ELSE 'fuer' END, 'raft']) AS wanted FROM documents),
j AS (SELECT need.doc_id, lower(wanted) AS n, EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = need.doc_id AND lower(hit.canonical) = lower(wanted)) AS shown FROM need)
SELECT doc_id, coalesce(string_agg(n, ',' ORDER BY n) FILTER (WHERE shown), '') AS demonstrated, coalesce(string_agg(n, ',' ORDER BY n) FILTER (WHERE NOT shown), '') AS not_evidenced, count(*) FILTER (WHERE shown) AS n_evidence FROM j GROUP BY doc_id""")
def ship_experience(spark, sf):
    d = spark.createDataFrame(ENTITIES, "kind string, canonical string, term string, ord int")
    docs = t(spark, sf, "documents")
    found = evidence.entities(evidence.spans(docs, "doc_id", "text", d), "doc_id", METHODS)
    need = docs.select("doc_id", F.explode(F.array(F.lit("link"), F.when(F.col("doc_id") % 2 == 0, "CHAIN").otherwise("fuer"), F.lit("raft"))).alias("canonical"))
    e = evidence.experience(found, need, "doc_id")
    return e.select("doc_id", F.array_join("demonstrated", ",").alias("demonstrated"), F.array_join("not_evidenced", ",").alias("not_evidenced"), F.size("evidence").cast("bigint").alias("n_evidence"))

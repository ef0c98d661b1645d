"""Queries of composed reports and rewrite decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, sequences
from ..operators.lineage import checkpointed
from .catalogue import _CARD, query, t

_FACTS = r"list_distinct(list_transform(regexp_extract_all(coalesce({}, ''), '\d[\d,.]*%?'), lambda x: replace(regexp_replace(x, '[,.]+(%?)$', '\1'), ',', '')))"


@query("doc_layers", _CARD + f""", fx AS (SELECT doc_id, {_FACTS.format('text')} AS facts, contains(coalesce(text, ''), '—') AS dash FROM documents)
SELECT c.doc_id, total, grade, len(facts) AS n_facts, dash AS has_dash FROM card c JOIN fx USING (doc_id)""")
def doc_layers(spark, sf):
    r = reports.layered(t(spark, sf, "documents"), "text", F.lit(None).cast("string"))
    return r.select("doc_id", "total", "grade", F.size("facts").cast("bigint").alias("n_facts"), F.array_contains("findings", "EM_DASH_DETECTED").alias("has_dash"))


@query("rewrite_decisions", _CARD + f""", fx AS (SELECT doc_id, source, {_FACTS.format('text')} AS facts FROM documents),
px AS (SELECT fx.doc_id, total AS after, facts AS n, lag(total) OVER o AS before, lag(facts) OVER o AS old FROM fx JOIN card USING (doc_id) WINDOW o AS (PARTITION BY source ORDER BY fx.doc_id)),
dx AS (SELECT *, len(list_filter(n, lambda x: NOT list_contains(old, x))) AS added, len(list_filter(old, lambda x: NOT list_contains(n, x))) AS removed FROM px WHERE before IS NOT NULL)
SELECT doc_id, CASE WHEN added > 0 THEN 'factual_integrity_risk' WHEN after < before OR removed > 0 THEN 'degraded' WHEN after > before THEN 'improved' ELSE 'neutral' END AS verdict,
 CASE WHEN after - before >= 15 THEN 'full' WHEN after > before THEN 'partial' ELSE 'none' END AS quality, after - before < 15 AS retry, CASE WHEN after < before OR added > 0 THEN 'original' ELSE 'rewritten' END AS kept FROM dx""")
def rewrite_decisions(spark, sf):
    d = t(spark, sf, "documents")
    # written once, read for both sides; each source's neighbours are found without a task for it
    r = checkpointed(reports.layered(d, "text", F.lit(None).cast("string")).select("doc_id", "total", "facts"))
    near = sequences.with_next(d, "source", "doc_id", "nxt").where("nxt IS NOT NULL")
    old = near.join(r, "doc_id").select(F.col("nxt").alias("doc_id"), F.col("total").alias("before"), F.col("facts").alias("old_facts"))
    pairs = old.join(r.select("doc_id", F.col("total").alias("after"), F.col("facts").alias("new_facts")), "doc_id")
    return reports.decided(pairs).select("doc_id", "verdict", "quality", "retry", "kept")

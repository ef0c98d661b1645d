"""Query of the generic score over the documents; their lines stand for bullets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generic, parse_checks
from .catalogue import query, t
from .parsing import _CHECKS_SQL, _tags

_BASE = _CHECKS_SQL[: _CHECKS_SQL.rindex("\nSELECT doc_id, concat_ws")]
_ORDER = ["text_layer", "garbled_glyphs", "text_coverage", "multi_column", "tables", "text_boxes", "header_footer_content", "images", "contact_info", "dates"]


@query("generic_scores", _BASE + r""",
g AS (SELECT *, doc_id % 5 AS m, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[0-9]', '', 'g'))), lambda x: x <> '') AS b0, 100 - CASE text_layer WHEN 'fail' THEN 30 ELSE 0 END - CASE garbled WHEN 'fail' THEN 30 WHEN 'warn' THEN 15 ELSE 0 END - CASE multi_column WHEN 'fail' THEN 12 ELSE 0 END - CASE tables WHEN 'warn' THEN 6 ELSE 0 END - CASE margins WHEN 'warn' THEN 6 ELSE 0 END - CASE images WHEN 'warn' THEN 2 ELSE 0 END AS overall FROM s),
h AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN list_append(b0, 'Managed 12 % of it') ELSE list_append(b0, 'Assisted crews') END AS b, len(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]')) AS letters, len(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_''-]*[\p{L}\p{M}\p{N}_][\p{L}\p{M}\p{N}_''-]*')) AS words,
 least(40.0, greatest(0.0, greatest(0, overall) * 0.4 + CASE WHEN tables = 'warn' THEN -12.6 ELSE 0 END)) AS p0, doc_id % 101 AS ats FROM g),
i AS (SELECT *, CASE WHEN text_layer = 'fail' THEN least(p0, 5.0) ELSE p0 END AS pp, len(list_filter(b, lambda x: regexp_matches(x, '(?i)^[^\p{L}\p{M}\p{N}_]*(managed|assisted|helped|supported)($|[^\p{L}\p{M}\p{N}_])') AND NOT regexp_matches(x, '(?i)(^|[^\p{L}\p{M}\p{N}_])(improv[\p{L}\p{N}_]*|reduc[\p{L}\p{N}_]*|increas[\p{L}\p{N}_]*|delivered|achieved|saved|grew|generated|completed|streamlined|resolved|result(ed)?)($|[^\p{L}\p{M}\p{N}_])'))) AS n_vague FROM h),
j AS (SELECT *, least(6, CAST(round_even(6.0 * n_vague / len(b), 0) AS INTEGER)) AS vague, m = 0 AS no_skills, m = 1 AS no_work, doc_id % 2 = 1 AS no_claims, doc_id % 4 = 1 AS generic, contact = 'fail' AND doc_id % 9 <> 0 AS no_contact FROM i),
k AS (SELECT *, (ats * 0.6 - CASE WHEN no_skills THEN 10 ELSE 0 END - CASE WHEN no_contact THEN 8 ELSE 0 END - CASE WHEN no_claims THEN 8 ELSE 0 END - CASE WHEN generic THEN 5 ELSE 0 END - vague) * CASE WHEN words < 300 THEN 0.75 ELSE 1.0 END AS c0 FROM j),
n AS (SELECT *, greatest(0.0, least(60.0, CASE WHEN words < 150 THEN least(CASE WHEN no_work THEN least(c0, 30.0) ELSE c0 END, 20.0) WHEN no_work THEN least(c0, 30.0) ELSE c0 END)) AS cp FROM k),
z AS (SELECT *, pp + cp AS raw FROM n),
y AS (SELECT *, CAST(round_even(CASE WHEN raw < 40 THEN raw * 0.75 WHEN raw > 85 THEN 85 + (raw - 85) * 0.6 ELSE raw END, 0) AS INTEGER) AS total FROM z)
SELECT doc_id, CAST(round(pp, 4) AS DOUBLE) AS parse_points, CAST(round(cp, 4) AS DOUBLE) AS content_points, total, CASE WHEN total >= 85 THEN 'EXCELLENT' WHEN total >= 75 THEN 'GOOD' WHEN total >= 60 THEN 'PASS' ELSE 'FAIL' END AS grade,
 concat_ws(',', CASE WHEN no_skills THEN 'MISSING_SKILLS' END, CASE WHEN no_contact THEN 'MISSING_CONTACT' END, CASE WHEN no_claims THEN 'NO_QUANTIFIED_ACHIEVEMENTS' END, CASE WHEN generic THEN 'GENERIC_OBJECTIVE' END, CASE WHEN vague > 0 THEN 'VAGUE_DUTIES' END, CASE WHEN words < 300 THEN 'THIN' END, CASE WHEN no_work THEN 'MISSING_WORK_EXPERIENCE' END, CASE WHEN words < 150 THEN 'UNDER_150_WORDS' END) AS content_issues FROM y""")
def generic_scores(spark, sf):
    k, lit = F.col("doc_id"), F.lit
    ext = F.when(k % 4 >= 2, "docx").otherwise("pdf")
    d = t(spark, sf, "documents").select("doc_id", F.coalesce("text", lit("")).alias("text"), parse_checks.view(F.col("text"), _tags(), ext).alias("v"))
    found = parse_checks.statuses(F.col("v"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[0-9]", ""))
    d = d.select("doc_id", "text", "v", *[found[n].alias(n) for n in _ORDER], (k % 101).cast("double").alias("ats_score"), F.concat(lines, F.array(F.when(k % 2 == 0, "Managed 12 % of it").otherwise("Assisted crews"))).alias("bullets"))
    sections = F.array_compact(F.array(F.when(k % 5 != 0, "skills"), F.when(k % 5 != 1, "experience")))
    d = d.withColumns({"skills": F.array(lit("x")), "has_work": lit(True), "contact": (F.col("contact_info") != "fail") | (k % 9 == 0), "sections": sections, "role": F.when(k % 4 == 3, "Chief Mate").otherwise("Job"), "wanted": F.when(k % 4 == 2, F.array(lit("job"), lit("ECDIS"))).otherwise(F.array(lit("position")))})
    d = d.withColumn("objective", F.when(k % 4 == 1, "Seeking a job").when(k % 4 == 2, "Objective: ecdis").when(k % 4 == 3, "To obtain a chief mate post").otherwise("Seaman"))
    r = generic.scored(d, "v", {n: F.col(n) for n in _ORDER})
    return r.select("doc_id", F.round("parse_points", 4).alias("parse_points"), F.round("content_points", 4).alias("content_points"), "total", "grade", F.array_join("content_issues", ",").alias("content_issues"))

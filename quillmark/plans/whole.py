"""Queries of whole records and of batches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import whole
from ..sources import batches
from . import parsing
from .catalogue import query, t, values

#: (kind, canonical, term, ord, priority) from frequent words.
REGISTRY = [("rank", "master", "the", 0, 1), ("rank", "mate", "der", 0, 2), ("rank", "oiler", "la", 0, 3), ("rank", "oiler", "de la", 1, 3), ("skill", "of", "of", 0, 9), ("skill", "and", "and", 0, 9), ("skill", "in", "in", 0, 9), ("skill", "que", "que", 0, 9), ("certificate", "STCW", "for", 0, 9), ("certificate", "GMDSS", "und", 0, 9), ("certificate", "GMDSS", "with", 1, 9), ("certificate", "COC", "les", 0, 9), ("vessel_type", "tanker", "that", 0, 9), ("vessel_type", "bulk", "des", 0, 9)]
REQUIRED = {"master": ["STCW", "GMDSS"], "": ["STCW", "COC", "GMDSS"]}
LEAST = {"master": 36, "mate": 12, "": 6}
TAGS = ["TABLES_DETECTED"]
_DATED = "concat(coalesce(text, ''), chr(10), CASE doc_id % 3 WHEN 0 THEN 'Mate 01/2020 - 07/2021' WHEN 1 THEN 'cdc 01/2020 - 07/2021' ELSE '' END)"

_FORM = parsing._FORM | {"EMAIL_NOT_FOUND": (5, "email = ''"), "PHONE_NOT_FOUND": (3, "phone = ''"), "LINKEDIN_URL_MISSING": (2, "rank <> 'oiler'")}
_HAS = {n: h.replace("doc_id % 4 = 0 OR ", "") for n, h in parsing._HAS.items()}
_PART = parsing._PART | {f"{n.upper()}_MISSING": f"NOT ({h})" for n, h in _HAS.items()} | {"LOW_SKILL_COUNT": "len(skills) < 10", "TOO_MANY_SKILLS": "len(skills) > 30"}
_SUMMARY = parsing._BLOCK


@query("resume_flat", rf"""WITH reg AS (SELECT * FROM {values(REGISTRY, 'kind, canonical, term, ord, priority')}),
a AS (SELECT doc_id, {_DATED} AS t FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS w, generate_subscripts(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), 1) AS i FROM a),
w2 AS (SELECT doc_id, w, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS ww FROM w),
hit AS (SELECT DISTINCT doc_id, kind, canonical, priority FROM w2 JOIN reg ON w = term OR ww = term),
n AS (SELECT doc_id, arg_min(canonical, priority) FILTER (WHERE kind = 'rank') AS rank, coalesce(list_sort(list(DISTINCT canonical) FILTER (WHERE kind = 'skill')), []) AS skills, coalesce(list(DISTINCT canonical) FILTER (WHERE kind = 'certificate'), []) AS held, coalesce(list_sort(list(DISTINCT canonical) FILTER (WHERE kind = 'vessel_type')), []) AS vessels FROM hit GROUP BY doc_id),
b AS (SELECT a.doc_id, t, lower(t) AS low, coalesce(rank, 'unknown') AS rank, coalesce(skills, []) AS skills, coalesce(held, []) AS held, coalesce(vessels, []) AS vessels,
  coalesce(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9._%+-]{{3,}}@[A-Za-z0-9-]+\.[A-Za-z]+')[1], '') AS email, coalesce(list_filter(list_transform(regexp_extract_all(t, '[+]?[0-9][0-9 ().-]{{8,}}[0-9]'), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda d: length(d) >= 10)[1], '') AS phone,
  trim({_SUMMARY['summary']}, E' \t\n\r') AS summary, {_SUMMARY['experience']} AS work, {_SUMMARY['certifications']} AS papers, doc_id % 5 = 0 AS tagged,
  CASE WHEN doc_id % 3 = 2 THEN 0 ELSE (DATE '2021-07-01' - DATE '2020-01-01') // 30 END AS months FROM a LEFT JOIN n USING (doc_id)),
c AS (SELECT *, len(regexp_extract_all(summary, '[.!?]+')) AS ends, regexp_extract_all(work, '\d\d/(\d{{4}})\s*[-–]', 1) AS starts,
  CASE WHEN rank = 'master' THEN ['STCW', 'GMDSS'] ELSE ['STCW', 'COC', 'GMDSS'] END AS need, CASE rank WHEN 'master' THEN 36 WHEN 'mate' THEN 12 ELSE 6 END AS least_months FROM b),
d AS (SELECT *, greatest(0, 40 - CASE WHEN tagged THEN 8 ELSE 0 END - {' - '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for p, c in _FORM.values())}) + {' + '.join(f'CASE WHEN {_HAS[n]} THEN {p} ELSE 0 END' for n, (p, _) in parsing.older.SECTIONS.items())} + 20 AS ats,
  CASE WHEN tagged THEN 1 ELSE 0 END + {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for _, c in _FORM.values())} + {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c in _PART.values())} AS n_issues, list_filter(need, lambda x: NOT list_contains(held, x)) AS gone FROM c),
e AS (SELECT *, len(need) - len(gone) AS got, least(20, CASE WHEN months >= 3 * least_months THEN 8 WHEN months >= 2 * least_months THEN 5 WHEN months >= least_months THEN 2 ELSE 0 END + least(len(vessels), 4) + CASE WHEN len(gone) = 0 THEN 4 ELSE 0 END + CASE WHEN rank IN ('master', 'chief engineer', 'chief officer', 'second engineer') THEN 4 ELSE 0 END) AS bonus FROM d),
f AS (SELECT *, CAST(floor(got * 25 / len(need)) + CASE WHEN months >= least_months THEN 20 ELSE floor(months * 20 / least_months) END + CASE WHEN len(vessels) > 0 THEN 10 ELSE 0 END + CASE WHEN rank <> 'unknown' THEN 10 ELSE 0 END + bonus AS INTEGER) AS sea FROM e),
g AS (SELECT *, length(trim(t, ' ')) < 50 AS bad FROM f)
SELECT doc_id, CASE WHEN NOT bad THEN email END AS email, CASE WHEN NOT bad THEN phone END AS phone, CASE WHEN NOT bad THEN rank END AS rank_detected, CASE WHEN bad THEN 0 ELSE CAST(ats AS INTEGER) END AS ats_score,
  CASE WHEN bad THEN 0 ELSE sea END AS maritime_score, CASE WHEN NOT bad THEN CASE WHEN sea >= 55 THEN 'STRONG' WHEN sea >= 35 THEN 'ADEQUATE' ELSE 'WEAK' END END AS maritime_grade, CASE WHEN bad THEN 0 ELSE CAST(months AS INTEGER) END AS months,
  CASE WHEN NOT bad THEN got || '/' || len(need) END AS cert_coverage, CASE WHEN NOT bad THEN array_to_string(gone, ', ') END AS missing_certs, CASE WHEN NOT bad THEN array_to_string(vessels, ', ') END AS vessel_types, CASE WHEN bad THEN 0 ELSE CAST(len(skills) AS INTEGER) END AS skills_count, CASE WHEN bad THEN 0 ELSE CAST(n_issues AS INTEGER) END AS issues_count, CASE WHEN bad THEN 'EMPTY_OR_UNREADABLE' ELSE '' END AS error FROM g""")
def resume_flat(spark, sf):
    return _flat(spark, sf).drop("person", "structural_issues", "n_chars_read", "ats_grade")


def _flat(spark, sf):
    k = F.col("doc_id") % 3
    line = F.when(k == 0, "Mate 01/2020 - 07/2021").when(k == 1, "cdc 01/2020 - 07/2021").otherwise("")
    d = t(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"), F.when(F.col("doc_id") % 5 == 0, F.array(*[F.lit(x) for x in TAGS])).alias("tags"))
    reg = spark.createDataFrame(REGISTRY, "kind string, canonical string, term string, ord int, priority int")
    return whole.flat(d, "doc_id", "text", "tags", reg, REQUIRED, LEAST, [], F.lit("2024-01-01").cast("date"))


@query("value_attempts", """WITH a AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR_EVENT' WHEN value > 90 THEN 'TOO_LARGE' ELSE '' END AS error, regexp_extract(props, '[0-9]+') AS k FROM events)
SELECT event_id, error, coalesce(CASE WHEN error = '' THEN TRY_CAST(k AS INTEGER) END, -1) AS k FROM a""")
def value_attempts(spark, sf):
    e = t(spark, sf, "events")
    a = batches.attempted(e.select("event_id", "event_type", "value", "props"), [(F.col("event_type") == "error", "ERROR_EVENT"), (F.col("value") > 90, "TOO_LARGE")], {"k": F.regexp_extract("props", "[0-9]+", 0).try_cast("int")})
    return a.select("event_id", "error", "k").fillna(-1, ["k"])

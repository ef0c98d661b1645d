"""Queries of parse checks, the older scorer and shapes of a candidate's record over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import older, parse_checks, profile
from .catalogue import query, t, values

#: What an extractor would say of a document, by its id.
TAGS = [["MULTI_COLUMN_LAYOUT_DETECTED"], ["TABLES_DETECTED", "CONTENT_IN_HEADER"], ["IMAGES_OR_GRAPHICS_DETECTED"], [], ["CONTENT_IN_FOOTER"], None]


def _tags():
    k = F.col("doc_id") % len(TAGS)
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for i, x in enumerate(TAGS):
        if x is not None:
            out = out.when(k == i, F.array(*map(F.lit, x)).cast("array<string>"))
    return out


_W = r"\p{L}\p{M}\p{N}_"
_CHECKS_SQL = rf"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 4 >= 2 AS docx, doc_id % 6 AS k FROM documents),
f AS (SELECT *, length(regexp_replace(t, '\s', '', 'g')) AS visible, len(regexp_extract_all(t, '\(cid:\d+\)|\x{{FFFD}}|[\x{{E000}}-\x{{F8FF}}]')) AS bad, regexp_extract(t, '[{_W}.+-]{{1,64}}@[{_W}-]+(?:\.[{_W}-]+)+') AS mail,
  len(list_filter(regexp_extract_all(t, '\+?\d[\d\s().-]{{5,}}\d'), lambda m: length(regexp_replace(m, '\D', '', 'g')) >= 7 AND len(list_filter(regexp_extract_all(m, '\d+'), lambda g: NOT regexp_full_match(g, '(19|20)\d\d|0?[1-9]|1[0-2]'))) > 0)) > 0 AS phone FROM b),
s AS (SELECT doc_id, t, docx,
  CASE WHEN visible < 50 THEN 'fail' ELSE 'pass' END AS text_layer,
  CASE WHEN bad > 0.05 * greatest(1, visible) THEN 'fail' WHEN bad > 0.005 * greatest(1, visible) THEN 'warn' ELSE 'pass' END AS garbled,
  CASE WHEN k = 0 THEN 'fail' ELSE 'pass' END AS multi_column, CASE WHEN k = 1 THEN 'warn' WHEN docx THEN 'pass' END AS tables, CASE WHEN docx THEN 'pass' END AS text_boxes,
  CASE WHEN k IN (1, 4) THEN 'warn' WHEN docx THEN 'pass' END AS margins, CASE WHEN k = 2 THEN 'warn' ELSE 'pass' END AS images,
  CASE WHEN mail = '' THEN 'fail' WHEN NOT phone OR round((strpos(t, mail) - 1) / greatest(1, length(t)), 2) > 0.25 THEN 'warn' ELSE 'pass' END AS contact,
  CASE WHEN regexp_matches(t, '\b(?:19|20)\d\d\b') THEN 'pass' ELSE 'warn' END AS dates FROM f)
SELECT doc_id, concat_ws(',', text_layer, garbled, '-', multi_column, coalesce(tables, '-'), coalesce(text_boxes, '-'), coalesce(margins, '-'), images, '-', contact, dates) AS statuses,
CAST(greatest(0, 100 - CASE text_layer WHEN 'fail' THEN 30 ELSE 0 END - CASE garbled WHEN 'fail' THEN 30 WHEN 'warn' THEN 15 ELSE 0 END - CASE multi_column WHEN 'fail' THEN 12 ELSE 0 END - CASE tables WHEN 'warn' THEN 6 ELSE 0 END - CASE margins WHEN 'warn' THEN 6 ELSE 0 END - CASE images WHEN 'warn' THEN 2 ELSE 0 END) AS INTEGER) AS overall_score,
CASE WHEN text_layer = 'fail' THEN 'none' WHEN garbled = 'fail' THEN 'partial' ELSE 'full' END AS extractability FROM s"""


@query("doc_check_report", _CHECKS_SQL)
def doc_check_report(spark, sf):
    """The checks but for section headings, which need compatibility forms that the oracle lacks."""
    ext = F.when(F.col("doc_id") % 4 >= 2, "docx").otherwise("pdf")
    d = t(spark, sf, "documents").select("doc_id", parse_checks.view(F.col("text"), _tags(), ext).alias("v"))
    found = parse_checks.statuses(F.col("v"))
    order = [n for n in parse_checks.CHECKS if n != "section_headings"]
    d = d.select("doc_id", "v", *[found[n].alias(n) for n in order])
    kept = {n: F.col(n) for n in order}
    return d.select("doc_id", F.concat_ws(",", *[F.coalesce(n, F.lit("-")) for n in order]).alias("statuses"), parse_checks.score(kept, ["extraction", "layout"]).alias("overall_score"), parse_checks.extractability(F.col("v"), kept).alias("extractability"))


#: Five lines of a text are a page; every third page has an image.
@query("page_check_report", r"""WITH l AS (SELECT doc_id, text, doc_id % 4 >= 2 AS docx, doc_id % 6 AS k, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i // 5 AS page, string_agg(x, chr(10) ORDER BY i) AS body FROM l GROUP BY ALL),
c AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE page % 3 = 0 AND length(regexp_replace(body, '\s', '', 'g')) < 200) AS sparse FROM p GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_repeated FROM (SELECT doc_id, trim(x) AS x FROM l GROUP BY doc_id, trim(x) HAVING count(DISTINCT i // 5) > 1 AND trim(x) <> '') GROUP BY doc_id),
s AS (SELECT c.doc_id, d.docx, k, n_pages, sparse, coalesce(n_repeated, 0) AS rep, c.doc_id % 50 = 0 AS truncated, c.doc_id % 7 = 0 AS columns, length(regexp_replace(text, '\s', '', 'g')) AS visible FROM c JOIN (SELECT DISTINCT doc_id, docx, k, text FROM l) d USING (doc_id) LEFT JOIN r USING (doc_id)),
t AS (SELECT doc_id, truncated, CASE WHEN visible < 50 THEN 'fail' ELSE 'pass' END AS text_layer, CASE WHEN NOT docx THEN CASE WHEN sparse > 0 AND sparse = n_pages THEN 'fail' WHEN sparse > 0 THEN 'warn' ELSE 'pass' END END AS coverage,
 CASE WHEN k = 0 OR columns THEN 'fail' ELSE 'pass' END AS multi_column, CASE WHEN docx THEN CASE WHEN k IN (1, 4) THEN 'warn' ELSE 'pass' END WHEN n_pages < 2 THEN CASE WHEN k IN (1, 4) THEN 'warn' END WHEN rep > 0 THEN 'warn' ELSE 'pass' END AS margins,
 CASE WHEN docx THEN CASE WHEN visible - 400 >= 50 THEN 'fail' WHEN visible > 400 THEN 'warn' ELSE 'pass' END END AS boxes, CASE WHEN truncated OR n_pages > 2 THEN 'warn' ELSE 'pass' END AS page_count FROM s)
SELECT doc_id, concat_ws(',', text_layer, coalesce(coverage, '-'), multi_column, coalesce(boxes, '-'), coalesce(margins, '-'), page_count) AS statuses,
 CAST(greatest(0, 100 - CASE text_layer WHEN 'fail' THEN 30 ELSE 0 END - CASE coverage WHEN 'fail' THEN 12 WHEN 'warn' THEN 6 ELSE 0 END - CASE multi_column WHEN 'fail' THEN 12 ELSE 0 END - CASE boxes WHEN 'fail' THEN 12 WHEN 'warn' THEN 6 ELSE 0 END - CASE margins WHEN 'warn' THEN 6 ELSE 0 END - CASE page_count WHEN 'warn' THEN 2 ELSE 0 END) AS INTEGER) AS page_score,
 CASE WHEN text_layer = 'fail' THEN 'none' WHEN coalesce(coverage, 'pass') <> 'pass' OR truncated THEN 'partial' ELSE 'full' END AS extractability FROM t""")
def page_check_report(spark, sf):
    """The checks that read pages, boxes and margins, with all facts given."""
    ext = F.when(F.col("doc_id") % 4 >= 2, "docx").otherwise("pdf")
    d = t(spark, sf, "documents").select("doc_id", "text", _tags().alias("tags"), ext.alias("ext"), F.split("text", "\n").alias("l"))
    page = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 5).cast("int"))
    bodies = F.transform(page, lambda i: F.slice("l", i * 5 + 1, F.lit(5)))
    d = d.withColumn("bodies", bodies)
    pages = F.transform("bodies", lambda b, i: F.struct(F.array_join(b, "\n").alias("text"), F.when(i % 3 == 0, 1).otherwise(0).alias("n_images")))
    lines = F.flatten(F.transform("bodies", lambda b: F.array_distinct(F.transform(b, lambda x: F.trim(x)))))
    d = d.withColumns({"pages": pages, "lines": F.array_sort(F.filter(lines, lambda x: x != ""))})
    again = F.size(F.array_distinct(F.filter("lines", lambda x, i: x == F.get("lines", i - 1))))
    spare = F.greatest(parse_checks.visible_chars(F.col("text")) - 400, F.lit(0)).cast("int")
    facts = {"textbox_text": F.when(spare > 0, F.repeat(F.lit("x"), spare)), "page_count": F.size("pages"), "truncated": F.col("doc_id") % 50 == 0, "column_pages": F.when(F.col("doc_id") % 7 == 0, 1), "repeated_lines": again}
    d = d.select("doc_id", parse_checks.view(F.col("text"), F.col("tags"), F.col("ext"), F.col("pages"), **facts).alias("v"))
    order = ["text_layer", "text_coverage", "multi_column", "text_boxes", "header_footer_content", "page_count"]
    found = parse_checks.statuses(F.col("v"))
    d = d.select("doc_id", "v", *[found[n].alias(n) for n in ["garbled_glyphs", *order]])
    kept = {n: F.col(n) for n in order}
    return d.select("doc_id", F.concat_ws(",", *[F.coalesce(n, F.lit("-")) for n in order]).alias("statuses"), parse_checks.score(kept, ["extraction", "layout"]).alias("page_score"), parse_checks.extractability(F.col("v"), kept | {"garbled_glyphs": F.col("garbled_glyphs")}).alias("extractability"))


@query("doc_check_sections")
def doc_check_sections(spark, sf):
    """All twelve checks with the content score; no SQL, for the compatibility forms."""
    d = t(spark, sf, "documents").select("doc_id", parse_checks.view(F.col("text"), _tags(), F.lit("pdf")).alias("v"))
    d = d.select("doc_id", *[c.alias(n) for n, c in parse_checks.statuses(F.col("v")).items()])
    kept = {n: F.col(n) for n in parse_checks.CHECKS}
    return d.select("doc_id", F.transform(parse_checks.report(kept), lambda r: F.concat_ws(":", r["id"], r["status"])).alias("checks"), parse_checks.score(kept, ["content"]).alias("content_score"))


_edge = lambda words: rf"(?:^|[^{_W}])(?:{'|'.join(words)})(?:$|[^{_W}])"
_any = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"
_code = lambda name, cond: f"CASE WHEN {cond} THEN '{name}' END"
_BLOCK = {n: "regexp_extract(t, '" + p + "', 1)" for n, p in older.BLOCKS.items()}
_FORM = {
    "EMAIL_NOT_FOUND": (5, "doc_id % 2 = 0"),
    "PHONE_NOT_FOUND": (3, "true"),
    "LINKEDIN_URL_MISSING": (2, "doc_id % 3 <> 0"),
    "SPECIAL_UNICODE_SYMBOLS_DETECTED": (4, f"regexp_matches(t, '[{older.SIGNS}]')"),
    "INCONSISTENT_DATE_FORMAT": (3, rf"regexp_matches(t, '\d\d/\d{{4}}') AND regexp_matches(t, '(?:{older.MONTHS})\w*\s+\d{{4}}')"),
    "PASSIVE_VOICE_DETECTED": (3, f"regexp_matches(t, '(?i){_edge(older.PASSIVE)}')"),
    "PERSONAL_PRONOUNS_DETECTED": (3, f"regexp_matches(t, '{_edge(older.PRONOUNS)}')"),
    **{f"SPELLING_ERROR:{w}": (2, f"contains(low, '{w}')") for w in older.MISSPELT},
    "NO_QUANTIFIED_ACHIEVEMENTS": (3, f"NOT regexp_matches(t, '{older.FIGURES}')"),
}
_VERBS = " + ".join(f"contains(lower(work), '{v}')::INT" for v in older.VERBS)
_HAS = {n: ("doc_id % 4 = 0 OR " if n == "summary" else "") + _any("low", words) for n, (_, words) in older.SECTIONS.items()}
_PART = {
    **{f"{n.upper()}_MISSING": f"NOT ({h})" for n, h in _HAS.items()},
    "SUMMARY_TOO_SHORT": "summary <> '' AND ends < 3",
    "SUMMARY_TOO_LONG": "summary <> '' AND ends > 6",
    "LOW_SKILL_COUNT": "doc_id % 40 < 10",
    "TOO_MANY_SKILLS": "doc_id % 40 > 30",
    "FEW_ACTIVE_VERBS_IN_EXPERIENCE": f"work <> '' AND {_VERBS} < 3",
    "EXPERIENCE_NOT_REVERSE_CHRONOLOGICAL": "work <> '' AND len(list_filter(range(1, len(starts)), lambda i: starts[i] < starts[i + 1])) > 0",
    "CERTS_MISSING_ACRONYM_FORMAT": r"papers <> '' AND NOT regexp_matches(papers, '\([A-Z]{2,}\)')",
}
_TAG_LISTS = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN [{', '.join(repr(x) for x in tags)}]" for i, tags in enumerate(TAGS) if tags) + " ELSE [] END"
_TAG_COST = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {sum(older.TAG_COST[x] for x in tags)}" for i, tags in enumerate(TAGS) if tags) + " ELSE 0 END"


@query("older_scores", rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents),
b AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'One. Two.' ELSE trim({_BLOCK['summary']}, E' \t\n\r') END AS summary, {_BLOCK['experience']} AS work, {_BLOCK['certifications']} AS papers FROM a),
c AS (SELECT *, len(regexp_extract_all(summary, '[.!?]+')) AS ends, regexp_extract_all(work, '\d\d/(\d{{4}})\s*[-–]', 1) AS starts FROM b),
d AS (SELECT doc_id, CAST(greatest(0, 40 - {_TAG_COST} - {' - '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for p, c in _FORM.values())}) AS INTEGER) AS format_score,
  CAST({' + '.join(f'CASE WHEN {_HAS[n]} THEN {p} ELSE 0 END' for n, (p, _) in older.SECTIONS.items())} AS INTEGER) AS section_score,
  array_to_string(list_concat({_TAG_LISTS}, list_filter([{', '.join([_code(n, c) for n, (_, c) in _FORM.items()] + [_code(n, c) for n, c in _PART.items()])}], lambda x: x IS NOT NULL)), ',') AS issues FROM c)
SELECT doc_id, format_score, section_score, format_score + section_score + 20 AS total_score, CASE WHEN format_score + section_score + 20 >= 85 THEN 'EXCELLENT' WHEN format_score + section_score + 20 >= 75 THEN 'GOOD' WHEN format_score + section_score + 20 >= 60 THEN 'PASS' ELSE 'FAIL' END AS grade, issues FROM d""")
def older_scores(spark, sf):
    k = F.col("doc_id")
    d = t(spark, sf, "documents").select(
        "doc_id",
        "text",
        _tags().alias("tags"),
        F.when(k % 2 == 1, F.create_map(F.lit("email"), F.lit("a@b.c"))).alias("contact"),
        F.when(k % 4 == 0, F.create_map(F.lit("summary"), F.lit("One. Two."))).alias("sections"),
        F.array_repeat(F.lit("s"), (k % 40).cast("int")).alias("skills"),
        F.when(k % 3 == 0, "Oiler").alias("rank"),
    )
    return older.scored(d, "text", "tags", "contact", "sections", "skills", "rank").select("doc_id", "format_score", "section_score", "total_score", "grade", F.array_join("issues", ",").alias("issues"))


POSTINGS = [("v0", "Required: the licensed engine of a ship, with knowledge of and in safety"), ("v1", "der Die und das; well-known der engine"), ("v2", " "), ("v3", "required minimum years")]
STOP = ["the", "and", "of", "to", "in", "is", "a"]
_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_clean = lambda col: rf"regexp_replace(lower(coalesce({col}, '')), '[^{_W}\s-]', ' ', 'g')"
_terms = lambda: "list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))"


@query("older_keywords", rf"""WITH post AS (SELECT * FROM {values(POSTINGS, 'vac, posting')}),
d AS (SELECT doc_id, 'v' || (doc_id % 4) AS vac, {_clean('text')} AS c FROM documents), p AS (SELECT vac, {_clean('posting')} AS c FROM post),
dk AS (SELECT *, list_filter(regexp_extract_all(c, '[{_W}]{{2,}}'), lambda x: x NOT IN {_in(STOP)}) AS k FROM d), pk AS (SELECT *, list_filter(regexp_extract_all(c, '[{_W}]{{2,}}'), lambda x: x NOT IN {_in(STOP)}) AS k FROM p),
dt AS (SELECT doc_id, vac, x, count(*) AS n FROM (SELECT doc_id, vac, unnest({_terms()}) AS x FROM dk) GROUP BY ALL),
pt AS (SELECT doc_id, x, count(*) AS m FROM (SELECT doc_id, unnest({_terms()}) AS x FROM pk JOIN (SELECT doc_id, vac FROM d) USING (vac)) GROUP BY ALL),
u AS (SELECT coalesce(dt.doc_id, pt.doc_id) AS doc_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, CASE WHEN n IS NULL OR m IS NULL THEN 1 + ln(1.5) ELSE 1.0 END AS w FROM dt FULL JOIN pt ON dt.doc_id = pt.doc_id AND dt.x = pt.x),
cos AS (SELECT doc_id, coalesce(sum(n * m * w * w) / nullif(sqrt(sum(n * n * w * w) * sum(m * m * w * w)), 0), 0) AS s FROM u GROUP BY doc_id),
pw AS (SELECT vac, list_filter(list_distinct(string_split_regex(c, '\s+')), lambda x: x <> '' AND x NOT IN {_in(older.FILLER)}) AS wanted FROM p),
j AS (SELECT d.doc_id, wanted, list_filter(wanted, lambda x: list_contains(string_split_regex(c, '\s+'), x)) AS found, coalesce(s, 0) AS s FROM d JOIN pw USING (vac) LEFT JOIN cos USING (doc_id)),
r AS (SELECT doc_id, CASE WHEN len(wanted) > 0 THEN round(len(found) / len(wanted) * 100, 1) END AS match_pct, CASE WHEN len(wanted) > 0 THEN round(s * 100, 1) END AS cosine_pct, array_to_string(list_sort(list_filter(wanted, lambda x: NOT list_contains(found, x)))[1:15], ',') AS missing FROM j)
SELECT doc_id, match_pct, cosine_pct, missing, CAST(CASE WHEN match_pct IS NULL THEN 20 ELSE least(40, greatest(0, floor(round((match_pct * 0.7 + cosine_pct * 0.3) * 0.4, 9)))) END AS INTEGER) AS keyword_points FROM r""")
def older_keywords(spark, sf):
    d = t(spark, sf, "documents").withColumn("vac", F.concat(F.lit("v"), (F.col("doc_id") % 4).cast("string")))
    p = spark.createDataFrame(POSTINGS, "vac string, posting string")
    return older.keyword_points(d, "doc_id", "text", "vac", p, "posting", STOP).select("doc_id", "match_pct", "cosine_pct", F.array_join("missing", ",").alias("missing"), "keyword_points")


_END = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}|\d{1,2}/\d{4}|\d{4}"


@query("doc_first_range", rf"SELECT doc_id, regexp_extract(coalesce(text, ''), '(?i)(?:{_END})\s*[-–]\s*(?:{_END}|Present|Current)') AS first_range FROM documents")
def doc_first_range(spark, sf):
    return t(spark, sf, "documents").select("doc_id", dates.first_range(F.col("text")).alias("first_range"))


@query("order_service_lines", """SELECT o_orderkey, '01/2020' || CASE o_orderkey % 4 WHEN 0 THEN '   —   Sea Star (GRT 5,123)' WHEN 1 THEN '   —   GRT 62795' WHEN 2 THEN '   —   M.V. Long Name (GRT 7)' ELSE '   —   Mate' END || '   —   ' || o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN '|Cook' ELSE '' END AS record FROM orders""")
def order_service_lines(spark, sf):
    k = F.col("o_orderkey") % 4
    bullet = F.when(k == 0, "Served aboard Sea Star, GRT 5,123, in trade").when(k == 1, "Kept engines; GRT: 62795").when(k == 2, "on M.V. Long Name (GRT - 7)").otherwise("Kept watch")
    entry = lambda dates_, role, company, bullets: F.struct(dates_.alias("dates"), role.alias("role"), company.alias("company"), bullets.alias("bullets"))
    ship = entry(F.lit("01/2020"), F.lit("Mate"), F.col("o_orderpriority"), F.array(F.lit("none"), bullet))
    cook = entry(F.lit(""), F.lit("Cook"), F.lit(None).cast("string"), F.array().cast("array<string>"))
    entries = F.when(F.col("o_custkey") % 2 == 0, F.array(ship, cook, ship)).otherwise(F.array(ship, ship))
    return t(spark, sf, "orders").select("o_orderkey", F.array_join(profile.service_lines(entries), "|").alias("record"))


@query("customer_sections", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Skills and Languages:' || c_mktsegment || '+en' ELSE 'Training:|Certificates:|Education:|Skills and Languages:' || c_mktsegment || '+en|Foreign Work / Hotel Experience:|Professional Experience:' END || CASE WHEN c_custkey % 3 = 0 THEN '|Summary:' || c_name ELSE '' END AS sections FROM customer""")
def customer_sections(spark, sf):
    base = F.create_map(F.lit("skills"), F.array("c_mktsegment"), F.lit("languages"), F.array(F.lit("en")))
    content = F.when(F.col("c_custkey") % 3 == 0, F.map_concat(base, F.create_map(F.lit("summary"), F.array("c_name")))).otherwise(base)
    s = profile.ordered_sections(content, F.col("c_custkey") % 2 == 0)
    return t(spark, sf, "customer").select("c_custkey", F.array_join(F.transform(s, lambda x: F.concat(x["heading"], F.lit(":"), F.array_join(x["items"], "+"))), "|").alias("sections"))


@query("part_certificate_terms", "SELECT p_type, count(*) AS n, contains(lower(p_type), 'brass') OR contains(lower(p_type), 'ar') OR contains('small plated steel and more', lower(p_type)) AS is_certificate FROM part GROUP BY p_type")
def part_certificate_terms(spark, sf):
    terms = t(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return terms.select("p_type", "n", profile.is_certificate(F.col("p_type"), ["Brass", "AR", "Small plated steel and more"]).alias("is_certificate"))

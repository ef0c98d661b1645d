"""Nested records: repair of drifting JSON, coercion, flattening, reshaping; all within one row, none shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a rewritten record, and names that drifted records use for them.
FIELDS = {"summary": "string", "rank": "string", "skills": "list", "certifications": "list", "education": "list", "languages": "list", "technical_expertise": "list", "issues_fixed": "list"}
ALIASES = {"summary": ["professional_summary", "profile", "objective"], "rank": ["current_rank", "position"], "skills": ["key_skills", "core_skills"], "certifications": ["certificates", "certs"], "education": ["qualifications"], "languages": ["language"], "technical_expertise": ["technical_skills", "expertise"], "issues_fixed": ["fixes", "issues"]}
WRAPPERS = ["resume", "result", "data", "output", "rewritten_resume"]
BULLETS_MOST, NAME_MOST = 24, 200
LIMITS = {"officer": {"skills": 18, "roles": 6, "words": 1150}, "crew": {"skills": 15, "roles": 3, "words": 600}}
SENTENCES_MOST, BULLETS_EACH = 3, 3
SKILLS_FLOOR, BULLETS_FLOOR = 10, 2


def json_text(raw: Column) -> Column:
    """The JSON object in a model's answer: without code fences, or else from the first brace to the last; null if none."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(F.regexp_extract(raw, r"(?s)(\{.*\})", 1)), F.lit(""))


def as_text(value: Column) -> Column:
    """A JSON value as one string: lists and objects have their scalar values joined by ', ', null and blanks none."""
    v = F.trim(value)
    items = F.from_json(v, "array<string>")
    parts = F.from_json(v, "map<string,string>")
    joined = lambda a: F.array_join(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""), ", ")
    return F.nullif(F.when(v.startswith("["), joined(F.transform(items, as_scalar))).when(v.startswith("{"), joined(F.map_values(parts))).otherwise(v), F.lit(""))


def as_scalar(value: Column) -> Column:
    """A list's entry as one string: of an object its values."""
    parts = F.map_values(F.from_json(value, "map<string,string>"))
    return F.when(F.trim(value).startswith("{"), F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), ", ")).otherwise(value)


def as_list(value: Column) -> Column:
    """A JSON value as a list of strings: a list's entries, or a scalar cut at commas, semicolons and bars; null is empty."""
    v = F.trim(value)
    items = F.when(v.startswith("["), F.transform(F.from_json(v, "array<string>"), as_scalar)).when(v.startswith("{"), F.array(as_text(v))).otherwise(F.split(v, r"\s*[,;|]\s*"))
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def repaired(rows: DataFrame, raw: Column, truncated: Column, name: str) -> DataFrame:
    """Rows with ``name``: STRUCT of FIELDS from a drifted JSON answer.

    One wrapper is opened; keys count without case, blanks, hyphens and underscores, under their own name first and then
    under known other ones, the first of equal keys; values are coerced. What is missing gets its default, unless the
    answer was cut off: then null. Steps are columns of their own, so that no JSON is parsed twice.
    """
    d = rows.withColumn("_outer", F.from_json(json_text(raw), "map<string,string>"))
    wrapped = F.coalesce(*[F.when(F.col("_outer")[w].startswith("{"), F.col("_outer")[w]) for w in WRAPPERS])
    d = d.withColumn("_wrapped", wrapped).withColumn("_inner", F.when(F.col("_wrapped").isNotNull(), F.from_json("_wrapped", "map<string,string>")).otherwise(F.col("_outer")))
    d = d.withColumn("_plain", F.transform(F.map_entries("_inner"), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), r"[\s_-]", "").alias("key"), e["value"].alias("value"))))
    at = lambda key: F.get(F.filter("_plain", lambda e: e["key"] == key.replace("_", "")), F.lit(0))["value"]
    d = d.withColumns({f"_raw_{f}": F.coalesce(*[at(n) for n in [f, *ALIASES[f]]]) for f in FIELDS})
    out = []
    for f, kind in FIELDS.items():
        value = F.col(f"_raw_{f}")
        known = as_text(value) if kind == "string" else F.when(value.isNotNull(), as_list(value))
        default = F.lit("") if kind == "string" else F.array().cast("array<string>")
        out.append(F.coalesce(known, F.when(~F.coalesce(truncated, F.lit(False)), default)).alias(f))
    return d.withColumn(name, F.struct(*out)).drop("_outer", "_wrapped", "_inner", "_plain", *[f"_raw_{f}" for f in FIELDS])


def leaves(record: Column, fields: list[str], sep: str = "\n") -> Column:
    """The string leaves of a record in the order of ``fields``; a path steps into structs, and a list's entries join."""
    return F.array_join(F.filter(F.array(*[F.array_join(F.filter(_values(record, f), lambda x: F.trim(x) != ""), sep) for f in fields]), lambda x: x != ""), sep)


def _field(name: str):
    return lambda record: record[name]


def _values(record: Column, path: str) -> Column:
    """The strings at a path as a list; '[]' behind a name means a list, of which each entry is stepped into."""
    out: Column = F.array(record)
    for step in path.split("."):
        many, name = step.endswith("[]"), step.removesuffix("[]")
        out = F.transform(out, _field(name))
        if many:
            out = F.flatten(F.filter(out, lambda x: x.isNotNull()))
    return F.filter(F.transform(out, lambda x: x.cast("string")), lambda x: x.isNotNull())


def contains_text(record: Column, fields: list[str], wanted: Column) -> Column:
    """Whether some leaf contains the text, in its case; a blank text is in none."""
    return F.when(F.trim(wanted) == "", F.lit(False)).otherwise(F.contains(leaves(record, fields), wanted))


def visible(sections: Column, hidden: Column) -> Column:
    """A map of sections without those named as hidden; a null list hides none."""
    return F.map_filter(sections, lambda k, v: ~F.coalesce(F.array_contains(hidden, k), F.lit(False)))


def all_bullets(entries: Column, most: int = BULLETS_MOST) -> Column:
    """The bullets of all entries (ARRAY<STRUCT<bullets ARRAY<STRING>>>) in order, without blanks."""
    return F.slice(F.filter(F.flatten(F.filter(F.transform(entries, lambda e: e["bullets"]), lambda b: b.isNotNull())), lambda x: F.trim(x) != ""), 1, most)


def date_strings(entries: Column) -> Column:
    """The years of all entries, without blanks."""
    return F.filter(F.transform(entries, lambda e: F.trim(e["years"])), lambda x: x != "")


def as_resume(name: Column, title: Column, summary: Column, bullets: Column, institutions: Column, skills: Column, languages: Column) -> Column:
    """The nested record that scores read; bullets and names are held to their limits."""
    none = F.array().cast("array<string>")
    work = F.array(F.struct(title.alias("title"), F.slice(F.coalesce(bullets, none), 1, BULLETS_MOST).alias("bullets")))
    school = F.transform(F.coalesce(institutions, none), lambda x: F.struct(F.substring(x, 1, NAME_MOST).alias("institution")))
    return F.struct(F.struct(name.alias("name"), title.alias("title")).alias("personalInfo"), F.coalesce(summary, F.lit("")).alias("summary"), work.alias("workExperience"), school.alias("education"), F.struct(F.coalesce(skills, none).alias("technicalSkills"), F.coalesce(languages, none).alias("languages")).alias("additional"))


def with_missing(section: Column, wanted: Column) -> Column:
    """A list with those wanted terms behind it that it lacks, without case."""
    low = F.transform(section, lambda x: F.lower(x))
    return F.concat(section, F.filter(F.array_distinct(wanted), lambda x: ~F.array_contains(low, F.lower(x))))


def first_distinct(items: Column, most: int) -> Column:
    return F.slice(F.array_distinct(items), 1, most)


def _words(items: Column) -> Column:
    """Words of each entry of a list."""
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"\S+")))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def limited(rows: DataFrame, content: str, officer: Column, name: str) -> DataFrame:
    """Rows with ``name``: a record held to the limits of officers or crews in number and in words.

    ``content`` is a struct of skills, summary (sentences), certifications, education, languages (lists of strings) and
    roles (ARRAY<STRUCT<title, company, bullets>>); null lists are empty, null strings have no words. After the limits
    in number, and while too many words stand, skills go from the end down to SKILLS_FLOOR, then third bullets from the
    first role on, down to BULLETS_FLOOR each. No role, certificate or other entry goes; ``compact`` says that the record
    is still too long, ``n_words`` how long it is. What is dropped follows from running sums, not from a loop.
    """
    pick = lambda k: F.when(officer, LIMITS["officer"][k]).otherwise(LIMITS["crew"][k])
    c, none = F.col(content), F.array().cast("array<string>")
    full = lambda x: F.coalesce(x, none)
    roles = F.transform(F.slice(F.filter(F.coalesce(c["roles"], F.array()), lambda r: r.isNotNull()), F.lit(1), pick("roles")), lambda r: F.struct(r["title"].alias("title"), r["company"].alias("company"), F.slice(full(r["bullets"]), 1, BULLETS_EACH).alias("bullets")))
    d = rows.withColumns({"_skills": F.slice(full(c["skills"]), F.lit(1), pick("skills")), "_summary": F.slice(full(c["summary"]), 1, SENTENCES_MOST), "_roles": roles, "_limit": pick("words")})
    fixed = sum((_total(_words(x)) for x in (F.col("_summary"), c["certifications"], c["education"], c["languages"])), F.lit(0)) + F.when(F.size("_roles") > 0, 10 + 8 * F.size("_roles")).otherwise(0)
    titles = _total(_words(F.transform("_roles", lambda r: r["title"]))) + _total(_words(F.transform("_roles", lambda r: r["company"])))
    bullets = F.transform("_roles", lambda r: _words(r["bullets"]))
    d = d.withColumns({"_fixed": fixed + titles, "_skill_words": _words(F.col("_skills")), "_bullet_words": bullets})
    first = lambda n: _total(F.slice("_skill_words", F.lit(1), n))
    d = d.withColumn("_all_bullets", _total(F.flatten("_bullet_words")))
    floor = F.least(F.size("_skills"), F.lit(SKILLS_FLOOR))
    fits = F.filter(F.sequence(floor, F.size("_skills")), lambda n: F.col("_fixed") + F.col("_all_bullets") + first(n) <= F.col("_limit"))
    d = d.withColumn("_n_skills", F.coalesce(F.array_max(fits), floor))
    d = d.withColumn("_over", F.col("_fixed") + F.col("_all_bullets") + first(F.col("_n_skills")) - F.col("_limit"))
    spare = F.transform("_bullet_words", lambda w: _total(F.slice(w, BULLETS_FLOOR + 1, BULLETS_EACH)))
    d = d.withColumn("_spare", spare)
    before = lambda i: _total(F.slice("_spare", F.lit(1), i))
    cut = lambda r, i: (F.size(r["bullets"]) > BULLETS_FLOOR) & (F.col("_over") > before(i))
    kept = F.transform("_roles", lambda r, i: F.struct(r["title"].alias("title"), r["company"].alias("company"), F.when(cut(r, i), F.slice(r["bullets"], 1, BULLETS_FLOOR)).otherwise(r["bullets"]).alias("bullets")))
    gone = _total(F.transform("_spare", lambda w, i: F.when(F.col("_over") > before(i), w).otherwise(0)))
    record = F.struct(F.slice("_skills", F.lit(1), F.col("_n_skills")).alias("skills"), F.col("_summary").alias("summary"), *[full(c[x]).alias(x) for x in ("certifications", "education", "languages")], kept.alias("roles"), (F.col("_limit") + F.col("_over") - gone).alias("n_words"), (F.col("_over") > gone).alias("compact"))
    return d.withColumn(name, record).drop("_skills", "_summary", "_roles", "_limit", "_fixed", "_skill_words", "_bullet_words", "_all_bullets", "_n_skills", "_over", "_spare")

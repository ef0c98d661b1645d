"""Service months from the lines of a text, and section headings; Columns over one row, none shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import lines, normalized

# Words of lines that hold no service, forms of dates, limits; headings by language and section.
NO_SERVICE = ["passport", "visa", "dob", "born", "coc ", "cdc ", "indos", "medical", "expiry", "valid till"]
DATE = r"\d{2}/\d{4}|\d{4}-\d{2}-\d{2}"
NOW = "[Pp]resent|[Cc]urrent|[Dd]ate"
YEARS, PAIR_DAYS, MONTH_DAYS, MOST_MONTHS = (2005, 2026), 365 * 4, 30, 400
HEADINGS = {
    "en": {
        "summary": ["summary", "profile", "professional summary", "about me", "objective"],
        "experience": ["experience", "work experience", "professional experience", "employment history", "work history", "employment", "sea service", "sea service record"],
        "education": ["education", "academic background", "qualifications"],
        "skills": ["skills", "technical skills", "core competencies", "competencies"],
        "projects": ["projects", "personal projects"],
        "certifications": ["certifications", "certificates", "licenses", "stcw"],
    }
}
REQUIRED = ["experience", "education", "skills"]


def _day(x: Column) -> Column:
    return F.coalesce(F.when(x.rlike(r"^\d{2}/"), F.to_date(F.try_to_timestamp(x, F.lit("MM/yyyy")))), F.when(x.rlike(r"^\d{4}-"), F.to_date(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")))))


def service_periods(text: Column, as_of: Column, date: str = DATE) -> Column:
    """ARRAY<STRUCT<s, e>>: ranges of a text's lines that begin in YEARS; without any, its dates in order, two by two, less than PAIR_DAYS apart."""
    inside = lambda d: F.year(d).between(*YEARS)
    span = rf"({date})\s*[-–]\s*({date}|{NOW})"
    real = F.filter(lines(text), lambda x: ~F.lower(x).rlike("|".join(NO_SERVICE)))
    pairs = F.flatten(F.transform(real, lambda x: F.arrays_zip(F.regexp_extract_all(x, F.lit(span), 1).alias("a"), F.regexp_extract_all(x, F.lit(span), 2).alias("b"))))
    whole = F.transform(pairs, lambda p: F.struct(_day(p["a"]).alias("s"), F.when(p["b"].rlike(f"^(?:{NOW})$"), as_of).otherwise(_day(p["b"])).alias("e")))
    whole = F.filter(whole, lambda p: F.coalesce((p["e"] > p["s"]) & inside(p["s"]), F.lit(False)))
    dates = F.array_sort(F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({date})"), 1), _day), lambda d: F.coalesce(inside(d), F.lit(False))))
    at = lambda d: F.filter(F.sequence(F.lit(1), F.size(d)), lambda k: (k % 2 == 1) & (k < F.size(d)))
    two = let(dates, lambda d: F.when(F.size(d) > 1, F.transform(at(d), lambda k: F.struct(F.get(d, k - 1).alias("s"), F.get(d, k).alias("e")))))
    two = F.filter(two, lambda p: (p["e"] > p["s"]) & (F.date_diff(p["e"], p["s"]) < PAIR_DAYS))
    return let(whole, lambda p: F.when(F.size(p) > 0, p).otherwise(F.coalesce(two, F.array().cast("array<struct<s:date,e:date>>"))))


def whole_months(periods: Column) -> Column:
    """Months of the union of periods: whole ones of MONTH_DAYS days of each merged stretch, at most MOST_MONTHS."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("date").alias("s"), F.lit(None).cast("date").alias("e"))
    done = lambda a: a["n"] + F.coalesce(F.floor(F.date_diff(a["e"], a["s"]) / MONTH_DAYS).cast("int"), F.lit(0))

    def step(a, p):
        joins = F.coalesce(p["s"] <= a["e"], F.lit(False))
        return F.struct(F.when(joins, a["n"]).otherwise(done(a)).alias("n"), F.when(joins, a["s"]).otherwise(p["s"]).alias("s"), F.when(joins, F.greatest(a["e"], p["e"])).otherwise(p["e"]).alias("e"))

    return F.least(F.aggregate(F.array_sort(periods), start, step, done), F.lit(MOST_MONTHS))


def synonyms(kind: str, locale: str | None = None) -> list[str]:
    """The headings of a section in a language and in English; in every known language without one."""
    base = (locale or "").split("-")[0].lower()
    known = [base, "en"] if base in HEADINGS else list(HEADINGS)
    return [s for language in dict.fromkeys(known) for s in HEADINGS[language].get(kind, [])]


def sections_found(text: Column, locale: str | None = None, kinds: list[str] | None = None) -> Column:
    """The kinds of sections that short lines of the text head."""
    short = F.filter(F.split(normalized(text), r"\R"), lambda x: (F.length(x) <= 60) & (F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")).between(1, 6)))
    heads = F.transform(short, lambda x: F.regexp_replace(x, r"^[ :•|]+|[ :•|]+$", ""))
    found = []
    for kind in kinds or REQUIRED:
        names = "|".join(sorted(map(_quoted, synonyms(kind, locale)), key=len, reverse=True))
        pattern = rf"^(?:{names})(?:\s*(?:{names})?$|\s*[^\p{{L}}\p{{N}}_\s]|\s*(?:and|y|e|et|및)\s|\s*[与和及])"
        found.append(F.when(F.exists(heads, _like(pattern)), F.lit(kind)))
    return F.array_compact(F.array(*found))


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def _quoted(name: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in name)


def section_status(found: Column) -> Column:
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), found)
    return F.when(F.size(missing) == 0, "pass").when(F.array_contains(missing, "experience") | (F.size(missing) > 1), "fail").otherwise("warn")

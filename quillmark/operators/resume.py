"""Layered scores of nested résumé records, as Columns over one row; none shuffles.

``text`` stands for the whole visible text, ``posting`` for the posting's keywords.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers

# Weights of the sub-scores, title scores, stop words of titles, date styles, headings.
WEIGHTS = {"keyword_match": 0.40, "skills_coverage": 0.20, "title_match": 0.15, "section_completeness": 0.15, "date_consistency": 0.10}
IN_HEADLINE, IN_SUMMARY, OVERLAP_MOST = 100.0, 75.0, 50.0
TITLE_STOP = ["a", "an", "and", "the", "of", "for", "in", "to", "at", "&"]
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
YEAR = r"(?:19|20)\d{2}"
STYLES = {"iso": rf"\b{YEAR}[-/]\d{{1,2}}\b", "numeric": rf"\b\d{{1,2}}[/.-]{YEAR}\b", "name_year": rf"\b(?i:{MONTH})\.?,?\s+{YEAR}\b", "name_short_year": rf"\b(?i:{MONTH})\.?\s+'\d{{2}}\b", "year": rf"\b{YEAR}\b"}
#: Phone numbers by shapes that no range of years has: their groups of four digits aren't years.
PHONE = r"\+\d[\d ().-]{8,}\d|\(\d{3}\) ?\d{3}[-. ]\d{4}\b|(?<![\d-])\d{3}([-. ])\d{3}\1\d{4}\b"
HEADERS = ["summary", "professional summary", "profile", "objective", "experience", "work experience", "employment history", "sea service", "sea service record", "skills", "technical skills", "certifications", "certificates", "education", "languages", "documents", "license", "licence", "training", "references", "contact", "contact information"]
STRICT_PLATFORMS = ["successfactors", "taleo", "greenhouse"]
SENIOR_RANKS = ["master", "chief engineer", "chief officer", "second engineer"]
SERVICE_GRADES = [(55, "STRONG"), (35, "ADEQUATE")]
PLACEHOLDERS = ["Actual Issuing Authority", "Issuing Authority", "| Year", "See service record"]


def holds_term(text: Column, term: Column) -> Column:
    """Whole-term, case-insensitive, for terms that are data; a blank or null term is in no text."""
    low = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace(low, r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(r"(?!\w)"))
    return F.when(low == "", F.lit(False)).otherwise(F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), pattern))


def title_words(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return F.array_except(found, F.array(*[F.lit(w) for w in TITLE_STOP]))


def title_match(role: Column, headline: Column, summary: Column) -> Column:
    """100 with the role in the headline, 75 in the summary, else up to 50 by shared words; null without a role."""
    wanted = title_words(role)
    share = F.try_divide(F.size(F.array_intersect(wanted, title_words(headline))), F.size(wanted))
    blank = F.trim(F.coalesce(role, F.lit(""))) == ""
    return F.when(blank, F.lit(None)).when(holds_term(headline, role), IN_HEADLINE).when(holds_term(summary, role), IN_SUMMARY).otherwise(F.bround(F.coalesce(share, F.lit(0.0)) * OVERLAP_MOST, 1))


def skills_coverage(wanted: Column, skills: Column, text: Column) -> Column:
    """Share in per cent of the wanted skills that are listed or in the text; repeats count; 0 without any."""
    listed = F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.lower(s))
    hit = F.filter(wanted, lambda w: F.coalesce(F.array_contains(listed, F.lower(w)), F.lit(False)) | holds_term(text, w))
    return F.coalesce(F.try_divide(100.0 * F.size(hit), F.size(wanted)), F.lit(0.0))


def date_styles(text: Column) -> dict[str, Column]:
    """Style -> how many dates of the text are written so; each place counts for the first style that fits."""
    left, out = F.coalesce(text, F.lit("")), {}
    for name, pattern in STYLES.items():
        out[name] = F.regexp_count(left, F.lit(pattern)).cast("bigint")
        left = F.regexp_replace(left, pattern, " ; ")
    return out


def date_consistency(text: Column) -> Column:
    """Share in per cent of the commonest style; null with fewer than two dates."""
    n = list(date_styles(text).values())
    total = sum(n[1:], n[0])
    return F.when(total >= 2, F.bround(100.0 * F.greatest(*n) / total, 1))


def section_completeness(summary: Column, work: Column, education: Column, skills: Column, contact: Column, headings: Column) -> Column:
    """Fifths for the four sections and contact; without sections, ``headings`` (found in the text, 0 to 4) stand in."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    found, known = flag(summary) + flag(work) + flag(education) + flag(skills), flag(contact)
    return F.when(found > 0, (found + known) * 20.0).when(F.coalesce(headings, F.lit(0)) == 0, 0.0).when(known == 1, (headings + 1) * 20.0).otherwise(headings * 25.0)


def overall(scores: dict[str, Column]) -> Column:
    return F.bround(F.coalesce(numbers.weighted_mean({k: (scores[k], w) for k, w in WEIGHTS.items()}), F.lit(0.0)), 1)


def in_posting_order(found: Column, posting: Column, most: int = 10) -> Column:
    """Keywords by their first place in the posting, unknown ones last, ties by lower case."""
    low = F.transform(posting, lambda p: F.lower(p))
    placed = F.transform(found, lambda k: F.struct(F.coalesce(F.nullif(F.array_position(low, F.lower(k)), F.lit(0)), F.lit(1 << 30)).alias("at"), F.lower(k).alias("low"), k.alias("k")))
    return F.slice(F.transform(F.sort_array(placed), lambda s: s["k"]), 1, most)


def recommendations(s: dict[str, Column], role: Column, missing: Column, injectable: Column) -> Column:
    """Codes of the advice that applies, in order."""
    kw, skills, sections = (F.coalesce(s[k], F.lit(0.0)) for k in ("keyword_match", "skills_coverage", "section_completeness"))
    tips = [("exact_title", (s["title_match"] < IN_HEADLINE) & (F.trim(role) != "")), ("missing_keywords", (kw < 60) & (F.size(missing) > 0)), ("source_skills", F.size(injectable) > 0), ("more_skills", skills < 60), ("sections", sections < 100), ("one_date_format", s["date_consistency"] < 100), ("strong", (kw >= 80) & (skills >= 80))]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in tips]))
    return F.when(F.size(found) == 0, F.array(F.lit("aligned"))).otherwise(found)


def looks_multi_column(lines: Column) -> Column:
    """Three or more short lines beside two or more long ones."""
    full = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(F.filter(full, lambda x: F.length(x) < 40)) >= 3) & (F.size(F.filter(full, lambda x: F.length(x) > 80)) >= 2)


def custom_header(lines: Column) -> Column:
    """Some line of at most 50 characters ends in a colon and is no standard heading."""
    name = lambda x: F.trim(F.regexp_replace(F.trim(x), ":+$", ""))
    fits = lambda x: F.trim(x).endswith(":") & (F.length(name(x)) <= 50) & (name(x) != "") & ~F.regexp_replace(F.lower(name(x)), r"\s+", " ").isin(HEADERS)
    return F.exists(lines, fits)


def format_findings(text: Column, lines: Column, platform: Column, known_columns: Column) -> Column:
    """array<struct<code, severity>>: advice on the form of the text for the platform that reads it."""
    p = F.lower(F.coalesce(platform, F.lit("unknown")))
    n = date_styles(F.regexp_replace(text, PHONE, " ; "))
    kinds = sum((F.when(c > 0, 1).otherwise(0) for c in n.values()), F.lit(0))
    named = (n["name_year"] > 0) & (kinds == 1)
    one = lambda code, severity: F.struct(F.lit(code).alias("code"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    skills = F.exists(lines, lambda x: F.lower(F.trim(x)) == "skills")
    found = [
        (F.coalesce(known_columns, F.lit(False)) | looks_multi_column(lines), one("MULTI_COLUMN_LAYOUT", F.when(p.isin(STRICT_PLATFORMS), "high_attention").otherwise("warning"))),
        ((p == "workday") & (kinds > 1), one("INCONSISTENT_DATE_FORMAT", "warning")),
        ((p == "successfactors") & (kinds > 0) & ~named, one("DATE_FORMAT_MISMATCH", "warning")),
        ((p == "successfactors") & ~skills, one("NON_STANDARD_SKILLS_HEADER", "warning")),
        (custom_header(lines), one("CUSTOM_SECTION_HEADERS", "warning")),
        (F.contains(F.coalesce(text, F.lit("")), F.lit("—")), one("EM_DASH_DETECTED", "warning")),
        (p == "taleo", one("FILE_FORMAT_ADVISORY", "info")),
    ]
    return F.array_compact(F.array(*[F.when(c, s) for c, s in found]))


def service_score(rank: Column, required: Column, held: Column, months: Column, least: Column, vessels: Column) -> Column:
    """STRUCT<score, grade, bonus, missing, coverage>: certificates 25, service 20, vessels 10, rank 10, bonus 20."""
    missing = F.array_except(required, held)
    got, n = F.size(required) - F.size(missing), F.size(required)
    certs = F.floor(got * 25 / F.greatest(n, F.lit(1)))
    service = F.when(months >= least, 20).when(months > 0, F.floor(months * 20 / F.greatest(least, F.lit(1)))).otherwise(0)
    bonus = numbers.service_bonus(months, least, F.size(vessels), (n > 0) & (got == n), F.coalesce(rank.isin(SENIOR_RANKS), F.lit(False)))
    total = (certs + service + F.when(F.size(vessels) > 0, 10).otherwise(0) + F.when(F.coalesce(rank, F.lit("unknown")) != "unknown", 10).otherwise(0) + bonus).cast("int")
    grade = F
    for least_total, name in SERVICE_GRADES:
        grade = grade.when(total >= least_total, name)
    return F.struct(total.alias("score"), grade.otherwise("WEAK").alias("grade"), bonus.cast("int").alias("bonus"), missing.alias("missing"), F.concat_ws("/", got.cast("string"), n.cast("string")).alias("coverage"))


def rewrite_verdict(before: Column, after: Column, added: Column, removed: Column) -> Column:
    """An added fact is a risk to integrity; a lower score or any lost fact is worse; null without a first score."""
    gain = after - before
    return F.when(before.isNull(), F.lit(None)).when(F.size(added) > 0, "factual_integrity_risk").when((gain < 0) | (F.size(removed) > 0), "degraded").when(gain > 0, "improved").otherwise("neutral")


def output_warnings(certifications: Column, bullets: Column, skills: Column, summary: Column) -> Column:
    """Codes of what a written output lacks; empty if it is clean."""
    stale = lambda c: F.coalesce(*[F.when(F.contains(c, F.lit(p)), F.lit(True)) for p in PLACEHOLDERS], F.lit(False))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    found = [("placeholder", F.coalesce(F.exists(certifications, stale), F.lit(False))), ("no_experience", size(bullets) <= 0), ("few_skills", size(skills) < 10), ("no_summary", F.trim(F.coalesce(summary, F.lit(""))) == "")]
    return F.array_compact(F.array(*[F.when(c, name) for name, c in found]))


def overlay_active(track: Column, target_rank: Column, target_line: Column, detected: Column, tracks: list[str], generic: list[str]) -> Column:
    """A target turns the overlay on, a generic track off; without a track a detected rank decides."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    key = F.regexp_replace(F.lower(clean(track)), "-", "_")
    known = ~F.lower(clean(detected)).isin("", "unknown")
    return F.when((clean(target_rank) != "") | (clean(target_line) != ""), True).when(key == "", known).when(key.isin(generic), False).otherwise(key.isin(tracks) | F.replace(key, F.lit("_"), F.lit(" ")).isin(tracks))


def first_given(*texts: Column) -> Column:
    """The first that isn't blank: the caller's posting before the track's, the rank's and the default."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in texts])

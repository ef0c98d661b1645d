"""The generic score of a document: points of its parse checks (up to 40) and of its content (up to 60); issues are codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from . import parse_checks
from .claims import claims_of
from .resume import holds_term

# What makes an objective generic, words that don't make it specific, duties and outcomes; points and limits.
OBJECTIVE = r"(?i)\b(?:objective|seeking|looking for|to obtain|to secure|desire(?:d)?\s+(?:a|an)?\s*position)\b"
PLAIN_TERMS = ["experience", "job", "looking", "position", "professional", "role", "seeking"]
PLAIN_ROLES = ["professional", "job"]
DUTY = r"(?iU)^\W*(?:managed|assisted|helped|supported)\b"
OUTCOME = r"(?iU)\b(?:improv\w*|reduc\w*|increas\w*|delivered|achieved|saved|grew|generated|completed|streamlined|resolved|result(?:ed)?)\b"
WORD = r"(?U)\b[\w'-]+\b"
SHARE, MOST = 0.6, 60.0
NO_SKILLS, NO_CONTACT, NO_FIGURES, NO_OBJECTIVE, VAGUE_MOST = 10, 8, 8, 5, 6
THIN, THIN_FACTOR, SHORT, SHORT_CAP, NO_WORK_CAP = 300, 0.75, 150, 20.0, 30.0


def vague(bullets: Column) -> Column:
    """Points, up to VAGUE_MOST, for the share of bullets that name a duty without an outcome."""
    n = F.size(F.filter(bullets, lambda b: b.rlike(DUTY) & ~b.rlike(OUTCOME)))
    return F.when(F.size(bullets) > 0, F.least(F.lit(VAGUE_MOST), F.bround(VAGUE_MOST * n / F.size(bullets), 0).cast("int"))).otherwise(0)


def specific(objective: Column, role: Column, skills: Column) -> Column:
    """Whether an objective names the role or a skill that it is about."""
    low = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    by_role = (low != "") & ~low.isin(PLAIN_ROLES) & holds_term(objective, role)
    return by_role | F.exists(skills, lambda s: F.coalesce((s != "") & ~F.lower(s).isin(PLAIN_TERMS) & holds_term(objective, s), F.lit(False)))


def content(rows: DataFrame) -> DataFrame:
    """Rows with content_points and content_issues.

    Reads ats_score, text, bullets, skills (of the record), has_work, contact (any was found), sections (found headings),
    objective, role and wanted (skills of the posting). Nulls are empty.
    """
    none = F.array().cast("array<string>")
    d = rows.withColumns({"_bullets": F.filter(F.transform(F.coalesce("bullets", none), lambda b: F.trim(b)), lambda b: b != ""), "_objective": F.coalesce("objective", F.lit("")), "_words": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))})
    d = d.withColumns({"_vague": vague(F.col("_bullets")), "_claims": F.size(claims_of(F.array_join("_bullets", " ")))})
    has = lambda name: F.array_contains(F.coalesce("sections", none), name)
    no_work = ~has("experience") | ~F.coalesce("has_work", F.lit(False))
    no_skills = ~has("skills") | (F.size(F.coalesce("skills", none)) == 0)
    generic = F.col("_objective").rlike(OBJECTIVE) & ~specific(F.col("_objective"), F.col("role"), F.coalesce("wanted", none))
    lost = [(no_skills, NO_SKILLS, "MISSING_SKILLS"), (~F.coalesce("contact", F.lit(False)), NO_CONTACT, "MISSING_CONTACT"), (F.col("_claims") == 0, NO_FIGURES, "NO_QUANTIFIED_ACHIEVEMENTS"), (generic, NO_OBJECTIVE, "GENERIC_OBJECTIVE"), (F.col("_vague") > 0, F.col("_vague"), "VAGUE_DUTIES")]
    points = F.coalesce("ats_score", F.lit(0.0)) * SHARE - sum((F.when(c, p).otherwise(0) for c, p, _ in lost), F.lit(0))
    points = F.when(F.col("_words") < THIN, points * THIN_FACTOR).otherwise(points)
    points = F.when(no_work, F.least(points, F.lit(NO_WORK_CAP))).otherwise(points)
    points = F.when(F.col("_words") < SHORT, F.least(points, F.lit(SHORT_CAP))).otherwise(points)
    codes = [(c, n) for c, _, n in lost] + [(F.col("_words") < THIN, "THIN"), (no_work, "MISSING_WORK_EXPERIENCE"), (F.col("_words") < SHORT, "UNDER_150_WORDS")]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in codes]))
    return d.withColumns({"content_points": F.greatest(F.lit(0.0), F.least(F.lit(MOST), points)), "content_issues": issues}).drop("_bullets", "_objective", "_words", "_vague", "_claims")


def scored(rows: DataFrame, view: str, found: dict[str, Column]) -> DataFrame:
    """Rows with parse_points, content_points, raw_total, total, grade and issues in their order.

    ``view`` is what the twelve parse checks read and ``found`` their statuses (columns of rows, computed before); the
    rest is as in ``content``.
    """
    v = F.col(view)
    overall = parse_checks.score(found, ["extraction", "layout"])
    table, columns = F.coalesce(found["tables"] == "warn", F.lit(False)), F.coalesce(v["column_pages"], F.lit(0)) > 0
    readable = parse_checks.extractability(v, found) != "none"
    d = content(rows).withColumn("parse_points", numbers.parse_points(overall, table, columns, readable))
    d = d.withColumn("raw_total", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("parse_points") + F.col("content_points"))))
    d = d.withColumn("total", F.bround(numbers.calibrated(F.col("raw_total")), 0).cast("int"))
    checks = F.array_compact(F.array(*[F.when(found[n].isin("fail", "warn"), F.concat_ws("_", F.lit(n.upper()), F.upper(found[n]))) for n in parse_checks.CHECKS if n in found]))
    return d.withColumns({"grade": numbers.grade(F.col("total")), "issues": F.concat(checks, "content_issues")})

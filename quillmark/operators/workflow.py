"""Composed reports: books against résumés, ships, suitability for a rank, officers', engineers' and crews' reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that state a competency, a duration or a hotel, sections and certificates of a crew.
COMPETENCIES = {
    "high_voltage_authorization": (r"\bhv\s+(?:authorized|authorised|switching)\b", True),
    "independent_maintenance": (r"\bindependently?\s+(?:maintained|maintenanc|troubleshot)\b", True),
    "department_management": (r"\b(?:managed|supervised)\s+(?:engine room|engineering department)\b", False),
}
HOTEL = r"(?i)(?:hotel|cruise hotel)\s+([A-Za-z][A-Za-z &.'-]{2,60})"
DURATION = r"(?i)(\d+(?:\.\d+)?)\s*(years?|months?)"
HIGH_VOLTAGE = ["high voltage awareness", "hv awareness"]
CREW_SECTIONS = {"land_experience": "hotel|hospitality|land", "internships": "internship|trainee", "training": "training", "foreign_work": "foreign|international", "guest_interaction": "guest|customer"}
CREW_CERTIFICATES = ["PST", "PSSR", "FPFF", "EFA", "STCW Basic Safety Training"]


def reconciled(resume_ranks: DataFrame, sailings: DataFrame, key: str) -> DataFrame:
    """Per key of a book's sailings (rank, sign_on, sign_off): its ranks without evidence, its repeated voyages, status.

    ``resume_ranks`` has (key, rank). Keys without sailings are consistent by definition and give no row. Null ranks are
    no ranks, but part of what makes two voyages equal. Arrays are sorted.
    """
    return _reconciled(resume_ranks, sailings, key).drop("latest_rank")


def _reconciled(resume_ranks: DataFrame, sailings: DataFrame, key: str) -> DataFrame:
    """As ``reconciled``, with the rank of the last sailing; the sailings are read once."""
    places = [c for c in ("page_number", "line_no") if c in sailings.columns]
    at = F.max(F.struct(*places, F.lit(0).alias("_"))).alias("_at")
    order = F.struct("sign_off", "sign_on", "_at", F.coalesce("rank", F.lit("")).alias("_rank"))
    again = sailings.groupBy(key, "sign_on", "sign_off", "rank").agg(F.count("*").alias("n"), at).groupBy(key).agg(F.sum(F.col("n") - 1).alias("n_repeated"), F.sort_array(F.collect_set("rank")).alias("book_ranks"), F.max_by("rank", F.when(F.col("sign_off").isNotNull(), order)).alias("latest_rank"))
    told = resume_ranks.where("rank IS NOT NULL").groupBy(key).agg(F.collect_set("rank").alias("_told"))
    out = again.join(told, key, "left").withColumn("ranks_without_evidence", F.array_except("book_ranks", F.coalesce("_told", F.array().cast("array<string>")))).drop("_told")
    return out.withColumn("status", F.when((F.size("ranks_without_evidence") > 0) | (F.col("n_repeated") > 0), "review_required").otherwise("consistent"))


def ships_matched(found: DataFrame, needed: DataFrame, key: str, name: str) -> DataFrame:
    """Per key of ``needed`` (key, name): the names found and not found, in lower case and sorted, and the status."""
    low = lambda df: df.where(F.col(name).isNotNull()).select(key, F.lower(name).alias("_name")).distinct()
    j = low(needed).join(low(found).withColumn("_found", F.lit(True)), [key, "_name"], "left")
    pick = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("_name"))))
    out = j.groupBy(key).agg(pick(F.col("_found").isNotNull()).alias("demonstrated"), pick(F.col("_found").isNull()).alias("not_evidenced"))
    return out.withColumn("status", F.when(F.size("demonstrated") + F.size("not_evidenced") > 0, "needs_review").otherwise("not_assessed"))


def required_months(text: Column) -> Column:
    """Months that a requirement's text states; null if none."""
    number = F.regexp_extract(text, DURATION, 1).try_cast("double")
    return number * F.when(F.lower(F.regexp_extract(text, DURATION, 2)).startswith("year"), 12).otherwise(1)


def suitability(candidates: DataFrame, requirements: DataFrame, key: str) -> DataFrame:
    """Candidates (key, rank, target, rank_months, relevant_months) with required_months, sea_service, missing arrays and status.

    ``requirements`` has (key, type, priority, text, state) of each candidate's vacancy; only mandatory ones count. No
    promotion is assumed: a stated lack comes first, then everything unknown is for review.
    """
    must = requirements.where("priority = 'mandatory'")
    cert, months = F.col("type") == "certificate", F.when(F.col("type") == "experience", required_months(F.col("text")))
    names = lambda state: F.sort_array(F.collect_set(F.when(cert & (F.col("state") == state), F.col("text"))))
    need = must.groupBy(key).agg(F.max(months).alias("required_months"), names("not_evidenced").alias("missing_evidence"), names("confirmed_missing").alias("confirmed_missing"))
    out = candidates.join(need, key, "left")
    for c in ("missing_evidence", "confirmed_missing"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    enough = F.coalesce(F.col("relevant_months") >= F.col("required_months"), F.lit(False))
    out = out.withColumn("sea_service", F.when(F.col("required_months").isNull(), "not_required").when(enough, "potentially_meets").otherwise("insufficient_or_missing_evidence"))
    known = F.col("rank").isNotNull() & F.col("target").isNotNull() & F.col("rank_months").isNotNull()
    fits = known & (F.col("rank") == F.col("target")) & F.col("sea_service").isin("not_required", "potentially_meets")
    return out.withColumn("status", F.when(F.size("confirmed_missing") > 0, "ineligible_confirmed_requirement").when(F.coalesce(fits, F.lit(False)), "potentially_eligible").otherwise("needs_manual_review"))


def officer_report(sailings: DataFrame, resume_ranks: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Per key: the ranks of the book, the rank of its last sailing, months by rank and in all, reconciliation.

    ``totals`` has (key, group_key, service_months) with group_key 'all' or 'rank:...'. Of sailings with equal dates the
    last is the one lowest on the last page (where page_number and line_no are given), then the one of the last rank by name.
    """
    rank = F.when(F.col("group_key").startswith("rank:"), F.struct(F.substring("group_key", 6, 1 << 20).alias("rank"), "service_months"))
    months = totals.groupBy(key).agg(F.sort_array(F.collect_list(rank)).alias("months_by_rank"), F.max(F.when(F.col("group_key") == "all", F.col("service_months"))).alias("service_months"))
    months = months.withColumn("months_by_rank", F.when(F.size("months_by_rank") > 0, F.col("months_by_rank")))
    r = _reconciled(resume_ranks, sailings, key).withColumnRenamed("book_ranks", "rank_history")
    return r.select(key, "n_repeated", "rank_history", "ranks_without_evidence", "status", "latest_rank").join(months, key, "left")


def competencies(text: Column) -> Column:
    """ARRAY<STRUCT<competency, evidenced, evidence_level>> of an engineer's text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    stated = {"high_voltage_awareness": (F.contains(low, F.lit(HIGH_VOLTAGE[0])) & F.contains(low, F.lit(HIGH_VOLTAGE[1])), False)}
    stated |= {name: (low.rlike(p), own) for name, (p, own) in COMPETENCIES.items()}
    level = lambda hit, own: F.when(hit & F.lit(own), "independently_performed").otherwise("mentioned_only")
    return F.array(*[F.struct(F.lit(name).alias("competency"), hit.alias("evidenced"), level(hit, own).alias("evidence_level")) for name, (hit, own) in stated.items()])


def crew_profile(text: Column) -> Column:
    """STRUCT of a crew member's text: a flag for each section, hotels named, certificates named."""
    whole = F.coalesce(text, F.lit(""))
    flags = [whole.rlike(rf"(?i)\b(?:{p})\b").alias(name) for name, p in CREW_SECTIONS.items()]
    hotels = F.transform(F.regexp_extract_all(whole, F.lit(HOTEL), 1), lambda x: F.trim(x))
    named = F.array_compact(F.array(*[F.when(whole.rlike(rf"(?i)\b{c}\b"), F.lit(c)) for c in CREW_CERTIFICATES]))
    return F.struct(*flags, F.filter(hotels, lambda x: x != "").alias("hotels"), named.alias("certificates"))


def recruiter_report(original: Column, generated: Column, sections: Column, issues: Column, strengths: Column, outstanding: Column) -> Column:
    """STRUCT of what a rewrite really changed: null and blank texts are no texts, null arrays are empty."""
    old, new = (F.trim(F.coalesce(c, F.lit(""))) for c in (original, generated))
    none = F.array().cast("array<string>")
    made = F.when((old != "") & (new != "") & (old != new), F.array(F.lit("resume_generated"))).otherwise(none)
    written = F.transform(F.coalesce(sections, none), lambda s: F.concat(F.lit("section:"), s))
    return F.struct(F.concat(made, written).alias("changes_made"), F.coalesce(issues, none).alias("issues"), F.coalesce(strengths, none).alias("strengths"), F.coalesce(outstanding, none).alias("outstanding"), original.isNotNull().alias("original_preserved"), (new != "").alias("generated_present"))


def candidate_report(fit: DataFrame, ships: DataFrame, certificates: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """One row for each candidate of ``fit``: suitability, ships, certificates by status, service months."""
    held = certificates.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("certificate", "status"))).alias("certificates"))
    s = ships.select(key, "demonstrated", F.col("not_evidenced").alias("ships_missing"), F.col("status").alias("ship_status"))
    return fit.join(s, key, "left").join(held, key, "left").join(totals.where("group_key = 'all'").select(key, "service_months"), key, "left")

"""A whole record from a text: contact, name, rank, skills, certificates, ships, service months and both scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import emails, phones
from ..sources.batches import attempted
from . import evidence, older, records, resume, service

LEAST_CHARS = 50
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+"


def names_found(docs: DataFrame, key: str, text: str, registry: DataFrame) -> DataFrame:
    """(key, rank, skills, certificates, vessels) of the registry (kind, canonical, term, ord, priority).

    The rank is the one of the best priority, whatever its place; the lists are sorted names.
    """
    found = evidence.terms_found(docs, key, text, registry).join(F.broadcast(registry.select("kind", "canonical", "term", "priority").distinct()), ["kind", "canonical", "term"])
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("canonical"))))
    rank = F.min(F.when(F.col("kind") == "rank", F.struct("priority", "canonical")))["canonical"]
    return found.groupBy(key).agg(rank.alias("rank"), names("skill").alias("skills"), names("certificate").alias("certificates"), names("vessel_type").alias("vessels"))


def parsed(docs: DataFrame, key: str, text: str, registry: DataFrame, banned: list[str], as_of: Column) -> DataFrame:
    """Rows of docs with name, contact (map), rank, skills, certificates, vessels and sea_months; the text is tokenised once.

    A null text is empty; without a rank it is ``unknown``. Keys are unique.
    """
    none = F.array().cast("array<string>")
    t = F.coalesce(F.col(text), F.lit(""))
    one = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    contact = F.create_map(F.lit("email"), one(emails(t)), F.lit("phone"), one(phones(t)), F.lit("linkedin"), F.regexp_extract(t, LINKEDIN, 0))
    d = docs.join(names_found(docs, key, text, registry), key, "left")
    d = d.withColumns({c: F.coalesce(c, none) for c in ("skills", "certificates", "vessels")}).withColumn("rank", F.coalesce("rank", F.lit("unknown")))
    return d.withColumns({"name": records.person_name(t, banned), "contact": contact, "sea_months": service.whole_months(service.service_periods(t, as_of))})


def flat(docs: DataFrame, key: str, text: str, tags: str, registry: DataFrame, required: dict[str, list[str]], least: dict[str, int], banned: list[str], as_of: Column) -> DataFrame:
    """One row a document with 18 fields besides its key, good or failed; a failed one has its reason in ``error``, numbers of 0 and no texts.

    ``required`` and ``least`` give certificates and months of a rank, under '' those of any other.
    """
    p = parsed(docs, key, text, registry, banned, as_of)
    by_rank = lambda table, default: F.coalesce(*[F.when(F.col("rank") == r, v) for r, v in table.items() if r], default)
    lists = {r: F.array(*[F.lit(x) for x in v]).cast("array<string>") for r, v in required.items()}
    months = {r: F.lit(v) for r, v in least.items()}
    empty = F.create_map().cast("map<string,string>")
    s = older.scored(p.withColumns({"_parts": empty, "_found": F.coalesce(tags, F.array().cast("array<string>"))}), text, "_found", "contact", "_parts", "skills", "rank")
    s = s.withColumn("_service", resume.service_score(F.col("rank"), by_rank(lists, lists[""]), F.col("certificates"), F.col("sea_months"), by_rank(months, months[""]), F.col("vessels")))
    fields = {
        "person": F.col("name"), "email": F.col("contact")["email"], "phone": F.col("contact")["phone"], "rank_detected": F.col("rank"),
        "ats_score": F.col("total_score"), "ats_grade": F.col("grade"), "maritime_score": F.col("_service.score"), "maritime_grade": F.col("_service.grade"),
        "months": F.col("sea_months"), "cert_coverage": F.col("_service.coverage"), "missing_certs": F.array_join("_service.missing", ", "), "vessel_types": F.array_join("vessels", ", "),
        "skills_count": F.size("skills"), "issues_count": F.size("issues"), "structural_issues": F.array_join("_found", ", "), "n_chars_read": F.length(F.coalesce(F.col(text), F.lit(""))),
    }
    bad = [(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < LEAST_CHARS, "EMPTY_OR_UNREADABLE")]
    out = attempted(s.select(key, F.col(text), *[c.alias(n) for n, c in fields.items()]), bad, {n: F.col(n) for n in fields})
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("ats_score", "maritime_score", "months", "skills_count", "issues_count", "n_chars_read")}
    return out.withColumns(zero).withColumn("person", F.when(F.col("error") == "", F.col("person")).otherwise("ERROR")).select(key, *fields, "error")

"""Shapes of a candidate's record: typed profile, service rows, order of sections, certificate terms; Columns over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A profile's fields with types and defaults, the order of sections by kind of crew, the tonnage pattern.
PROFILE = {"name": ("string", "Unknown"), "rank_detected": ("string", "unknown"), "license_rank": ("string", ""), "sea_months": ("int", 0)}
LISTS = ["certificates", "missing_certs", "vessel_types", "skills"]
CONTACTS = ["email", "phone", "linkedin", "github"]
OFFICER_ORDER = [("Technical Expertise / Core Competencies", ["technical_expertise"]), ("License", ["license"]), ("Documents", ["documents"]), ("Certificates", ["certifications"]), ("Education", ["education"]), ("Skills and Languages", ["skills", "languages"]), ("Professional Experience", ["experience"]), ("Summary", ["summary"])]
CREW_ORDER = [("Training", ["training"]), ("Certificates", ["certifications"]), ("Education", ["education"]), ("Skills and Languages", ["skills", "languages"]), ("Foreign Work / Hotel Experience", ["hotel_experience"]), ("Professional Experience", ["experience"]), ("Summary", ["summary"])]
TONNAGE = r"\bGRT\s*[:\-]?\s*([\d,]+)"
SHIP = r"([A-Z][\w.\-]*(?:\s+[A-Z][\w.\-]*){0,4})\s*\(?\s*$"


def _none() -> Column:
    return F.array().cast("array<string>")


def profile(fields: dict[str, Column]) -> Column:
    """STRUCT of PROFILE, contact, LISTS and sections; a missing or null field has its default."""
    plain = [F.coalesce(fields[n].cast(kind), F.lit(none)).alias(n) if n in fields else F.lit(none).cast(kind).alias(n) for n, (kind, none) in PROFILE.items()]
    contact = F.struct(*[(fields[n].cast("string") if n in fields else F.lit(None).cast("string")).alias(n) for n in CONTACTS], (F.coalesce(fields["all_phones"], _none()) if "all_phones" in fields else _none()).alias("all_phones"))
    lists = [(F.coalesce(fields[n], _none()) if n in fields else _none()).alias(n) for n in LISTS]
    empty = F.create_map().cast("map<string,string>")
    return F.struct(plain[0], contact.alias("contact"), *plain[1:], *lists, (F.coalesce(fields["sections"], empty) if "sections" in fields else empty).alias("sections"))


def ship_tonnage(bullets: Column) -> Column:
    """'Name (GRT n)' or 'GRT n' of the first bullet that states a tonnage; empty if none does. The name stands right before it."""
    first = F.get(F.filter(bullets, lambda b: b.rlike("(?i)" + TONNAGE)), F.lit(0))
    grt = F.concat(F.lit("GRT "), F.regexp_replace(F.regexp_extract(first, "(?i)" + TONNAGE, 1), ",+$", ""))
    before = F.regexp_replace(F.trim(F.regexp_extract(first, "(?is)^(.*?)" + TONNAGE, 1)), "[,;:]+$", "")
    name = F.trim(F.regexp_extract(before, SHIP, 1))
    return F.coalesce(F.when(name != "", F.concat(name, F.lit(" ("), grt, F.lit(")"))).otherwise(grt), F.lit(""))


def service_lines(entries: Column) -> Column:
    """One line for each distinct (dates, headline, company) of the entries, in order, blanks left out.

    An entry has role, company, dates and bullets; the headline is its ship, or else its role.
    """
    text = lambda x: F.trim(F.coalesce(x, F.lit("")))

    def row(e):
        ship = ship_tonnage(F.coalesce(e["bullets"], _none()))
        return F.struct(text(e["dates"]).alias("dates"), F.when(ship != "", ship).otherwise(text(e["role"])).alias("headline"), text(e["company"]).alias("company"))

    rows = F.array_distinct(F.transform(F.filter(entries, lambda e: e.isNotNull()), row))
    return F.transform(rows, lambda r: F.array_join(F.filter(F.array(r["dates"], r["headline"], r["company"]), lambda x: x != ""), "   —   "))


def ordered_sections(content: Column, officer: Column) -> Column:
    """ARRAY<STRUCT<heading, items>> of a record (MAP<STRING, ARRAY<STRING>>) in the order of officers or crews.

    Officers' empty sections are left out; crews' stand, but for an empty summary.
    """

    def made(order: list, always: bool) -> Column:
        parts = []
        for heading, fields in order:
            items = F.concat(*[F.coalesce(content[f], _none()) for f in fields])
            keep = F.lit(always and heading != "Summary") | (F.size(items) > 0)
            parts.append(F.when(keep, F.struct(F.lit(heading).alias("heading"), items.alias("items"))))
        return F.array_compact(F.array(*parts))

    return F.when(F.coalesce(officer, F.lit(True)), made(OFFICER_ORDER, False)).otherwise(made(CREW_ORDER, True))


def is_certificate(term: Column, names: list[str]) -> Column:
    """Whether the term holds one of the names or is held by one, without case; a null term isn't."""
    low = F.lower(term)
    return F.coalesce(F.exists(F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>"), lambda n: F.contains(n, low) | F.contains(low, n)), F.lit(False))

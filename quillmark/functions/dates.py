"""Date expressions. Three interval conventions stay apart: half-open days, closed tenures, whole first-of-month months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_A_MONTH, DAYS_A_YEAR = 30.436875, 365.2425


def _try(text: Column, form: str) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit(form)))


def endpoint(text: Column, is_end: bool, as_of: Column) -> Column:
    """STRUCT<day, ambiguous, partial>: one end of a service range, the end exclusive.

    Present and current are ``as_of``; day comes before month, and both at most 12 is ambiguous; a month alone is its
    first day, or for an end the day after its last.
    """
    t = F.trim(text)
    now = F.lower(t).isin("present", "current")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), _try(t, "yyyy-MM-dd"))
    name = F.when(t.rlike(r"^[A-Za-z]{3,9} \d{4}$"), F.coalesce(_try(F.initcap(t), "MMM yyyy"), _try(F.initcap(t), "MMMM yyyy")))
    slash = F.regexp_replace(t, "-", "/")
    month = F.coalesce(name, F.when(slash.rlike(r"^\d{1,2}/\d{4}$"), _try(slash, "M/yyyy")))
    full = F.when(slash.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _try(slash, "d/M/yyyy"))
    a, b = (F.regexp_extract(slash, r"^(\d{1,2})/(\d{1,2})/\d{4}$", k).try_cast("int") for k in (1, 2))
    day = F.coalesce(iso, full)
    if is_end:
        day, month = F.date_add(day, 1), F.date_add(F.last_day(month), 1)
    known = F.coalesce(F.when(now, as_of), day, month)
    is_full = slash.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.struct(
        known.alias("day"),
        F.coalesce(is_full & (full.isNull() | ((a <= 12) & (b <= 12))), F.lit(False)).alias("ambiguous"),
        F.coalesce(now | (iso.isNull() & ~is_full), F.lit(True)).alias("partial"),
    )


def month_key(text: Column) -> Column:
    """Any date form as YYYY-MM, a bare year as itself."""
    e = endpoint(text, False, F.lit(None).cast("date"))
    return F.coalesce(F.date_format(e["day"], "yyyy-MM"), F.when(F.trim(text).rlike(r"^\d{4}$"), F.trim(text)))


def month_equivalent(days: Column) -> Column:
    return F.bround(days / DAYS_A_MONTH, 2)


def months_between_merged(start: Column, end: Column) -> Column:
    """Whole months where both ends are first days of months, else days over the mean month."""
    whole = (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))
    return F.when((F.day(start) == 1) & (F.day(end) == 1), whole.cast("double")).otherwise(F.date_diff(end, start) / DAYS_A_MONTH)


def validity(expiry: Column, as_of: Column, soon_days: int = 183) -> Column:
    return F.when(expiry.isNull(), "EXPIRY_UNKNOWN").when(expiry < as_of, "EXPIRED").when(F.date_diff(expiry, as_of) <= soon_days, "EXPIRING_SOON").otherwise("VALID")


# Fixed value: the two ends of a range.
RANGE_END = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}|\d{1,2}/\d{4}|\d{4}"


def first_range(text: Column) -> Column:
    """The first range of dates in the text as it stands there; empty if none."""
    return F.coalesce(F.regexp_extract(text, rf"(?i)(?:{RANGE_END})\s*[-–]\s*(?:{RANGE_END}|Present|Current)", 0), F.lit(""))

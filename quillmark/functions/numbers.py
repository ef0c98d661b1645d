"""Score arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least totals of the grades, best first.
GRADES = [(85, "EXCELLENT"), (75, "GOOD"), (60, "PASS")]


def calibrated(x: Column) -> Column:
    """Low scores shrink by a quarter, high ones gain three fifths past 85."""
    return F.when(x < 40, x * 0.75).when(x > 85, 85 + (x - 85) * 0.6).otherwise(x)


def grade(total: Column) -> Column:
    out = F
    for least, name in GRADES:
        out = out.when(total >= least, name)
    return out.otherwise("FAIL")


def rewrite_quality(gain: Column) -> Column:
    return F.when(gain >= 15, "full").when(gain > 0, "partial").otherwise("none")


def weighted_mean(parts: dict[str, tuple[Column, float]]) -> Column:
    """Mean by weight over the parts that aren't null; null if all are."""
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts.values()), F.lit(0.0))
    low = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts.values()), F.lit(0.0))
    return F.try_divide(top, low)


def parse_points(overall: Column, table: Column, columns: Column, has_text: Column) -> Column:
    """0 to 40: 0.4 of the overall parse score, less 15 for tables and 12 for columns, that were counted within it already."""
    p = overall * 0.4 + F.when(table, 2.4 - 15).otherwise(0.0) + F.when(columns, 4.8 - 12).otherwise(0.0)
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(40.0))
    return F.when(has_text, p).otherwise(F.least(p, F.lit(5.0)))


def service_bonus(months: Column, least: Column, vessels: Column, all_certificates: Column, senior: Column) -> Column:
    """0 to 20: months against the minimum, vessel kinds, certificates and seniority."""
    by_months = F.when(least <= 0, 0).when(months >= 3 * least, 8).when(months >= 2 * least, 5).when(months >= least, 2).otherwise(0)
    return F.least(F.lit(20), by_months + F.least(vessels, F.lit(4)) + F.when(all_certificates, 4).otherwise(0) + F.when(senior, 4).otherwise(0))

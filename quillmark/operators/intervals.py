"""Interval algebra over half-open intervals (start, end]: union, grouped totals, overlaps, verified parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import months_between_merged


def merged(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Per keys the merged intervals; touching ones join, empty ones go. One shuffle by keys."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.where(F.col(end) > F.col(start)).select(*keys, start, end).withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int"))
    island = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def totals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Per keys: n_merged, union_days, service_months."""
    m = merged(df, keys, start, end)
    return m.groupBy(*keys).agg(*_totals(start, end))


def _totals(start: str, end: str) -> list[Column]:
    return [F.count(start).alias("n_merged"), F.sum(F.date_diff(end, start)).cast("bigint").alias("union_days"), F.bround(F.sum(months_between_merged(F.col(start), F.col(end))), 2).alias("service_months")]


def group_totals(df: DataFrame, key: str, groups: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Totals for ``all`` and for each value of each group column; a union is made anew for each group."""
    names = F.array(F.lit("all"), *[F.concat(F.lit(f"{g}:"), F.col(g).cast("string")) for g in groups])
    each = df.withColumn("group_key", F.explode(F.filter(names, lambda x: x.isNotNull())))
    # one pass: empty periods count, but open and reach nothing
    keys, real = [key, "group_key"], F.coalesce(F.col(end) > F.col(start), F.lit(False))
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(F.when(real, F.col(end))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = each.select(*keys, start, end).withColumn("_new", (real & (before.isNull() | (F.col(start) > before))).cast("int"))
    island = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = island.groupBy(*keys, "_island").agg(F.min(F.when(real, F.col(start))).alias(start), F.max(F.when(real, F.col(end))).alias(end), F.count("*").alias("_n"))
    return m.groupBy(*keys).agg(*_totals(start, end), F.sum("_n").alias("n_periods")).where("n_merged > 0")


def overlaps(df: DataFrame, key: str, period: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of periods of one key with the days they share."""
    a, b = df.alias("a"), df.alias("b")
    j = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{period}") < F.col(f"b.{period}")) & (F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"b.{start}") < F.col(f"a.{end}")))
    return j.select(F.col(f"a.{key}").alias(key), F.col(f"a.{period}").alias("first_period"), F.col(f"b.{period}").alias("second_period"), F.date_diff(F.least(f"a.{end}", f"b.{end}"), F.greatest(f"a.{start}", f"b.{start}")).cast("bigint").alias("overlap_days"))


def verified_split(claimed: DataFrame, verified: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Per key: claimed, verified and unverified days of the claimed union."""
    c, v = merged(claimed, [key], start, end), merged(verified, [key], start, end)
    j = c.alias("c").join(v.alias("v"), (F.col(f"c.{key}") == F.col(f"v.{key}")) & (F.col(f"c.{start}") < F.col(f"v.{end}")) & (F.col(f"v.{start}") < F.col(f"c.{end}")))
    both = j.groupBy(F.col(f"c.{key}").alias(key)).agg(F.sum(F.date_diff(F.least(f"c.{end}", f"v.{end}"), F.greatest(f"c.{start}", f"v.{start}"))).alias("_v"))
    days = c.groupBy(key).agg(F.sum(F.date_diff(end, start)).cast("bigint").alias("claimed_days"))
    out = days.join(both, key, "left").withColumn("verified_days", F.coalesce("_v", F.lit(0)).cast("bigint")).drop("_v")
    return out.withColumn("unverified_days", F.col("claimed_days") - F.col("verified_days"))


def deduplicated(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Every period with the first of its key, null for that one itself."""
    first = F.min(period).over(Window.partitionBy(*keys))
    return df.withColumn("duplicate_of", F.when(F.col(period) != first, first))

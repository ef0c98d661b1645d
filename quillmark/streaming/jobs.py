"""Structured Streaming forms: dedup within 24 hours, windows, latest state by upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, keys: list[str], ts: str, delay: str = "24 hours") -> DataFrame:
    """The first event of each key; state older than the watermark goes."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by tumbling or sliding windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    g = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def upserts(key: str, ts: str, read: Callable, write: Callable) -> Callable:
    """A foreachBatch function: the stored latest row of each key against the batch's; replaying a batch changes nothing."""
    def run(batch: DataFrame, _: int) -> None:
        stored = read(batch.sparkSession)
        both = batch if stored is None else stored.unionByName(batch.select(*stored.columns))
        write(both.groupBy(key).agg(F.max(F.struct(ts, *[c for c in both.columns if c not in (key, ts)])).alias("x")).select(key, "x.*"))

    return run

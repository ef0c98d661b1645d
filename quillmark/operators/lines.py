"""Line and sequence operators: numbered lines, forward fill, context, sessions, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines


def numbered(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 0, line)."""
    return docs.select(F.col(key), F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def forward_filled(rows: DataFrame, key: str, heading: Column) -> DataFrame:
    """Rows with ``section``: the last heading at or before them; headings themselves are flagged."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_h", heading).withColumn("section", F.last("_h", ignorenulls=True).over(w)).withColumn("is_heading", F.col("_h").isNotNull()).drop("_h")


def with_context(rows: DataFrame, key: str) -> DataFrame:
    """Each line with the one before and after."""
    w = Window.partitionBy(key).orderBy("line_no")
    return rows.withColumn("context", F.concat_ws("\n", F.lag("line").over(w), "line", F.lead("line").over(w)))


def sessions(rows: DataFrame, key: str, is_anchor: Column, sep: str = " | ") -> DataFrame:
    """Runs of lines from one anchor up to the next, joined; lines before the first anchor stay single."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    n = rows.withColumn("_s", F.sum(is_anchor.cast("int")).over(w)).withColumn("_p", F.when(F.col("_s") == 0, F.col("line_no")))
    g = n.groupBy(key, "_s", "_p").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return g.select(key, "line_no", F.array_join(F.transform("x", lambda s: s["line"]), sep).alias("line"))


def budgeted(rows: DataFrame, key: str, most: int, extra: int = 3) -> DataFrame:
    """Whole lines in order while their lengths, each plus ``extra``, stay within the budget."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length("line") + extra).over(w)).where(F.col("used") <= most)

"""Document scorecard: parse checks, content points, calibrated total and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text

#: Penalties of a failed check by severity; a warning costs half.
PENALTY = {"high": 30, "medium": 12, "low": 4}


def checks(doc: Column) -> dict[str, tuple[str, Column]]:
    """Check name -> (severity, status: pass, warn or fail)."""
    words = F.size(F.regexp_extract_all(F.coalesce(doc, F.lit("")), F.lit(r"(\S+)"), 1))
    visible = text.visible_chars(F.coalesce(doc, F.lit("")))
    odd = F.length(F.regexp_replace(F.coalesce(doc, F.lit("")), r"[\p{L}\p{N}\p{P}\p{S}\p{Z}\s]", ""))
    status = lambda fail, warn: F.when(fail, "fail").when(warn, "warn").otherwise("pass")
    return {
        "text_layer": ("high", status(visible < 40, visible < 100)),
        "garbled": ("high", status(odd * 20 > visible, odd * 100 > visible)),
        "contact": ("medium", status(F.size(text.emails(doc)) + F.size(text.phones(doc)) == 0, F.lit(False))),
        "length": ("medium", status(words < 150, words < 300)),
        "digits": ("low", status(~F.coalesce(doc, F.lit("")).rlike("[0-9]"), F.lit(False))),
        "tables": ("low", status(F.lit(False), F.coalesce(doc, F.lit("")).contains("|"))),
    }


def scored(docs: DataFrame, column: str = "text") -> DataFrame:
    """Every row with its checks, parse_score, parse_points, content_points, total and grade."""
    doc = F.col(column)
    found = checks(doc)
    penalty = sum((F.when(s == "fail", F.lit(float(PENALTY[sev]))).when(s == "warn", F.lit(PENALTY[sev] / 2)).otherwise(0.0) for sev, s in found.values()), F.lit(0.0))
    out = docs.withColumns({f"check_{n}": s for n, (_, s) in found.items()}).withColumn("parse_score", F.greatest(F.lit(0.0), F.bround(100 - penalty, 0)))
    content = F.lit(60.0) - F.when(F.col("check_contact") == "fail", 8).otherwise(0) - F.when(F.col("check_digits") == "fail", 8).otherwise(0)
    content = F.when(F.col("check_length") == "pass", content).otherwise(content * 0.75)
    out = out.withColumn("parse_points", numbers.parse_points(F.col("parse_score"), F.col("check_tables") == "warn", F.lit(False), F.col("check_text_layer") != "fail")).withColumn("content_points", content)
    out = out.withColumn("total", F.bround(numbers.calibrated(F.col("parse_points") + F.col("content_points")), 0).cast("int"))
    return out.withColumn("grade", numbers.grade(F.col("total")))

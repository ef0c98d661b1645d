"""Reports that compose the layers of one document, and the decision between an original and its rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from . import resume, scorecard


def layered(docs: DataFrame, column: str, platform: Column) -> DataFrame:
    """Every row with its scorecard, contacts, format findings (codes) and signals that a rewrite must keep; one scan."""
    doc = F.col(column)
    out = scorecard.scored(docs, column)
    codes = F.transform(resume.format_findings(doc, text.lines(doc), platform, F.lit(False)), lambda f: f["code"])
    return out.withColumns({"emails": text.emails(doc), "phones": text.phones(doc), "findings": codes, "facts": facts(doc)})


def facts(doc: Column) -> Column:
    """The distinct numbers of a text, thousands separators and ends of sentences taken off, with per cent signs."""
    found = F.regexp_extract_all(F.coalesce(doc, F.lit("")), F.lit(r"(\d[\d,.]*%?)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.replace(F.regexp_replace(x, r"[,.]+(%?)$", "$1"), F.lit(","), F.lit(""))))


def decided(pairs: DataFrame) -> DataFrame:
    """Pairs of before, after (scores), old_facts and new_facts with verdict, quality and what is kept.

    The original is kept where the score falls or a fact is added; without a score before there is nothing to compare
    and the rewrite is kept. A gain under 15 is worth another try.
    """
    gain = F.col("after") - F.col("before")
    verdict = resume.rewrite_verdict(F.col("before"), F.col("after"), F.array_except("new_facts", "old_facts"), F.array_except("old_facts", "new_facts"))
    back = (F.col("after") < F.col("before")) | (verdict == "factual_integrity_risk")
    return pairs.withColumns({"verdict": verdict, "quality": numbers.rewrite_quality(gain), "retry": F.coalesce(gain < 15, F.lit(False)), "kept": F.when(F.coalesce(back, F.lit(False)), "original").otherwise("rewritten")})

"""Dated documents: certificate lines with their validity, and sailings of discharge books by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.dates import validity
from ..functions.text import around, has_term, lines
from .lines import numbered
from .mentions import mentions
from .resume import MONTH

# Date forms and the words beside them.
DATE = rf"(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}|\d{{1,2}}[/-]\d{{4}}|20\d{{2}}-\d{{2}}-\d{{2}}|(?i:{MONTH})\s+\d{{4}})"
EXPIRY = r"(?i)\b(?:expir(?:y|es|ed)?|valid\s+(?:until|till|through))\b"
ISSUE = r"(?i)\b(?:issued|issue\s+date|date\s+of\s+issue)\b"
UNCLEAR = r"(?i)\b(?:valid|expiry|expires?)\b"
CONFIDENCE = {"text": 0.95, "ocr": 0.7}
# Forms of a ship's name, of a book's number behind its word, and of its holder's name.
SHIP = r"(?i)\b(?:M\s*/\s*[TV]|MV|MT|Vessel(?:\s+name)?\s*[:=-])\s*([A-Z][A-Za-z0-9 .()'-]{1,48})"
NUMBER = r"(?:\s*(?:No|Number))?\s*[:#]?\s*([A-Z0-9/-]{4,})"
HOLDER = r"(?i)(?:Candidate|Seafarer|Name)\s*[:=-]\s*([^\n]+)"


def day_of(text: Column, month_end: bool) -> Column:
    """A date in one of the forms; a month alone is its first day, or its last."""
    return let(F.regexp_replace(F.trim(text), "-", "/"), lambda t: _day(t, month_end))


def _day(t: Column, month_end: bool) -> Column:
    form = lambda f: F.to_date(F.try_to_timestamp(t, F.lit(f)))
    month = F.coalesce(F.when(t.rlike(r"^\d{1,2}/\d{4}$"), form("M/yyyy")), F.to_date(F.try_to_timestamp(F.concat(F.initcap(F.substring(t, 1, 3)), F.regexp_extract(t, r"(\s\d{4})$", 1)), F.lit("MMM yyyy"))))
    day = F.coalesce(F.when(t.rlike(r"^\d{4}/"), form("yyyy/MM/dd")), F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), form("d/M/yyyy")))
    return F.coalesce(day, F.last_day(month) if month_end else month)


def certificate_validity(docs: DataFrame, key: str, text: str, aliases: DataFrame, as_of: Column, soon_days: int = 183) -> DataFrame:
    """Per document and certificate of ``aliases`` (certificate, alias) its first line that names it, with dates and status.

    Lines meet the aliases by equal runs of words, whatever the number of aliases.
    """
    at = numbered(docs, key, text).withColumn("_line", F.struct(key, "line_no"))
    named = aliases.where("alias IS NOT NULL").select(F.col("alias").alias("term"), F.col("certificate").alias("canonical"))
    hit = mentions(at, "_line", "line", named).select(F.col(f"_line.{key}").alias(key), F.col("_line.line_no").alias("line_no"), F.col("canonical").alias("certificate"))
    where = hit.groupBy(key, "certificate").agg(F.min("line_no").alias("line_no"))
    first = where.join(at.select(key, "line_no", "line"), [key, "line_no"]).drop("line_no")
    after = lambda word: F.regexp_extract("line", rf"{word}(?-i:.*?(?<![\d/-]))({DATE})", 1)
    out = first.withColumn("expiry_date", day_of(after(EXPIRY), True)).withColumn("issue_date", day_of(after(ISSUE), False))
    dated = F.col("line").rlike(DATE)
    status = F.when(F.col("expiry_date").isNotNull(), validity(F.col("expiry_date"), as_of, soon_days)).when(~dated & F.col("line").rlike(UNCLEAR), "DATE_AMBIGUOUS").when(dated & F.col("line").rlike(EXPIRY), "REQUIRES_VERIFICATION").otherwise("EXPIRY_UNKNOWN")
    return out.withColumn("status", status)


def sailings(pages: DataFrame, key: str, ranks: list[str], as_of: Column, authorized: bool = False) -> DataFrame:
    """Rows of a discharge book from its pages (key, page_number, raw_text, method): one for each line with a date range.

    A range up to the present ends on ``as_of``. Each keeps its page, line and context; ``is_last`` marks the latest sign-off of a book. Ranks are tried in order.
    """
    span = rf"({DATE})\s*(?:-|–|—|(?i:to))\s*({DATE}|(?i:present|current))"
    # contexts are cut inside the page's row: no shuffle, and repeated pages stay apart
    around_it = lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.array_join(F.slice("_lines", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), "\n").alias("context"), *[F.regexp_extract(x, span, k).alias(f"_end{k}") for k in (1, 2)])
    dated = F.filter(F.transform("_lines", around_it), lambda r: r["_end1"] != "")
    hit = pages.withColumn("_lines", lines(F.col("raw_text"))).select(key, "page_number", "method", F.inline(dated))
    rank = F.coalesce(*[F.when(has_term(F.col("context"), r), F.lit(r)) for r in ranks])
    vessel = F.trim(F.regexp_extract("context", SHIP, 1))
    ends = [F.col("_end1"), F.col("_end2")]
    now = F.lower(ends[1]).isin("present", "current")
    sure = F.coalesce(*[F.when(F.col("method") == m, F.lit(c)) for m, c in CONFIDENCE.items()], F.lit(0.0))
    out = hit.select(key, "page_number", "line_no", F.trim("line").alias("row"), "context", rank.alias("rank"), F.nullif(vessel, F.lit("")).alias("vessel"), day_of(ends[0], False).alias("sign_on"), F.when(now, as_of).otherwise(day_of(ends[1], False)).alias("sign_off"), "method", sure.alias("confidence"), F.lit("verified_authorized_cdc" if authorized else "unverified_cdc").alias("verification_status"))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("sign_off"), "page_number", "line_no", "context")
    return out.withColumn("is_last", (F.row_number().over(w) == 1) & F.col("sign_off").isNotNull())


def book_numbers(text: Column) -> Column:
    """STRUCT<cdc, indos, name> of a book's whole text; null where it states none."""
    number = lambda word: F.nullif(F.regexp_extract(text, rf"(?i)\b{word}{NUMBER}", 1), F.lit(""))
    name = F.nullif(F.substring(F.trim(F.regexp_extract(text, HOLDER, 1)), 1, 120), F.lit(""))
    return F.struct(number("CDC").alias("cdc"), number("INDOS").alias("indos"), name.alias("name"))


def evidence(text: Column, start: Column, end: Column) -> Column:
    return F.trim(F.replace(around(text, start, end), F.lit("\n"), F.lit(" ")))

"""Twelve parse checks of extracted documents and their scores; Columns over one row, none shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import visible_chars
from . import records, service

# Categories and severities of the checks, penalties, limits, patterns.
CHECKS = {
    "text_layer": ("extraction", "high"),
    "garbled_glyphs": ("extraction", "high"),
    "text_coverage": ("extraction", "medium"),
    "multi_column": ("layout", "medium"),
    "tables": ("layout", "medium"),
    "text_boxes": ("layout", "medium"),
    "header_footer_content": ("layout", "medium"),
    "images": ("layout", "low"),
    "page_count": ("layout", "low"),
    "contact_info": ("content", "high"),
    "section_headings": ("content", "medium"),
    "dates": ("content", "low"),
}
PENALTY = {"high": 30, "medium": 12, "low": 4}
TEXT_LEAST, PAGE_LEAST, PAGES_MOST = 50, 200, 2
GARBLED_FAIL, GARBLED_WARN, EMAIL_WITHIN = 0.05, 0.005, 0.25
EMAIL = r"(?U)[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+"
GARBLED = r"\(cid:\d+\)|\x{FFFD}|[\x{E000}-\x{F8FF}]"
YEAR = r"\b(?:19|20)\d{2}\b"

#: Facts of pages and boxes that an extractor's tags don't tell: their types and what they are without them.
PAGE_FACTS = {"textbox_text": ("string", ""), "page_count": ("int", None), "truncated": ("boolean", False), "column_pages": ("int", 0), "repeated_lines": ("int", 0)}


def view(text: Column, tags: Column, ext: Column, pages: Column | None = None, **facts: Column) -> Column:
    """STRUCT of what the checks read: the text, what parts of the joined tags say, and facts of pages where they are known.

    ``pages`` is ARRAY<STRUCT<text, n_images>>; PAGE_FACTS names the others. Null text is empty, null tags are none, any
    kind of file but docx counts as PDF.
    """
    said = F.coalesce(F.array_join(tags, " "), F.lit(""))
    has = lambda *parts: F.greatest(*[said.contains(p) for p in parts], F.lit(False))
    margins = F.concat_ws(" ", F.when(has("HEADER"), "header"), F.when(has("FOOTER"), "footer"))
    known = [F.coalesce(facts[n].cast(kind), F.lit(none)).alias(n) if n in facts else F.lit(none).cast(kind).alias(n) for n, (kind, none) in PAGE_FACTS.items()]
    given = F.array().cast("array<struct<text:string,n_images:int>>") if pages is None else pages
    return F.struct(
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(F.lower(ext) == "docx", F.lit(False)).alias("docx"),
        has("MULTI_COLUMN").alias("multi_column"),
        has("IMAGE", "GRAPHICS").alias("image"),
        has("TABLE").alias("table"),
        margins.alias("margins"),
        F.coalesce(given, F.array().cast("array<struct<text:string,n_images:int>>")).alias("pages"),
        *known,
    )


def _status(fail: Column, warn: Column) -> Column:
    return F.when(fail, "fail").when(warn, "warn").otherwise("pass")


def statuses(v: Column, cv_mode: bool = False, locale: str | None = None) -> dict[str, Column]:
    """Check -> pass, warn or fail; null where the check doesn't apply."""
    no, text, n_pages = F.lit(False), v["text"], F.size(v["pages"])
    garbled = F.regexp_count(text, F.lit(GARBLED)) / F.greatest(F.lit(1), visible_chars(text))
    sparse = F.size(F.filter(v["pages"], lambda p: (p["n_images"] > 0) & (visible_chars(F.coalesce(p["text"], F.lit(""))) < PAGE_LEAST)))
    boxed = visible_chars(v["textbox_text"])
    email = F.regexp_extract(text, EMAIL, 0)
    email_at = F.round((F.position(email, text) - 1) / F.greatest(F.lit(1), F.length(text)), 2)
    margins = v["margins"] != ""
    contact_apart = margins & v["margins"].rlike(EMAIL) & (email == "")
    few_pages = F.when(margins, "warn")
    out = {
        "text_layer": _status(visible_chars(text) < TEXT_LEAST, no),
        "garbled_glyphs": _status(garbled > GARBLED_FAIL, garbled > GARBLED_WARN),
        "text_coverage": F.when(~v["docx"] & (n_pages > 0), _status((sparse > 0) & (sparse == n_pages), sparse > 0)),
        "multi_column": _status(v["multi_column"] | (v["column_pages"] > 0), no),
        "tables": F.when(v["table"], "warn").when(v["docx"], "pass"),
        "text_boxes": F.when(v["docx"], _status(boxed >= TEXT_LEAST, boxed > 0)),
        "header_footer_content": F.when(v["docx"], _status(contact_apart, margins)).when(n_pages < 2, few_pages).otherwise(_status(no, v["repeated_lines"] > 0)),
        "images": _status(no, v["image"]),
        "page_count": F.when(v["page_count"].isNotNull(), _status(no, v["truncated"] | (F.lit(not cv_mode) & (v["page_count"] > PAGES_MOST)))),
        "contact_info": _status(email == "", ~records.has_phone(text) | (email_at > EMAIL_WITHIN)),
        "section_headings": service.section_status(service.sections_found(text, locale)),
        "dates": _status(no, ~text.rlike(YEAR)),
    }
    return out


def score(found: dict[str, Column], categories: list[str]) -> Column:
    """100 less the penalties of failed checks of the categories and half of those of warnings, within 0 and 100."""
    lost = F.lit(0.0)
    for name, (category, severity) in CHECKS.items():
        if category in categories and name in found:
            lost = lost + F.when(found[name] == "fail", float(PENALTY[severity])).when(found[name] == "warn", PENALTY[severity] / 2).otherwise(0.0)
    return F.greatest(F.lit(0), F.bround(100 - lost, 0).cast("int"))


def report(found: dict[str, Column]) -> Column:
    """ARRAY<STRUCT<id, category, severity, status>> of the checks that apply, in their order."""
    rows = [F.when(found[n].isNotNull(), F.struct(F.lit(n).alias("id"), F.lit(c).alias("category"), F.lit(s).alias("severity"), found[n].alias("status"))) for n, (c, s) in CHECKS.items()]
    return F.array_compact(F.array(*rows))


def extractability(v: Column, found: dict[str, Column]) -> Column:
    """none without a text layer; partial where glyphs, pages or the end of the text are lost; else full."""
    lost = (found["garbled_glyphs"] == "fail") | (F.coalesce(found["text_coverage"], F.lit("pass")) != "pass") | v["truncated"]
    return F.when(found["text_layer"] == "fail", "none").when(lost, "partial").otherwise("full")

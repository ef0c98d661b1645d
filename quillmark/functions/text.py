"""String expressions as Columns. Python runs on the executors only for the compatibility forms of texts that aren't ASCII."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# These patterns and their order decide what is redacted.
PII_PATTERNS = [r"[\w.+-]{4,}@[\w-]+\.\w+", r"[+]?\d[\d\s\-().]{8,}\d", r"\b[A-Z]\d{7,8}\b", r"\b\d{2}[A-Z]{2}\d{5,7}\b", r"\b\d{2}[A-Z]{2}\d{4}\b"]
REDACTED = "[REDACTED]"

#: Commands in a text that are addressed to a model.
INJECTIONS = [r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions", r"(?i)disregard\s+(?:all\s+)?(?:previous|above)", r"(?i)forget\s+(?:everything|all)", r"(?i)you\s+are\s+now", r"(?i)new\s+instructions\s*:", r"(?i)system\s*:", r"(?i)</?\s*(?:system|assistant|user)\s*>"]


def _quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


def has_term(text: Column, term: str) -> Column:
    """Whole-term, case-insensitive: no word character on either side; a blank term is in no text."""
    if not term.strip():
        return F.lit(False)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(rf"(?U)(?<!\w){_quoted(term.strip().lower())}(?!\w)")


def has_any_part(text: Column, parts: list[str]) -> Column:
    """Any of the parts as a substring, case-insensitive."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(True)) for p in parts], F.lit(False)) if parts else F.lit(False)


def replaced(text: Column, patterns: list[str], by: str = REDACTED) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, re.sub(r"([\\$])", r"\\\1", by))
    return text


def redacted(text: Column) -> Column:
    """Addresses, phone numbers and document numbers masked, pattern after pattern."""
    return replaced(text, PII_PATTERNS)


def without_injections(text: Column) -> Column:
    return replaced(text, INJECTIONS)


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", "")).cast("bigint")


def skill_key(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def plain_dashes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]*[—–][ \t]*", " - "), "-{2,3}", "-")


def replaced_phrases(text: Column, phrases: dict[str, str]) -> Column:
    """Phrases by plainer ones, longest first; an initial capital stays."""
    for old in sorted(phrases, key=lambda p: (-len(p), p)):
        new = phrases[old]
        for a, b in ((old[:1].upper() + old[1:], new[:1].upper() + new[1:]), (old, new)):
            text = F.regexp_replace(text, rf"(?<!\w){_quoted(a)}(?!\w)", b)
    return text


def xml_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def sentences(text: Column) -> Column:
    """Split after . ! ? but not in runs of capital abbreviations such as M.V."""
    parts = F.split(text, r"(?<!(?:^|\s)(?:[A-Z]\.){0,4}[A-Z])[.!?]")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def tidy(text: Column) -> Column:
    """Lines of one letter dropped, trailing blanks cut, three or more line ends as two."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*[A-Za-z][ \t]*$\n?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def lines(text: Column) -> Column:
    """Lines without a trailing empty one; a blank text has none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\R$", "")
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, r"\R"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1)


def emails(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z][A-Za-z0-9._%+-]{3,}@[A-Za-z0-9-]+\.[A-Za-z]+)"), 1)


def phones(text: Column) -> Column:
    """Runs that look like phone numbers of at least 10 digits, distinct by digits, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([+]?[0-9][0-9 ().-]{8,}[0-9])"), 1)
    digits = F.transform(found, lambda p: F.regexp_replace(p, "[^0-9]", ""))
    return F.array_distinct(F.filter(digits, lambda d: F.length(d) >= 10))


def around(text: Column, start: Column, end: Column, margin: int = 100, most: int = 300) -> Column:
    """The text within ``margin`` characters of a span, at most ``most``."""
    a = F.greatest(start - margin, F.lit(0))
    return F.substring(F.substring(text, a + 1, end + margin - a), F.lit(1), F.lit(most))


@F.arrow_udf(StringType())
def _compatible(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


def normalized(text: Column) -> Column:
    """Compatibility forms, without four inline tags, words joined at hyphenated line ends and out of spaced letters, blanks as one, lower case."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.rlike(r"[^\x00-\x7F]"), _compatible(F.when(t.rlike(r"[^\x00-\x7F]"), t))).otherwise(t)
    t = F.regexp_replace(t, r"(?i)</?(?:strong|em|u|a)\b[^>]*>", "")
    t = F.regexp_replace(t, r"(?U)(\w)-\n\s*(\w)", "$1-$2")
    t = _unspaced(t)
    return F.trim(F.lower(F.regexp_replace(t, "[ \t\u00a0]+", " ")), F.lit(" \t\n\r"))


def _unspaced(t: Column) -> Column:
    """Single characters parted by one blank each, three or more in a row, joined; other words stay."""
    line = lambda x: F.array_join(F.transform(_letter_runs(x), lambda r: F.when(F.size(r) >= 3, F.array_join(r, "")).otherwise(F.array_join(r, " "))), " ")
    spaced = r"(?U)(?<!\S)\w \w \w(?!\S)"
    return F.when(t.rlike(spaced), F.array_join(F.transform(F.split(t, "\n"), lambda x: F.when(x.rlike(spaced), line(x)).otherwise(x)), "\n")).otherwise(t)


def _letter_runs(line: Column) -> Column:
    """The words of a line, with neighbouring single characters in one list."""
    single = lambda w: w.rlike(r"(?U)^\w$")

    def step(out, w):
        last = F.element_at(out, -1)
        joins = F.coalesce((F.size(out) > 0) & single(w) & single(F.element_at(last, -1)), F.lit(False))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.array(w))))).otherwise(F.concat(out, F.array(F.array(w))))

    words = F.split(line, " ")
    return F.aggregate(words, F.array().cast("array<array<string>>"), step)

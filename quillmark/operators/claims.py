"""Numeric claims as multisets, and differences of fact sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a number a claim, which words before it name a version, which surroundings a date.
CURRENCY = "[$€£₹]"
UNITS = "thousand|million|billion|percent|times|ms|gb|mb|tb|[kmb%x]"
VERSION_WORDS = r"python|node(?:\.js)?|java|version|v"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
YEARS = (1900, 2100)
#: Places by which a unit shifts the decimal point; the unit that stands for several spellings.
SHIFT = {"k": 3, "thousand": 3, "m": 6, "million": 6, "b": 9, "billion": 9}
KIND = {"%": "%", "percent": "%", "x": "x", "times": "x", "ms": "ms", "gb": "gb", "mb": "mb", "tb": "tb"}


def _number(mark: str = "", blanks: str = "") -> str:
    return rf"(?:({mark}{CURRENCY}){blanks})?({mark}\d[\d,]*(?:\.\d+)?)(?:\s*({mark}{UNITS}))?(?![A-Za-z])"


# One match a claim; groups: version word before it, date part before it, currency, number, unit, date part after it.
# The empty-width groups look around without taking text, so neighbouring claims never hide each other. They are tried
# only where a claim is certain: Java keeps what a look-behind captured even if the match fails later.
def _claim(apart: bool) -> str:
    # a sign apart from its number may also touch the word before it, but not a number
    blanks, start = (r"\s*", rf"(?:(?<![\p{{L}}\p{{N}}_.])|(?<!\p{{N}})(?={CURRENCY}))") if apart else ("", r"(?<![\p{L}\p{N}_.])")
    return (
        rf"(?i){start}(?={_number('?:', blanks)})"
        rf"(?:(?<=({VERSION_WORDS})\s{{0,15}}))?"
        rf"(?:(?<=((?:19|20)\d{{2}}\s{{0,7}}[-/–]|(?:{MONTHS})[a-z]{{0,9}}\.?)\s{{0,9}}))?"
        rf"{_number(blanks=blanks)}"
        r"(?=(\s{0,7}[-/–]\s{0,7}(?:19|20)\d{2})?)"
    )


def shifted(number: Column, places: Column) -> Column:
    """A decimal string with its point moved right, without needless zeros: exact at any length."""
    whole, part = F.split_part(number, F.lit("."), F.lit(1)), F.split_part(number, F.lit("."), F.lit(2))
    part = F.rpad(part, F.greatest(F.length(part), places), F.lit("0"))
    left = F.regexp_replace(F.concat(whole, F.substr(part, F.lit(1), places)), "^0+(?=.)", "")
    right = F.regexp_replace(F.substr(part, places + 1), "0+$", "")
    return F.when(right == "", left).otherwise(F.concat_ws(".", left, right))


def claims_of(text: Column, apart: bool = False) -> Column:
    """ARRAY<STRUCT<version, before, currency, number, unit, after>> of the claims of a text, in order.

    Numbers of versions don't count, nor bare years from 1900 to 2100 beside a year and a dash or after a month.
    With ``apart`` a currency sign counts with blanks before its number and behind a word, too.
    """
    body = F.coalesce(text, F.lit(""))
    groups = ["version", "before", "currency", "number", "unit", "after"]
    found = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(_claim(apart)), k + 1).alias(g) for k, g in enumerate(groups)])
    plain = lambda c: F.replace(c["number"], F.lit(","), F.lit(""))
    bare = lambda c: (c["unit"] == "") & (c["currency"] == "") & ~F.contains(plain(c), F.lit("."))
    dated = lambda c: bare(c) & plain(c).try_cast("bigint").between(*YEARS) & ((c["before"] != "") | (c["after"] != ""))
    return F.filter(found, lambda c: (c["version"] == "") & ~F.coalesce(dated(c), F.lit(False)))


def numeric_claims(docs: DataFrame, key: str, text: str = "text", apart: bool = False) -> DataFrame:
    """(key, claim, n): claims are kind:value, scaled by k, m and b; which numbers count is told by ``claims_of``."""
    rows = docs.select(key, F.inline(claims_of(F.col(text), apart)))
    number, unit = F.replace("number", F.lit(","), F.lit("")), F.lower("unit")
    told = lambda table, otherwise: F.coalesce(*[F.when(unit == u, F.lit(v)) for u, v in table.items()], F.lit(otherwise))
    kind = F.when(F.col("currency") != "", F.col("currency")).otherwise(told(KIND, ""))
    claim = F.concat(kind, F.lit(":"), shifted(number, told(SHIFT, 0)))
    return rows.select(key, claim.alias("claim")).groupBy(key, "claim").agg(F.count("*").alias("n"))


def novel_claims(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Claims that the new version has more often than the old one (multiset difference)."""
    j = new.join(old.select(key, "claim", F.col("n").alias("n_old")), [key, "claim"], "left")
    return j.where(F.col("n") > F.coalesce("n_old", F.lit(0))).select(key, "claim", (F.col("n") - F.coalesce("n_old", F.lit(0))).alias("n_new"))


def set_changes(old: DataFrame, new: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, change): added or removed between two versions."""
    o, n = old.select(key, item).distinct(), new.select(key, item).distinct()
    return n.exceptAll(o).withColumn("change", F.lit("added")).unionByName(o.exceptAll(n).withColumn("change", F.lit("removed")))


def list_changes(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, change, n): how many items of two lists without repeats were added or removed; no row for none."""
    n = lambda a, b: F.size(F.array_except(a, b)).cast("bigint")
    each = F.array(F.struct(F.lit("added").alias("change"), n(new, old).alias("n")), F.struct(F.lit("removed").alias("change"), n(old, new).alias("n")))
    return pairs.select(key, F.inline(each)).where("n > 0")

"""Service months from the tables of pages, with their text as a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .service import PAIR_DAYS, YEARS, service_periods, whole_months

# Words that a service table has in its first two rows, and the form of its dates.
SERVICE_WORDS = ["sign on", "signed on", "sign off", "vessel", "rank", "company"]
DAY = r"(\d{2}/\d{2}/\d{4})"
MONTH = r"\d{2}/\d{4}"


def _text(cells: Column) -> Column:
    """The cells that hold something, parted by blanks; a merged cell is null."""
    return F.array_join(F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != ""), " ")


def service_tables(grid: DataFrame, doc: str) -> DataFrame:
    """Tables (doc, page, table) of at least two rows whose first two name service. ``grid`` is (doc, page, table, row from 0, cells)."""
    head = F.array_sort(F.collect_list(F.when(F.col("row") < 2, F.struct("row", _text(F.col("cells")).alias("text")))))
    g = grid.groupBy(doc, "page", "table").agg(head.alias("head"), F.count_distinct("row").alias("rows"))
    words = F.lower(F.array_join(F.transform("head", lambda h: h["text"]), " "))
    return g.where((F.col("rows") >= 2) & words.rlike("|".join(SERVICE_WORDS))).select(doc, "page", "table")


def row_periods(cells: Column) -> Column:
    """ARRAY<STRUCT<s, e>>: a row's dates two by two, those in order, in YEARS and less than PAIR_DAYS apart."""
    days = F.transform(F.regexp_extract_all(_text(cells), F.lit(DAY), 1), lambda x: F.to_date(F.try_to_timestamp(x, F.lit("dd/MM/yyyy"))))
    at = lambda d: F.filter(F.sequence(F.lit(0), F.size(d)), lambda k: (k % 2 == 0) & (k + 1 < F.size(d)))
    pairs = let(days, lambda d: F.transform(at(d), lambda k: F.struct(F.get(d, k).alias("s"), F.get(d, k + 1).alias("e"))))
    good = lambda p: (p["e"] > p["s"]) & F.year(p["s"]).between(*YEARS) & F.year(p["e"]).between(*YEARS) & (F.date_diff(p["e"], p["s"]) < PAIR_DAYS)
    return F.filter(pairs, lambda p: F.coalesce(good(p), F.lit(False)))


def service_months(grid: DataFrame, pages: DataFrame, doc: str, as_of: Column) -> DataFrame:
    """(doc, n_periods, text_page, months) for each document of ``pages`` (doc, page, text) or ``grid``.

    Periods come from the rows below the first of all service tables. The text of a page counts only while neither a
    table up to it nor an earlier text gave one: its month ranges, or else its months two by two. Periods are merged;
    tables that repeat add nothing. Documents without any have 0 months.
    """
    known = service_tables(grid, doc)
    rows = grid.where("row > 0").join(known, [doc, "page", "table"], "left_semi").select(doc, "page", F.inline(row_periods(F.col("cells"))))
    tables = rows.groupBy(doc).agg(F.min("page").alias("_first"), F.collect_set(F.struct("s", "e")).alias("_rows"))
    told = pages.withColumn("_told", service_periods(F.col("text"), as_of, MONTH)).where("size(_told) > 0")
    early = told.join(tables.select(doc, "_first"), doc, "left").where("_first IS NULL OR page < _first")
    texts = early.groupBy(doc).agg(F.min("page").alias("text_page"), F.min_by("_told", "page").alias("_told"))
    every = pages.select(doc).unionByName(grid.select(doc)).distinct()
    none = F.array().cast("array<struct<s:date,e:date>>")
    j = every.join(tables, doc, "left").join(texts, doc, "left").withColumn("_all", F.array_distinct(F.concat(F.coalesce("_rows", none), F.coalesce("_told", none))))
    return j.select(doc, F.size("_all").alias("n_periods"), "text_page", whole_months(F.col("_all")).alias("months"))

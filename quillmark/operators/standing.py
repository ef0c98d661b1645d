"""What a candidate's text says of certificates and ranks: states, service by rank, officers' reports, suitability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import evidence, intervals, workflow
from .documents import sailings
from .lines import numbered
from .mentions import grams

# What a line says of a certificate that isn't held, or not any more.
DENIAL = r"(?i)\b(?:not held|do not have|does not have|never obtained)\b"
LAPSED = r"(?i)\b(?:expired|lapsed)\b"


def related(wanted: DataFrame, registry: DataFrame, longest: int = 8) -> DataFrame:
    """(wanted, certificate): names of the two dictionaries of which one holds the other as a run of whole words.

    Runs of words meet in equi-joins, both ways; names of more than ``longest`` words are held by their equals alone.
    """
    norm = lambda c: F.array_join(tokens(F.col(c)), " ")
    w = wanted.select("wanted", norm("wanted").alias("_w")).where("_w <> ''").distinct()
    r = registry.select("certificate", norm("certificate").alias("_c")).where("_c <> ''").distinct()
    outer = grams(w, "wanted", "_w", longest).select("wanted", F.col("gram").alias("_c")).join(r, "_c").select("wanted", "certificate")
    inner = grams(r, "certificate", "_c", longest).select("certificate", F.col("gram").alias("_w")).join(w, "_w").select("wanted", "certificate")
    return outer.unionByName(inner).unionByName(w.join(r, F.col("_w") == F.col("_c")).select("wanted", "certificate")).distinct()


def certificate_states(docs: DataFrame, key: str, text: str, wanted: DataFrame, registry: DataFrame, claimed: DataFrame) -> DataFrame:
    """(key, wanted, state, evidence) for each of ``wanted`` (key, wanted).

    ``registry`` is (certificate, alias); ``claimed`` (key, certificate) is what a parse already lists and counts only
    where the text has no mention. A line that denies a certificate makes it confirmed_missing, one that calls it expired
    or lapsed expired, any other mention evidenced_unverified; else it is not_evidenced. The line is masked.
    """
    dictionary = registry.select(F.lit("certificate").alias("kind"), F.col("certificate").alias("canonical"), F.col("alias").alias("term"), F.lit(0).alias("ord"))
    at = numbered(docs, key, text).withColumn("_line", F.struct(key, "line_no"))
    hit = evidence.spans(at, "_line", "line", dictionary, margin=1).select(F.col(f"_line.{key}").alias(key), F.col("_line.line_no").alias("line_no"), F.col("canonical").alias("certificate")).distinct()
    said = hit.join(at.select(key, "line_no", "line"), [key, "line_no"])
    rank = F.when(F.col("line").rlike(DENIAL), 0).when(F.col("line").rlike(LAPSED), 1).otherwise(2)
    best = said.groupBy(key, "certificate").agg(F.min(F.struct(rank.alias("rank"), "line_no", "line")).alias("x"))
    pairs = related(wanted.select("wanted").distinct(), registry.select("certificate").distinct())
    need = wanted.select(key, "wanted").distinct()
    found = need.join(pairs, "wanted").join(best, [key, "certificate"]).groupBy(key, "wanted").agg(F.min("x").alias("x"))
    listed = need.join(related(wanted.select("wanted").distinct(), claimed.select("certificate").distinct()), "wanted").join(claimed.select(key, "certificate").distinct(), [key, "certificate"]).select(key, "wanted").distinct().withColumn("_listed", F.lit(True))
    j = need.join(found, [key, "wanted"], "left").join(listed, [key, "wanted"], "left")
    state = F.when(F.col("x.rank") == 0, "confirmed_missing").when(F.col("x.rank") == 1, "expired").when((F.col("x.rank") == 2) | F.col("_listed"), "evidenced_unverified").otherwise("not_evidenced")
    return j.select(key, "wanted", state.alias("state"), evidence.masked(F.trim("x.line")).alias("evidence"))


def with_states(requirements: DataFrame, fallback: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Requirements (key, type, priority, text) with the state of each certificate; a key without a mandatory one takes those of ``fallback`` (key, certificate)."""
    must = requirements.where("type = 'certificate' AND priority = 'mandatory'").select(key).distinct()
    more = fallback.join(must, key, "left_anti").select(key, F.lit("certificate").alias("type"), F.lit("mandatory").alias("priority"), F.col("certificate").alias("text"))
    every = requirements.select(key, "type", "priority", "text").unionByName(more)
    return every.join(states.select(key, F.col("wanted").alias("text"), "state"), [key, "text"], "left")


def service_by_rank(rows: DataFrame, key: str) -> DataFrame:
    """Totals of merged sailings, in all and by rank, as ``intervals.group_totals`` gives them."""
    periods = rows.where("sign_on IS NOT NULL AND sign_off IS NOT NULL").select(key, "rank", F.col("sign_on").alias("start"), F.col("sign_off").alias("end"))
    return intervals.group_totals(periods, key, ["rank"])


def officer_from_text(resumes: DataFrame, books: DataFrame, key: str, ranks: list[str], as_of: Column, stated: DataFrame | None = None) -> DataFrame:
    """An officer's report of each book from texts alone.

    ``resumes`` and ``books`` are (key, page_number, raw_text, method). Ranks, periods and months come from the lines;
    months are of the union of résumé and book. ``stated`` (key) are books that name a last sailing: those without any
    readable one are for review (``last_sailing_missing_detail``).
    """
    told, real = sailings(resumes, key, ranks, as_of), sailings(books, key, ranks, as_of, authorized=True)
    both = told.select(key, "rank", "sign_on", "sign_off").unionByName(real.select(key, "rank", "sign_on", "sign_off"))
    r = workflow.officer_report(real, told.where("rank IS NOT NULL").select(key, "rank"), service_by_rank(both, key), key)
    r = r.withColumn("missing_detail", F.lit(False))
    if stated is None:
        return r
    lost = stated.select(key).distinct().join(real.select(key).distinct(), key, "left_anti").select(key, F.lit("review_required").alias("status"), F.lit(True).alias("missing_detail"))
    return r.unionByName(lost, allowMissingColumns=True)

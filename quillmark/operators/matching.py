"""Requirements against evidence: vacancy lines, item states, eligibility, ranks, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import numbered

# Ladder of ranks by department, highest first.
LADDER = {
    "deck": ["master", "staff captain", "chief officer", "second officer", "third officer", "junior officer", "deck cadet"],
    "engine": ["chief engineer", "first engineer", "second engineer", "third engineer", "fourth engineer", "engine cadet"],
    "eto": ["chief eto", "first eto", "second eto", "third eto", "electrical cadet"],
}


def steps(ranks: DataFrame) -> DataFrame:
    """(department, position, rank) with lower_rank and higher_rank, the neighbours of the same department; equal positions by rank."""
    w = Window.partitionBy("department").orderBy("position", "rank")
    return ranks.withColumn("lower_rank", F.lead("rank").over(w)).withColumn("higher_rank", F.lag("rank").over(w))


def ladder(spark) -> DataFrame:
    """(department, position, rank, lower_rank, higher_rank) of LADDER."""
    rows = [(d, k, r) for d, ranks in LADDER.items() for k, r in enumerate(ranks)]
    return steps(spark.createDataFrame(rows, "department string, position int, rank string"))


def rank_eligibility(candidates: DataFrame, steps: DataFrame) -> DataFrame:
    """Candidates (id, rank, years) with the recommended rank: past two years the same one, before that one lower, at two none; electro-technical ones the third."""
    j = candidates.join(F.broadcast(steps), "rank", "left")
    rec = F.when(F.col("department").isNull() | F.col("years").isNull() | (F.col("years") < 0), None).when(F.col("department") == "eto", "third eto").when(F.col("years") > 2.0, F.col("rank")).when(F.col("years") < 2.0, F.col("lower_rank"))
    return j.withColumn("recommended_rank", rec).withColumn("status", F.when(F.col("recommended_rank").isNull(), "needs_review").otherwise("review_recommended"))


def requirement_lines(vacancies: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, priority): mandatory or preferred by the last heading or cue; headings themselves go."""
    rows = numbered(vacancies, key, text).withColumn("line", F.trim(F.regexp_replace("line", r"^[-*•\s]+", ""))).where("line <> ''")
    head = lambda words: F.col("line").rlike(rf"(?i)^(?:{words})(?:\s+(?:skills|qualifications|requirements))?\s*:?$")
    cue = F.when(F.col("line").rlike(r"(?i)\b(?:mandatory|required|must|minimum)\b"), "mandatory").when(F.col("line").rlike(r"(?i)\b(?:preferred|desirable|advantage)\b"), "preferred")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("priority", F.coalesce(F.last(cue, ignorenulls=True).over(w), F.lit("unclear")))
    return out.where(~head("mandatory|required") & ~head("preferred"))


def item_state(evidenced: Column, denied: Column, expiry: Column, as_of: Column) -> Column:
    """Not found is never absent: expired before denied before evidenced before not evidenced."""
    return F.when(F.coalesce(expiry < as_of, F.lit(False)), "expired").when(F.coalesce(denied, F.lit(False)), "confirmed_missing").when(F.coalesce(evidenced, F.lit(False)), "evidenced").otherwise("not_evidenced")


def match_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys of (priority, state) rows: score, eligibility."""
    must = F.col("priority") == "mandatory"
    got = F.col("state") == "evidenced"
    s = items.groupBy(*keys).agg(F.count("*").alias("n_items"), F.count_if(got).alias("n_demonstrated"), F.count_if(must & F.col("state").isin("expired", "confirmed_missing")).alias("n_failed"), F.count_if(must & (F.col("state") == "not_evidenced")).alias("n_open"))
    return s.withColumn("score", F.bround(F.try_divide(100.0 * F.col("n_demonstrated"), F.col("n_items")), 1)).withColumn("eligibility", F.when(F.col("n_failed") > 0, "not_eligible_confirmed_missing").when(F.col("n_open") > 0, "needs_review").otherwise("potentially_eligible"))


def compared(candidates: DataFrame, factors: list[str], tie: str, by: list[str] | None = None) -> DataFrame:
    """Positions from 1 by the factors, all descending, nulls last; equals keep their input order. Without ``by`` the candidates are one short list."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*[F.desc_nulls_last(f) for f in factors], tie)
    return candidates.withColumn("position", F.row_number().over(w))

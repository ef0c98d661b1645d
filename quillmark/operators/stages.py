"""The stages of a rewrite as one plan: attempt, check of facts, strict attempt, fallback, rollback, with an audit trail.

A model's answers are an input table; what the stages decide is data: each row carries the state it is in, and every
transition is a row of its trail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from .claims import numeric_claims
from .reports import facts
from .resume import rewrite_verdict

GAIN_RETRY = 15


def _invented(versions: DataFrame, claims: Callable) -> DataFrame:
    """(_key, first, strict): whether an attempt states a number with a unit more often than the original."""
    found = claims(versions, "_id", "text").where(~F.col("claim").startswith(":"))
    n = lambda v: F.sum(F.when(F.col("_id.version") == v, F.col("n")).otherwise(0))
    each = found.groupBy(F.col("_id.key").alias("_key"), "claim").agg(n(0).alias("n0"), n(1).alias("n1"), n(2).alias("n2"))
    return each.groupBy("_key").agg(F.max(F.col("n1") > F.col("n0")).alias("first"), F.max(F.col("n2") > F.col("n0")).alias("strict"))


def run(originals: DataFrame, attempts: DataFrame, key: str, claims: Callable = numeric_claims) -> DataFrame:
    """(key, state, score, improvement, verdict, reason, trail) of each original.

    ``originals`` is (key, text, score), ``attempts`` (key, strict, text, score), at most one row of each kind a key; no
    row or a null text is a model's failure. An attempt that invents a number with a unit is rejected. A rejected or
    failed first attempt gives the original's content as ``fallback``, without a second try. A first attempt with added
    facts, or with a gain under GAIN_RETRY, is tried strictly; that one counts if it is sound and better, or if the first
    one wasn't sound. In the end a lower score or added facts bring the ``original`` back. States: rewritten, strict,
    fallback, original.
    """
    pick = lambda c, strict: F.max(F.when(F.col("strict") == strict, F.col(c)))
    tries = attempts.groupBy(key).agg(pick("text", False).alias("_t1"), pick("score", False).alias("_s1"), pick("text", True).alias("_t2"), pick("score", True).alias("_s2"))
    d = originals.select(key, F.coalesce("text", F.lit("")).alias("_t0"), F.col("score").alias("_s0")).join(tries, key, "left")
    rows = d.select(key, F.inline(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"_t{v}").alias("text")) for v in range(3)]))).where("text IS NOT NULL")
    bad = _invented(rows.select(F.struct(F.col(key).alias("key"), "version").alias("_id"), "text"), claims)
    d = d.join(bad.withColumnRenamed("_key", key), key, "left")
    false = F.lit(False)
    for v, name in ((1, "first"), (2, "strict")):
        d = d.withColumn(f"_out{v}", F.when(F.col(f"_t{v}").isNull(), "failed").when(F.coalesce(name, false), "rejected").otherwise("written"))
    for v in range(3):
        d = d.withColumn(f"_f{v}", facts(F.col(f"_t{v}")))
    verdict = lambda v: rewrite_verdict(F.col("_s0"), F.col(f"_s{v}"), F.array_except(f"_f{v}", "_f0"), F.array_except("_f0", f"_f{v}"))
    d = d.withColumns({"_v1": F.when(F.col("_out1") == "written", verdict(1)).otherwise("neutral"), "_v2": F.when(F.col("_out2") == "written", verdict(2)), "_after1": F.when(F.col("_out1") == "written", F.col("_s1")).otherwise(F.col("_s0"))})
    risk = lambda c: F.coalesce(F.col(c) == "factual_integrity_risk", false)
    again = risk("_v1") | ((F.col("_out1") == "written") & (F.col("_after1") - F.col("_s0") < GAIN_RETRY))
    d = d.withColumn("_again", F.coalesce(again, false))
    better = (F.col("_out2") == "written") & ~risk("_v2") & (risk("_v1") | (F.col("_s2") > F.col("_after1")))
    d = d.withColumn("_took", F.col("_again") & F.coalesce(better, false))
    after = F.when(F.col("_took"), F.col("_s2")).otherwise(F.col("_after1"))
    d = d.withColumns({"_after": after, "_risk": risk("_v1") & ~F.col("_took")})
    fell = F.coalesce(F.col("_after") < F.col("_s0"), false)
    reason = F.when(F.col("_risk"), "facts_added").when(fell, "score_fell").when(F.col("_out1") != "written", F.concat(F.lit("first_"), F.col("_out1")))
    state = F.when(F.col("_risk") | fell, "original").when(F.col("_took"), "strict").when(F.col("_out1") != "written", "fallback").otherwise("rewritten")
    d = d.withColumns({"state": state, "reason": reason})
    score = F.when(F.col("state") == "original", F.col("_s0")).otherwise(F.col("_after"))
    step = lambda stage, outcome: F.struct(F.lit(stage).alias("stage"), outcome.alias("outcome"))
    strict = F.when(F.col("_took"), "taken").when(F.col("_out2") != "written", F.col("_out2")).when(risk("_v2"), "facts_added").otherwise("not_better")
    trail = F.array_compact(F.array(step("score", F.lit("scored")), step("rewrite", F.col("_out1")), F.when(F.col("_out1") != "written", step("fallback", F.lit("original content"))).otherwise(step("rescore", F.coalesce("_v1", F.lit("no score before")))), F.when(F.col("_again"), step("strict", strict)), F.when(F.col("state") == "original", step("rollback", F.col("reason"))), step("done", F.col("state"))))
    return d.select(key, "state", score.alias("score"), (score - F.col("_s0")).alias("improvement"), F.when(F.col("_took"), F.col("_v2")).otherwise(F.col("_v1")).alias("verdict"), "reason", numbers.rewrite_quality(score - F.col("_s0")).alias("quality"), trail.alias("trail"))


def audit(done: DataFrame, key: str) -> DataFrame:
    """(key, step from 1, stage, outcome): one row a transition."""
    return done.select(key, F.posexplode("trail").alias("_p", "_s")).select(key, (F.col("_p") + 1).alias("step"), "_s.stage", "_s.outcome")


def stage_counts(trail: DataFrame) -> DataFrame:
    return trail.groupBy("stage", "outcome").agg(F.count("*").alias("n"))

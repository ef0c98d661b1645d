"""Training datasets without leaks from feedback: one job, five sinks, a manifest; and lists filled up to a quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .dataprep import components, held_out_groups
from .lineage import checkpointed

# What feedback must not show: addresses, numbers of ten digits or more, numbers of named documents.
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
NUMBER = r"(?<!\w)(?=(?:\D?\d){10})\+?\d[\d\s().-]{7,}\d(?!\w)"
DOCUMENT = r"(?i)\b(passport|cdc|indos|document|certificate)\s*(?:no\.?\s*:|number\s*:|#|:)\s*[A-Z0-9/-]+"
SINKS = ["rewrite_train", "rewrite_valid", "ranking_train", "ranking_valid", "corrections_review"]


def feedback_redacted(text: Column) -> Column:
    t = F.regexp_replace(text, EMAIL, "[redacted email]")
    return F.regexp_replace(F.regexp_replace(t, NUMBER, "[redacted number]"), DOCUMENT, "$1 [redacted]")


def prepared(feedback: DataFrame, rankings: DataFrame, fraction: float = 0.2) -> dict[str, DataFrame]:
    """The five datasets by name.

    ``feedback`` has kind, prompt, preferred, rejected, split_group, consent_record_ref and others; rows of
    ``rewrite_preference`` are split by their group, the others are for review with all their strings redacted.
    ``rankings`` (vacancy_ref, candidate_ref and others) are split by components, so that no vacancy and no candidate
    stands on both sides.
    """
    if not 0.05 <= fraction <= 0.5:
        raise ValueError("fraction must be in [0.05, 0.5]")
    clean = lambda c: feedback_redacted(F.coalesce(F.col(c), F.lit("")))
    is_rewrite = F.coalesce(F.col("kind") == "rewrite_preference", F.lit(False))
    rewrites = feedback.where(is_rewrite).select(clean("prompt").alias("prompt"), clean("preferred").alias("chosen"), clean("rejected").alias("rejected"), F.col("split_group").alias("source_group"), "consent_record_ref")
    strings = [f.name for f in feedback.schema if f.dataType.simpleString() == "string"]
    review = feedback.where(~is_rewrite).withColumns({c: feedback_redacted(F.col(c)) for c in strings})
    v, c = F.concat(F.lit("v:"), "vacancy_ref"), F.concat(F.lit("c:"), "candidate_ref")
    tied = components(rankings.select(v.alias("a"), c.alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    ranked = rankings.withColumn("_v", v).join(tied.select(F.col("node").alias("_v"), F.col("component").alias("_component")), "_v").drop("_v")
    split_w, split_r = checkpointed(held_out_groups(rewrites, "source_group", fraction)), checkpointed(held_out_groups(ranked, "_component", fraction))
    side = lambda d, name: d.where(F.col("split") == name).drop("split", "_component")
    return dict(zip(SINKS, [side(split_w, "train"), side(split_w, "validation"), side(split_r, "train"), side(split_r, "validation"), review]))


def manifest(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, n_rows, digest): counts and a hash that doesn't depend on the order of rows."""
    out = None
    for name, d in datasets.items():
        digest = F.sha2(F.concat_ws(",", F.count("*"), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)"))), 256)
        m = d.agg(F.count("*").alias("n_rows"), digest.alias("digest")).select(F.lit(name).alias("dataset"), "n_rows", "digest")
        out = m if out is None else out.unionByName(m)
    return out


def written(datasets: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each dataset as JSON lines in a folder of its name, the manifest beside them; what is counted is read back from there."""
    back = {}
    for name, d in datasets.items():
        d.write.mode("overwrite").json(f"{folder}/{name}")
        back[name] = d.sparkSession.read.schema(d.schema).json(f"{folder}/{name}")
    m = manifest(back)
    m.write.mode("overwrite").json(f"{folder}/manifest")
    return m


def filled(items: Column, defaults: Column, quota: Column, pad: bool = True) -> Column:
    """ARRAY<STRUCT<item, origin>>: the items in order without repeats (by lower case and without blanks around), then, while
    they are fewer than ``quota``, defaults that aren't among them. Origin is ``source`` or ``padded``; padded items say
    nothing that the source supports, so ``pad`` False leaves them out. Items beyond the quota all stay.
    """
    none = F.array().cast("array<string>")
    key = lambda x: F.lower(F.trim(x))
    once = lambda a: let(a, lambda b: let(F.transform(b, key), lambda keys: F.filter(b, lambda x, i: F.array_position(keys, key(x)) == i + 1)))
    mark = lambda a, origin: F.transform(a, lambda x: F.struct(x.alias("item"), F.lit(origin).alias("origin")))
    source = once(F.filter(F.coalesce(items, none), lambda x: x.isNotNull()))
    if not pad:
        return mark(source, "source")
    new = lambda low: F.filter(F.coalesce(defaults, none), lambda x: x.isNotNull() & ~F.array_contains(low, F.lower(x)))
    room = lambda own: F.greatest(quota - F.size(own), F.lit(0))
    more = lambda own: once(let(F.transform(own, lambda y: F.lower(y)), new))
    return let(source, lambda own: F.concat(mark(own, "source"), mark(F.slice(more(own), F.lit(1), room(own)), "padded")))

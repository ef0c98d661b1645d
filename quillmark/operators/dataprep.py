"""Leakage-free dataset preparation: validation, hold-out by group, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

REFERENCE = r"^[A-Za-z0-9_-]{8,128}$"


def validated(rows: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with the names of the broken rules)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    marked = rows.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def held_out_groups(rows: DataFrame, group: str, fraction: float) -> DataFrame:
    """Rows with ``split``: the last groups by name are validation, at least one and never all; one group alone is training.

    Groups are numbered in range partitions; one row for each partition comes together.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.select(group).where(F.col(group).isNotNull()).distinct().repartitionByRange(parts, F.desc(group)).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_g"))
    n = F.greatest(F.lit(1), F.least(F.col("_g") - 1, F.bround(F.col("_g") * fraction, 0).cast("bigint")))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(group)))
    last = dealt.withColumn("_at", within).join(F.broadcast(before), "_part")  # at most ``parts`` rows
    part = last.select(group, F.when((F.col("_g") > 1) & (F.col("_before") + F.col("_at") <= n), "validation").otherwise("train").alias("split"))
    return rows.join(part, group)


def shared_groups(train: DataFrame, validation: DataFrame, group: str) -> DataFrame:
    """Groups on both sides: empty if the split is clean."""
    return train.select(group).intersect(validation.select(group))


def components(edges: DataFrame, checkpoint=None) -> DataFrame:
    """(node, component) of an undirected edge table (a, b): every node with the least node that it reaches.

    Edges are contracted round by round: a node's larger neighbours are tied to its least one, then its smaller ones.
    Minima are aggregated map-side, so a hub's neighbours never meet in one task's memory; rounds are checkpointed, and
    only a row count and a checksum of each reach the driver.
    """
    keep = checkpoint or checkpointed
    told = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = told(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = keep(tied.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        now = told(e)
        if now == before:
            break
        before = now
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("component")).unionByName(alone.select("node", F.col("node").alias("component")))
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
    return out.groupBy("node").agg(F.min("component").alias("component"))

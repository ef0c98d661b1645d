"""Positions in a total order without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def running(df: DataFrame, order: list, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to each one, by ``order``.

    Rows are range-partitioned and summed within partitions; only one sum for each partition comes together.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.withColumn("_rank_value", value.cast("bigint")).repartitionByRange(n, *order).withColumn("_rank_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_rank_part").agg(F.sum("_rank_value").alias("size"))
    before = sizes.select("_rank_part", (F.coalesce(F.sum("size").over(Window.orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_rank_before"))
    within = dealt.withColumn("_rank_at", F.sum("_rank_value").over(Window.partitionBy("_rank_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each partition: at most n
    return within.join(F.broadcast(before), "_rank_part").withColumn(name, F.col("_rank_before") + F.col("_rank_at")).drop("_rank_part", "_rank_at", "_rank_before", "_rank_value")


def ranked(df: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... by ``order``."""
    return running(df, order, F.lit(1), name, parts).withColumn(name, F.col(name) - 1)

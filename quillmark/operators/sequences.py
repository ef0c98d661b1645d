"""Neighbours in an order, without a task for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def with_next(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Rows (group, order) with ``name``: the next order value of the same group, null for its last.

    Rows are range-partitioned by both, so a group may span many tasks; only the first row of each partition comes
    together, to follow the last one of the partition before it. Repeated values follow each other.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.select(group, order).repartitionByRange(n, group, order).withColumn("_part", F.spark_partition_id()))
    heads = dealt.groupBy("_part").agg(F.min(F.struct(F.col(group).isNotNull(), group, F.col(order).isNotNull(), order)).alias("_head"))
    after = heads.select("_part", F.lead("_head").over(Window.orderBy("_part")).alias("_after"))
    within = dealt.withColumn("_next", F.lead(F.struct(group, order)).over(Window.partitionBy("_part").orderBy(group, order)))
    # one row for each partition: at most n
    j = within.join(F.broadcast(after), "_part")
    nxt = F.when(F.col("_next").isNotNull(), F.when(F.col(f"_next.{group}").eqNullSafe(F.col(group)), F.col(f"_next.{order}"))).when(F.col(f"_after.{group}").eqNullSafe(F.col(group)), F.col(f"_after.{order}"))
    return j.select(group, order, nxt.alias(name))

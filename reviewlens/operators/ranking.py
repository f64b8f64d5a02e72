"""Exact global rank over a distributed sort.

``orderBy`` range-partitions and sorts the rows across all tasks; every row is
tagged with its partition and position, the tagged table is checkpointed once
(so both passes below see the same partitions), the row counts per partition
give prefix offsets, and ``rank = offset + position``. Only one small row per
partition is gathered and broadcast; no task ever holds more than its own
partition, unlike a ``limit`` on a sorted table (which merges every task's
top-k in one task) or a window without ``partitionBy`` (one task for all rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import bounded_broadcast, checkpoint_partitioned

# ``monotonically_increasing_id`` keeps the row position in its low 33 bits
_POS_MASK = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], k: int | None = None,
                name: str = "rank") -> DataFrame:
    """``df`` with a 0-based ``name`` column in ``order`` (which must be a total
    order, e.g. ending with a unique key); only ranks below ``k`` when given."""
    tagged = checkpoint_partitioned(
        df.orderBy(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    n_parts = tagged.rdd.getNumPartitions()
    per = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a single-partition window over at most n_parts rows
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = (tagged.join(bounded_broadcast(offsets, n_parts, fixed_width=True), "_pid")
              .withColumn(name, F.col("_off") + F.col("_pos")))
    if k is not None:
        ranked = ranked.where(F.col(name) < k)
    return ranked.drop("_pid", "_pos", "_off")

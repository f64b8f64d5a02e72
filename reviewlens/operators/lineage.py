"""Size-checked broadcast, lookups in model tables of any size, and lineage cutting.

Fitted model tables are written once to the shared checkpoint folder and read
back, so scoring never re-runs a fit, and a lost executor re-reads a file
instead of recomputing the whole lineage.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path

# Largest model table shipped to every executor: rows, and bytes in memory (a
# term has no length bound, so rows alone prove nothing).
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 256 << 20
# What a broadcast row takes besides its values: pointers, hash slot, null bits.
ROW_BYTES = 64
# Part of a model table that a lookup broadcasts. Words of texts are so unevenly frequent that this many hold nearly all
# rows, and a query with several lookups still sends little through the driver.
LOOKUP_ROWS = 1 << 18
LOOKUP_BYTES = 32 << 20

_SIZES: dict[tuple[str, int], int] = {}


def memory_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as a broadcast hash table: string lengths as stored, 8 for any other value, and ``ROW_BYTES``
    a row. One pass, remembered for the plan."""
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash())
    if key not in _SIZES:
        text = [F.sum(F.octet_length(f.name)) for f in df.schema.fields if f.dataType.simpleString() == "string"]
        fixed = ROW_BYTES + 8 * (len(df.columns) - len(text))
        _SIZES[key] = sum(x or 0 for x in df.agg((F.count(F.lit(1)) * fixed).alias("fixed"), *text).first())
    return _SIZES[key]


def fits_broadcast(df: DataFrame, n_rows: int, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    return n_rows <= (max_rows or MAX_BROADCAST_ROWS) and memory_bytes(df) <= (max_bytes or MAX_BROADCAST_BYTES)


def bounded_broadcast(small: DataFrame, n_rows: int, max_rows: int | None = None,
                      max_bytes: int | None = None, fixed_width: bool = False) -> DataFrame:
    """Broadcast ``small`` only when its row count (known from the fit) and its
    bytes in memory are within the bounds; otherwise leave the join to a shuffle
    (AQE may still pick a broadcast, or split a hot key, from real sizes).
    ``fixed_width`` is for rows without strings, whose count is bound enough."""
    fits = n_rows <= (max_rows or MAX_BROADCAST_ROWS) if fixed_width else fits_broadcast(small, n_rows, max_rows, max_bytes)
    return F.broadcast(small) if fits else small


def lookup(left: DataFrame, table: DataFrame, on: str, n_rows: int, heat: Column, how: str = "left") -> DataFrame:
    """``left`` joined with the model table ``table`` (unique ``on``; ``heat``: a number of its row that grows with how
    often the key occurs in texts).

    A table within the bounds of a lookup is broadcast. Of a larger one the most frequent keys are: they are joined where
    the rows are and enter no shuffle, however many rows hold them; a row without a key stays there too. The rows of the
    other keys, none of which is frequent, are shuffled by key once. ``how``: left or inner."""
    if fits_broadcast(table, n_rows, *_lookup_bounds()):
        return left.join(F.broadcast(table), on, how)
    hotter = heat.cast("double") > F.lit(_hot_cut(table, heat))
    hot = table.where(hotter)
    flag, values = "_lookup_hot", [c for c in table.columns if c != on]
    marked = left.join(F.broadcast(hot.withColumn(flag, F.lit(True))), on, "left")
    here = marked.where(F.col(flag) if how == "inner" else F.col(flag) | F.col(on).isNull()).drop(flag)
    rest = marked.where(F.col(flag).isNull() & F.col(on).isNotNull()).select(*left.columns)
    tail = table.where(~F.coalesce(hotter, F.lit(False))).select(on, *values)
    # the hint keeps the tail from being broadcast on a misjudged size
    return here.select(*left.columns, *values).unionByName(rest.join(tail.hint("shuffle_hash"), on, how).select(*left.columns, *values))


def lookup_sums(left: DataFrame, table: DataFrame, on: str, n_rows: int, heat: Column, by: list[str], inputs: list[str],
                sums: dict[str, Column]) -> DataFrame:
    """``by`` and the ``sums`` (by name, of the columns ``inputs`` of ``left`` and the values of ``table``) of each group
    of a left ``lookup``.

    ``left`` is read once: the rows of frequent keys are added up where they are, and one row for each group enters the
    shuffle of the other keys' rows beside them."""
    totals = [F.sum(c).alias(name) for name, c in sums.items()]
    if fits_broadcast(table, n_rows, *_lookup_bounds()):
        return left.join(F.broadcast(table), on, "left").groupBy(*by).agg(*totals)
    hotter = F.coalesce(heat.cast("double") > F.lit(_hot_cut(table, heat)), F.lit(False))
    marked = left.join(F.broadcast(table.where(hotter).withColumn("_hot", F.lit(True))), on, "left")
    later = F.col("_hot").isNull() & F.col(on).isNotNull()
    first = marked.groupBy(*by, F.when(later, F.col(on)).alias("_on"), *(F.when(later, F.col(c)).alias(f"_in_{c}") for c in inputs)).agg(
        F.count(F.lit(1)).alias("_times"), *(F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()))
    # a row of sums has no key; it is dealt out by its group
    dealt = F.coalesce(F.col("_on"), F.concat(F.lit(" "), F.xxhash64(*by).cast("string")))
    met = (first.withColumns({on: dealt, **{c: F.col(f"_in_{c}") for c in inputs}}).drop(*(f"_in_{c}" for c in inputs))
           .join(table.where(~hotter).hint("shuffle_hash"), on, "left"))
    return met.groupBy(*by).agg(*(F.sum(F.when(F.col("_on").isNull(), F.col(f"_sum_{name}")).otherwise(c * F.col("_times"))).alias(name)
                                  for name, c in sums.items()))


def _lookup_bounds() -> tuple[int, int]:
    return min(MAX_BROADCAST_ROWS, LOOKUP_ROWS), min(MAX_BROADCAST_BYTES, LOOKUP_BYTES)


def stored_hot(table: DataFrame, heat: Column) -> DataFrame:
    """The rows of greatest ``heat``, as many as the bounds of a lookup allow."""
    return table.where(heat.cast("double") > F.lit(_hot_cut(table, heat)))


def _hot_cut(table: DataFrame, heat: Column) -> float | None:
    """The ``heat`` that those rows are above: a quantile, which one pass finds; its share shrinks until both bounds
    hold. None where no row has one."""
    heated = table.withColumn("_heat", heat.cast("double"))
    rows, size = _lookup_bounds()
    n = table.count()
    share = min(1.0, rows / max(n, 1), size / max(memory_bytes(table), 1))
    while True:
        cut = heated.agg(F.percentile_approx("_heat", 1.0 - share, 100_000)).first()[0]
        hot = heated.where(F.col("_heat") > F.lit(cut)).drop("_heat")
        if fits_broadcast(hot, hot.count(), rows, size):
            return cut
        share /= 2


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver's JVM collects its garbage,
    which else may take half an hour, while a loop's passes pile up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint_partitioned(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint`` (shared checkpoint folder) that keeps ``df``'s
    hash partitioning visible to later plans.

    Under adaptive execution a checkpointed relation reports an unknown
    partitioning, and every later per-key step would shuffle again. The plan
    of this single eager action is therefore built without AQE (it is a fixed
    ``repartition(n, key)`` plus narrow work, nothing AQE would change);
    every later plan keeps AQE.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)


def text_partitions(df: DataFrame, partitions: int | None = None) -> int:
    """Partition count for the one shuffle of the review text: an explicit
    value, else the larger of ``spark.sql.shuffle.partitions`` and the scan's
    own split count (Spark sizes splits from the input bytes and
    ``spark.sql.files.maxPartitionBytes``), so no reducer holds more than an
    input split's worth of text on average, whatever the data size. AQE cannot
    resize this shuffle later, as later stages rely on its partitioning."""
    if partitions:
        return partitions
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, df.rdd.getNumPartitions())

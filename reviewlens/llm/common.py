"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import scratch_path

#: Text that a column function takes in at a time.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends in files every executor can read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df_or_columns, *wanted: str) -> list[str]:
    """``wanted`` names, each with underscores appended until no column has it in any case."""
    columns = df_or_columns.columns if hasattr(df_or_columns, "columns") else df_or_columns
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def per_text(fn: Callable[[], Callable[[list], pa.Array]], returns: str):
    """A column function text -> value from ``fn``, a factory called once per task.

    What the factory returns gets an Arrow array of texts and gives back an Arrow array. Batches are taken in slices
    of about SLICE_BYTES, so that a task holds the results of one slice only.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = fn()
        for batch in batches:
            rows = max(1, SLICE_BYTES * len(batch) // max(batch.nbytes, 1))
            for at in range(0, len(batch), rows):
                yield apply(batch.slice(at, rows))

    return F.arrow_udf(run, returns)


def ascii_lower_bytes(batch: pa.Array) -> list:
    """UTF-8 bytes of each text with A-Z lowered; None for null."""
    return [None if x is None else x.lower() for x in batch.cast(pa.binary()).to_pylist()]


def share(name: str, salt: str = ""):
    """A stable number in [0, 1) for each value of a column."""
    return F.pmod(F.xxhash64(F.lit(salt), col(name)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def crc_mod(name: str, n: int):
    """crc32 of the column as text, modulo ``n`` (null stays null)."""
    return F.pmod(F.crc32(col(name).cast("string")), F.lit(n))

"""Quoted CSV read in parallel: every file is split by byte ranges although quoted cells may hold line breaks.

Whether a line break ends a record follows from the number of quotes before it in the file. One pass counts the quotes of
each range; the counts' running parity says for each range, before anything of it is parsed, whether it starts inside a
cell. A second pass cuts each range's lines into records: lines are joined while a quote is open. A record that goes over
a range's end is given as fragments, at most two for each range, which are put together by the range it starts in. Records
are then parsed by Spark's CSV expression.

The header is the first record of a file's first range; files with unlike headers are matched by column name. Quotes are
escaped by doubling, as in RFC 4180; a quote inside an unquoted cell opens a cell for both passes alike, as it would for
the quote count. Empty records are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import bounded_broadcast

RECORDS = "file string, start bigint, kind string, text string"
HEADER, RECORD, HEAD, THROUGH, TAIL = "header", "record", "head", "through", "tail"


def _lines(spark: SparkSession, path, glob: str | None) -> DataFrame:
    """(value, file, start): the lines of each byte range, in order within a task."""
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, open): whether each range starts inside a quoted cell. One row for each range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    odd = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return odd.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of ranges, in order -> records and the fragments at the ranges' ends."""
    at = None
    held: list[str] = []
    inside = head = first = False

    def close() -> list[tuple]:
        # what is open when a range ends goes on in the next one
        return [(*at, THROUGH if head else TAIL, "\n".join(held))] if at and (held or head) else []

    for batch in batches:
        out: list[tuple] = []
        for value, file, start, opened in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != at:
                out += close()
                at, held, inside, head, first = (file, start), [], opened, opened, start == 0
            held.append(value)
            inside ^= value.count('"') & 1 == 1
            if inside:
                continue
            text = "\n".join(held)
            if first:
                text = text.removeprefix("﻿")
            if head or text.rstrip("\r"):
                out.append((*at, HEAD if head else HEADER if first else RECORD, text))
                first = False
            held, head = [], False
        yield _batch(out)
    yield _batch(close())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "start", "kind", "text"])


def records(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """(file, start, kind, text) of every record under ``path``; kind is ``header`` or ``record``."""
    lines = _lines(spark, path, glob)
    states = range_states(lines)
    opened = lines.join(bounded_broadcast(states, states.count()), ["file", "start"]).select("value", "file", "start", "open")
    cut = opened.mapInArrow(_cut, RECORDS)
    whole = cut.where(F.col("kind").isin(HEADER, RECORD))
    # fragments in file order: a tail opens a record, what follows up to the next head belongs to it
    place = F.when(F.col("kind") == TAIL, 1).otherwise(0)
    so_far = W.partitionBy("file").orderBy("start", place).rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = cut.where(F.col("kind").isin(HEAD, THROUGH, TAIL)).withColumn("opener", F.max(F.when(F.col("kind") == TAIL, F.col("start"))).over(so_far))
    parts = F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "text")))
    # the first range's only record may be one that goes on: then it is the header
    joined = owned.groupBy("file", F.col("opener").alias("start")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    lone = whole.where(F.col("kind") == HEADER).select("file").distinct().withColumn("named", F.lit(True))
    kind = F.when((F.col("start") == 0) & F.col("named").isNull(), F.lit(HEADER)).otherwise(F.lit(RECORD))
    return whole.unionByName(joined.join(lone, "file", "left").select("file", "start", kind.alias("kind"), "text"))


def read_csv_ranges(spark: SparkSession, path, options: dict, glob: str | None = None) -> DataFrame:
    """All records as string columns named by the headers, in the order of their first appearance by file name; a column
    that a file lacks is null in its rows. ``options`` are Spark's CSV options."""
    found = records(spark, path, glob).withColumn("text", F.regexp_replace("text", "\r$", ""))
    heads = found.where(F.col("kind") == HEADER).groupBy("text").agg(F.min("file").alias("file")).orderBy("file").select("text").collect()
    parse = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k not in ("header", "pathGlobFilter")}
    if not heads:
        raise ValueError(f"no CSV header under {path}")
    names = [_names(spark, r["text"], parse) for r in heads]
    header_of = found.where(F.col("kind") == HEADER).select("file", F.col("text").alias("header"))
    which = F.coalesce(*(F.when(F.col("header") == r["text"], F.lit(i)) for i, r in enumerate(heads)))
    rows = found.where(F.col("kind") == RECORD).join(header_of.select("file", which.alias("which")), "file")
    schemas = [", ".join(f"c{i} string" for i in range(len(n))) for n in names]
    parsed = rows.select("which", *(F.when(F.col("which") == i, F.from_csv("text", s, parse)).alias(f"s{i}") for i, s in enumerate(schemas)))
    wanted = list(dict.fromkeys(n for ns in names for n in ns))
    value = lambda name: F.coalesce(*(F.col(f"s{i}.c{ns.index(name)}") for i, ns in enumerate(names) if name in ns))
    return parsed.select(*(value(n).alias(n) for n in wanted))


def _names(spark: SparkSession, header: str, parse: dict) -> list[str]:
    """A header's column names, as Spark's reader gives them: one row, parsed by the same rules."""
    lines = spark.createDataFrame([(header,)], "value string").coalesce(1)
    return spark.read.options(**parse).option("header", True).csv(lines.rdd.map(lambda r: r[0])).columns

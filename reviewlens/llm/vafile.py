"""Exact top-k search by inner product, with vector-approximation files.

Vectors are dealt to files of bounded size; a file holds the quantised cell of every component (``CELLS`` equal
cells between the file's least and greatest value of that dimension) and the exact vectors. A task has one
file and one block of queries: it scans the cells for an interval that holds each score (cell centre times query,
give or take half a cell width times the query's magnitudes), then reads exact vectors in the order of their upper
bounds until the k-th exact score is above every bound left. The best k of each file are merged per query by
partial top-k lists.

Every query is compared with every file, in blocks: that is the stated query set against all rows. Queries are
split into blocks of bounded size too, so nothing that grows with the data is broadcast or held in one task.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without a vec_id or
vectors of another length than the query. A query's own row is left out; with a repeated id, all rows of that id,
and the least of their vectors is the query. Ties go to the smaller vec_id; repeated candidates count as often
as they occur. Fewer than k candidates: all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, stored
from .vectors import matrix, usable

CELLS = 256
#: Vectors of a file, queries of a block.
FILE_ROWS, QUERY_ROWS = 8192, 512
#: Exact vectors that a query reads at a time.
READ = 64


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, least value of each dimension, cell width of each dimension)."""
    low, high = x.min(axis=0), x.max(axis=0)
    width = np.where(high > low, (high - low) / CELLS, 1.0)
    return np.minimum((x - low) / width, CELLS - 1).astype(np.uint8), low, width


def search_file(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, rows of the best k, their scores) for integer vectors, ``x`` being sorted by ``ids``."""
    cell, low, width = quantise(x)
    asked = queries.astype(np.float64)
    middle = asked @ (low + (cell + 0.5) * width).T
    rounding = 1e-12 * np.abs(x).max() * np.abs(asked).sum(axis=1)
    slack = np.abs(asked) @ (width / 2) * (1 + 1e-12) + rounding
    for q in range(len(queries)):
        others = ids != query_ids[q]
        upper = np.where(others, middle[q] + slack[q], -np.inf)
        want = min(k, int(others.sum()))
        if not want:
            continue
        # the k-th greatest lower bound: nothing with an upper bound below it is among the best
        floor = np.partition(upper, len(upper) - want)[len(upper) - want] - 2 * slack[q]
        left = np.flatnonzero(upper >= floor)
        left = left[np.argsort(-upper[left], kind="stable")]
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(left), READ):
            if len(best) == want and upper[left[at]] < scores[-1]:
                break
            rows = left[at:at + READ]
            best, scores = np.concatenate([best, rows]), np.concatenate([scores, x[rows] @ queries[q]])
            top = np.lexsort((ids[best], -scores))[:want]
            best, scores = best[top], scores[top]
        yield q, best, scores


def _search(k: int):
    def run(group: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        empty = pa.table({n: pa.array([], t) for n, t in kinds.items()})
        asked = group["asked"].to_numpy().astype(bool)
        if not asked.any() or asked.all():
            return empty
        ids, x = group["vec_id"].to_numpy(), matrix(group["v"], np.int64)
        query_ids, queries, ids, x = ids[asked], x[asked], ids[~asked], x[~asked]
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out: list[list[np.ndarray]] = [[], [], []]
        for q, rows, scores in search_file(queries, query_ids, x, ids, k):
            for column, value in zip(out, (np.full(len(rows), query_ids[q]), ids[rows], scores)):
                column.append(value)
        return pa.table({n: np.concatenate(c) for n, c in zip(kinds, out)}) if out[0] else empty

    return run


def top_k(df: DataFrame, is_query, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where the column ``is_query`` holds, the ``k`` other rows with
    the greatest integer inner product of floor(scale * x)."""
    named = df.select(col(key).cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("ask"), col(vector).alias("raw"))
    fit = named.where(F.col("vec_id").isNotNull() & usable("raw"))
    whole = F.transform("raw", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = stored(fit.select("vec_id", "ask", F.size("raw").alias("dims"), whole.alias("v")), "whole-vectors")
    n = {r["ask"]: r["n"] for r in rows.groupBy("ask").agg(F.count("*").alias("n")).collect()}
    files = max(1, -(-sum(n.values()) // FILE_ROWS))
    asks = max(1, -(-n.get(True, 0) // QUERY_ROWS))
    spread = F.xxhash64("vec_id", F.lit("file"))
    candidates = rows.select("dims", F.pmod(spread, F.lit(files).cast("bigint")).alias("file"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(asks - 1).cast("bigint"))).alias("block"), F.lit(False).alias("asked"), "vec_id", "v")
    single = rows.where("ask").groupBy("vec_id", "dims").agg(F.min("v").alias("v"))
    queries = single.select("dims", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(files - 1).cast("bigint"))).alias("file"), F.pmod(spread, F.lit(asks).cast("bigint")).alias("block"), F.lit(True).alias("asked"), "vec_id", "v")
    both = candidates.unionAll(queries)
    best = both.groupBy("dims", "file", "block").applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

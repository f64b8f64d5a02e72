"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is one grouped minimum (pre-aggregated, so a hub costs a row per task) and one join back on the
node (a hub's rows are split by Spark's skew join). Each round's links are a table in the shared folder; the
driver sees only their number and checksums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def local_roots(u: np.ndarray, v: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """``roots`` (a smaller index for each of some rows of one task, or its own) after joining ``u`` and ``v``."""
    while True:
        a, b = roots[u], roots[v]
        apart = a != b
        if not apart.any():
            return roots
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots[:] = up


def _sums(edges: DataFrame) -> tuple:
    """Number and checksums of the links; sums of remainders, as those of the nodes may be too large for a number."""
    part = lambda c: F.sum(F.pmod(F.col(c), F.lit(1 << 20)))
    return tuple(edges.agg(F.count("*"), part("a"), part("b"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a bigint, b bigint): the smallest node it is linked to over
    any path. Self links, repeated and reversed links are allowed; an empty table gives an empty one."""
    a, b = F.col("a"), F.col("b")
    edges = stored(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    seen = _sums(edges)
    while seen[0]:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = edges.select("a", "b").unionAll(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, a == F.col("n")).where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = large.join(low, a == F.col("n"))
        small = joined.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        edges = stored(small.distinct(), name)
        now = _sums(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(a.alias("node"), b.alias("component"))
    return nodes.unionAll(edges.select(b.alias("node"), b.alias("component")).distinct())

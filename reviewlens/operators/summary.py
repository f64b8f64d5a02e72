"""Class distribution and per-class word counts.

Word counts are a partial + final hash aggregate on (class, token), so a very
frequent token costs one row per map task at the shuffle. The top-N cut is a
``row_number`` window that Spark turns into a partial ``WindowGroupLimit``
before the exchange: only N rows per class and task travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import raw_tokens
from .lineage import bounded_broadcast


def class_distribution(df: DataFrame, pred: Column | str, name: str = "class") -> DataFrame:
    """Rows per predicted class with their share in percent (1 decimal).

    Classes with no rows are absent; an empty input gives an empty table.
    """
    pred = F.col(pred) if isinstance(pred, str) else pred
    counts = df.groupBy(pred.cast("int").alias(name)).agg(F.count(F.lit(1)).alias("count"))
    # at most one row per class reaches this window
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.round(F.col("count") * 100.0 / total, 1))


def tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per word occurrence of the raw text (lower-cased)."""
    keep = keep or []
    return df.select(*keep, F.explode(raw_tokens(text)).alias("token"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    return tokens(df, text).distinct()


def token_counts(df: DataFrame, pred: Column | str, text: str = "text",
                 name: str = "class") -> DataFrame:
    """Occurrences of every token within each class."""
    pred = F.col(pred) if isinstance(pred, str) else pred
    t = df.select(pred.cast("int").alias(name), F.explode(raw_tokens(text)).alias("token"))
    return t.groupBy(name, "token").agg(F.count(F.lit(1)).alias("count"))


def drop_tokens(counts: DataFrame, stop: DataFrame | None) -> DataFrame:
    """Remove listed tokens (``stop`` has a ``token`` column). The list is
    broadcast only when its size, counted here, is under the broadcast bound."""
    if stop is None:
        return counts
    words = stop.select("token").distinct()
    return counts.join(bounded_broadcast(words, words.count()), "token", "left_anti")


def top_n(counts: DataFrame, n: int = 10, name: str = "class") -> DataFrame:
    """Top ``n`` tokens per class by count; ties go to the smaller token."""
    w = Window.partitionBy(name).orderBy(F.desc("count"), F.asc("token"))
    return (counts.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n)
            .select(name, "rank", "token", "count"))


def top_tokens(df: DataFrame, pred: Column | str, text: str = "text", n: int = 10,
               stop: DataFrame | None = None, name: str = "class") -> DataFrame:
    return top_n(drop_tokens(token_counts(df, pred, text, name), stop), n, name)

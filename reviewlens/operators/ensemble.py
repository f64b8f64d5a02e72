"""Decision rules that combine model outputs, row by row (codegen only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_threshold(prob: Column | str, threshold: float | Column) -> Column:
    """Positive when ``prob >= threshold`` (inclusive)."""
    prob = F.col(prob) if isinstance(prob, str) else prob
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (prob >= thr).cast("int")


def vote(p1: Column, p2: Column, p3: Column) -> Column:
    """Majority of three 0/1 predictions (the rounded mean can only be 0, 1/3,
    2/3 or 1, so no rounding tie exists)."""
    return ((p1.cast("int") + p2.cast("int") + p3.cast("int")) >= 2).cast("int")


def guard_scores(df: DataFrame, model: str) -> DataFrame:
    """A failed score (null) becomes label 0 / probability 0.0, as the
    reference does silently, and ``score_ok_<model>`` records the failure."""
    pred, prob = f"pred_{model}", f"prob_{model}"
    ok = F.col(pred).isNotNull() & F.col(prob).isNotNull()
    return df.withColumns({
        f"score_ok_{model}": ok,
        pred: F.when(ok, F.col(pred)).otherwise(F.lit(0)).cast("int"),
        prob: F.when(ok, F.col(prob)).otherwise(F.lit(0.0)).cast("double"),
    })

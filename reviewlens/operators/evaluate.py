"""Quality of predictions against labels, and the decision threshold.

Everything is one aggregate over the scored rows followed by arithmetic on a
handful of result rows; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    """num / den with the zero-division rule: 0 when den is 0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def metrics_from_counts(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    n = tp + fp + fn + tn
    return [
        F.round(_ratio(tp + tn, n), 4).alias("accuracy"),
        F.round(_ratio(tp, tp + fp), 4).alias("precision"),
        F.round(_ratio(tp, tp + fn), 4).alias("recall"),
        F.round(_ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
    ]


def evaluate(df: DataFrame, label: str, preds: dict[str, str], by: list[str] | tuple = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 per model, and for each group of ``by`` where columns are named.

    ``preds`` maps a model name to its 0/1 prediction column. The models are
    stacked into (model, y, p) rows so a single grouped aggregate serves all.
    Rows without a label are left out.
    """
    stacked = df.where(F.col(label).isNotNull()).select(
        *by, F.col(label).cast("int").alias("y"),
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("model"), F.col(c).cast("int").alias("p"))
            for name, c in preds.items()])).alias("m"))
    y, p = F.col("y"), F.col("m.p")
    counts = stacked.groupBy(F.col("m.model").alias("model"), *by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"))
    return counts.select("model", *by, "tp", "fp", "fn", "tn",
                         *metrics_from_counts(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def grid_threshold(k: Column, steps: int) -> Column:
    return k.cast("double") / F.lit(float(steps))


def threshold_curve(df: DataFrame, label: str, prob: str, steps: int = 100) -> DataFrame:
    """TP / FP / FN at every grid threshold ``k/steps`` (k = 1 .. steps-1),
    deciding positive when ``prob >= threshold``.

    Each row falls into bucket ``b`` = the largest k whose threshold it meets;
    counts per bucket are one small aggregate, and the counts at threshold k are
    running sums over buckets >= k (at most ``steps`` rows, not data-sized).
    """
    spark = df.sparkSession
    p, y = F.col(prob).cast("double"), F.col(label).cast("int")
    k0 = F.floor(p * steps).cast("int")
    # correct floor() for values within rounding of a grid point
    k1 = (F.when(p >= grid_threshold(k0 + 1, steps), k0 + 1)
          .when(p < grid_threshold(k0, steps), k0 - 1).otherwise(k0))
    bucket = F.least(F.greatest(k1, F.lit(0)), F.lit(steps - 1))
    per_bucket = (df.where(y.isNotNull() & p.isNotNull())
                  .groupBy(bucket.alias("k"))
                  .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))
    grid = spark.range(0, steps).select(F.col("id").cast("int").alias("k"))
    joined = grid.join(per_bucket, "k", "left").fillna(0, ["pos", "neg"])
    w_ge = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(F.lit(1))
    curve = joined.select(
        "k",
        F.sum("pos").over(w_ge).alias("tp"),
        F.sum("neg").over(w_ge).alias("fp"),
        F.sum("pos").over(total).alias("n_pos"))
    return (curve.where(F.col("k") >= 1)
            .select(grid_threshold(F.col("k"), steps).alias("threshold"), "tp", "fp",
                    (F.col("n_pos") - F.col("tp")).alias("fn")))


def best_threshold(df: DataFrame, label: str, prob: str, steps: int = 100) -> DataFrame:
    """Grid threshold with the highest F1; a tie goes to the lowest threshold."""
    curve = threshold_curve(df, label, prob, steps)
    f1 = _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return (curve.select("threshold", f1.alias("f1"))
            .orderBy(F.desc("f1"), F.asc("threshold")).limit(1))

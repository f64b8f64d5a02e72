"""Gradient-boosted trees on the SVD features (MLlib, distributed)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_gbt(train: DataFrame, features: str = "svd", label: str = "score", seed: int = 42,
            max_iter: int = 20, max_depth: int = 5, step_size: float = 0.1) -> GBTClassificationModel:
    data = train.where(F.col(label).isNotNull()).select(
        array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))
    gbt = GBTClassifier(seed=seed, maxIter=max_iter, maxDepth=max_depth, stepSize=step_size)
    return gbt.fit(data)


def score_gbt(df: DataFrame, model: GBTClassificationModel, features: str = "svd",
              key: str = "doc_id", keep: list[str] | tuple = ()) -> DataFrame:
    """``(key, *keep, pred_gbt, prob_gbt)``; the label is MLlib's argmax of
    the class probabilities (a tie goes to class 0)."""
    keep = list(keep)
    out = model.transform(df.withColumn("features", array_to_vector(features)))
    return out.select(key, *keep,
                      F.col("prediction").cast("int").alias("pred_gbt"),
                      vector_to_array("probability")[1].alias("prob_gbt"))

"""How the driver's tables stand in for the reference's review uploads.

``documents`` is the review table. Its sentiment-style 0/1 label is
``lang = 'en'`` (620/380 at sf0.01, a target the bag-of-words models can
separate); ``labels`` supplies ``quality`` and ``toxic`` labels for the
input-quality report and the evaluation tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import standardize
from ..sources.tables import table

N_FOLDS = 5


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a standardised review table: doc_id, text, score, ..."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("content"), "lang",
        (F.col("lang") == "en").cast("int").alias("label"))
    return standardize(docs).drop("content")


def labelled_reviews(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Documents with a label from the ``labels`` table (left join: unlabelled
    documents keep a null label)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return standardize(docs.join(labels, "doc_id", "left")).drop("content")


def with_split(df: DataFrame, key: str = "doc_id", folds: int = N_FOLDS) -> DataFrame:
    """Deterministic train/validation split: every ``folds``-th key validates."""
    return df.withColumn("is_train", F.pmod(F.col(key), F.lit(folds)) != 0)


def train_rows(df: DataFrame) -> DataFrame:
    return with_split(df).where("is_train").drop("is_train")


def valid_rows(df: DataFrame) -> DataFrame:
    return with_split(df).where(~F.col("is_train")).drop("is_train")

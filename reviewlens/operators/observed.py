"""Counts taken by the pass that does the work, and a timing table made of them.

``DataFrame.observe`` adds up metrics while another action runs, so row counts and input-quality counts cost no pass of
their own. An observation has a value once its DataFrame went through an action, whole.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..sources.experiments import PUBLISHED_TIMINGS

TIMINGS = ("model string, published_training_s double, published_inference_s double, training_s double, "
           "inference_s double, rows bigint, failed bigint, positive bigint, rows_per_s double")


def input_counts(text: str = "text", label: str | None = "score") -> list[Column]:
    """Rows, and those with no, a blank or an unusable part: what the upload report shows."""
    found = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(text).isNull()).alias("null_text"),
             F.count_if(F.coalesce(is_blank(text), F.lit(False))).alias("blank_text")]
    if label is not None:
        value = F.col(label).try_cast("double")
        found += [F.count_if(F.col(label).isNull()).alias("null_label"),
                  F.count_if(F.col(label).isNotNull() & ~F.coalesce(value.isin(0.0, 1.0), F.lit(False))).alias("bad_label")]
    return found


def score_counts(model: str) -> list[Column]:
    """Rows, failures and positives among the scores of one model; failures where ``score_ok_`` says so."""
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.col(f"pred_{model}")).alias("positive"),
            F.count_if(~F.col(f"score_ok_{model}")).alias("failed")]


def observed(df: DataFrame, name: str, metrics: list[Column]) -> tuple[DataFrame, Observation]:
    """``df``, and an observation that the next whole action over it fills."""
    seen = Observation(name)
    return df.observe(seen, *metrics), seen


@dataclass
class Stage:
    """Seconds of one action and what it counted on the way."""
    seconds: float
    counts: dict


def run_observed(df: DataFrame, name: str, metrics: list[Column], write=None) -> Stage:
    """Run ``df`` once, into ``write(df)`` or the no-op sink, and give its seconds and counts. Sums over no row are 0."""
    counted, seen = observed(df, name, metrics)
    start = time.time()
    if write is None:
        counted.write.format("noop").mode("overwrite").save()
    else:
        write(counted)
    return Stage(time.time() - start, {k: v or 0 for k, v in seen.get.items()})


def timing_table(spark: SparkSession, training: dict[str, float], inference: dict[str, Stage]) -> DataFrame:
    """One row for each model of the published table, in its order, with the measured seconds and observed counts beside
    the published ones; null where a model was not run."""
    rows = []
    for model, trained, inferred in PUBLISHED_TIMINGS:
        stage = inference.get(model)
        counts = stage.counts if stage else {}
        per_s = counts["rows"] / stage.seconds if stage and stage.seconds else None
        rows.append((model, trained, inferred, training.get(model), stage.seconds if stage else None,
                     counts.get("rows"), counts.get("failed"), counts.get("positive"), per_s))
    return spark.createDataFrame(rows, TIMINGS)

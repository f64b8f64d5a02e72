"""Multinomial Naive Bayes on TF-IDF rows, fitted and applied with joins and
aggregates only (no UDF).

Fit: feature mass per (class, term) from L2-normalised TF-IDF rows, smoothed by
``alpha``; class prior ``N_c / N`` (not smoothed).

Score: the joint log-likelihood of a document is
``prior_c + sum_t x_t * lp_c[t]`` with ``x_t = w_t / ||w||``, which equals
``prior_c + (sum_t w_t * lp_c[t]) / ||w||``. So one aggregate per document
computes both sums and the norm together: no join back to the documents and no
per-document window. ``P(1) = 1 / (1 + exp(jll_0 - jll_1))``; the label is the
argmax (a tie goes to class 0).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import lookup_sums, write_table
from .tfidf import TfidfModel, beside_norms, inv_norm


@dataclass
class NBModel:
    table: DataFrame          # term, idf, lp0, lp1
    log_prior0: float
    log_prior1: float
    n_terms: int
    alpha: float


def class_counts(train: DataFrame, label: str = "score") -> dict[int, int]:
    """Labelled rows per class (three numbers reach the driver). Rows without
    a label are not counted; labels other than 0 and 1 are an error, as they
    would otherwise be fitted as neither class."""
    y = F.col(label).cast("double")
    row = train.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"),
                    F.count_if(y.isNotNull() & ~y.isin(0.0, 1.0)).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} labels are neither 0 nor 1; map them to 0/1 first")
    return {0: int(row["n0"]), 1: int(row["n1"])}


def feature_mass(train_tf: DataFrame, vocab: TfidfModel, label: str = "score", key: str = "doc_id") -> DataFrame:
    """``(term, idf, fc0, fc1)``: each term's TF-IDF summed over the documents of each class, stored. The idf is the same
    in all rows of a term, so it multiplies the sums and no row looks it up."""
    y, x = F.col(label).cast("int"), F.col("tf") / F.col("_norm")
    sums = beside_norms(train_tf.where(F.col("term").isNotNull()), vocab, key).groupBy("term").agg(
        F.sum(F.when(y == 0, x).otherwise(0.0)).alias("s0"),
        F.sum(F.when(y == 1, x).otherwise(0.0)).alias("s1"))
    fc = sums.join(vocab.table.select("term", "idf").hint("shuffle_hash"), "term").select(
        "term", "idf", (F.col("s0") * F.col("idf")).alias("fc0"), (F.col("s1") * F.col("idf")).alias("fc1"))
    return write_table(fc, "nb-feature-mass")


def fit_nb(train_tf: DataFrame, vocab: TfidfModel, counts: dict[int, int],
           label: str = "score", key: str = "doc_id", alpha: float = 1.0, mass: DataFrame | None = None) -> NBModel:
    """``train_tf`` carries ``(key, label, term, tf)`` of the training rows. ``mass``: their ``feature_mass``, where
    several models are fitted on the same rows."""
    return fit_nb_each(train_tf, vocab, counts, {"nb": alpha}, label, key, mass)[1]["nb"]


def fit_nb_each(train_tf: DataFrame, vocab: TfidfModel, counts: dict[int, int], alphas: dict[str, float],
                label: str = "score", key: str = "doc_id", mass: DataFrame | None = None) -> tuple[DataFrame, dict[str, NBModel]]:
    """A model of each smoothing by name, and one table ``term, idf, lp0_<name>, lp1_<name>`` of them all."""
    fc = feature_mass(train_tf, vocab, label, key) if mass is None else mass
    tot = fc.agg(F.sum("fc0").alias("t0"), F.sum("fc1").alias("t1")).first()
    v = vocab.n_terms
    smoothed = [F.log((F.col(f"fc{c}") + alpha) / ((tot[f"t{c}"] or 0.0) + alpha * v)).alias(f"lp{c}_{name}")
                for name, alpha in alphas.items() for c in (0, 1)]
    table = write_table(fc.select("term", "idf", *smoothed), "nb-model")
    n = sum(counts.values())
    if not n:
        raise ValueError("no labelled training rows")
    lp = {c: (math.log(counts.get(c, 0) / n) if counts.get(c, 0) else float("-inf"))
          for c in (0, 1)}
    return table, {name: NBModel(table.select("term", "idf", F.col(f"lp0_{name}").alias("lp0"), F.col(f"lp1_{name}").alias("lp1")),
                                 lp[0], lp[1], v, alpha) for name, alpha in alphas.items()}


def score_nb(tf: DataFrame, model: NBModel, key: str = "doc_id",
             keep: list[str] | tuple = ()) -> DataFrame:
    """``(key, *keep, pred_nb, prob_nb)`` for every document in ``tf``."""
    table = model.table.withColumnsRenamed({"lp0": "lp0_nb", "lp1": "lp1_nb"})
    return score_nb_each(tf, table, {"nb": model}, key, keep)


def score_nb_each(tf: DataFrame, table: DataFrame, models: dict[str, NBModel], key: str = "doc_id",
                  keep: list[str] | tuple = ()) -> DataFrame:
    """``(key, *keep)`` and each model's ``pred_<name>, prob_<name>``, from one lookup in the ``table`` of
    ``fit_nb_each``."""
    by, w = [key, *keep], F.col("tf") * F.col("idf")
    sums = {"s2": w * w} | {f"a{c}_{name}": w * F.col(f"lp{c}_{name}") for name in models for c in (0, 1)}
    n_terms = next(iter(models.values())).n_terms
    doc = lookup_sums(tf, table, "term", n_terms, -F.col("idf"), by, ["tf"], sums)
    inv = inv_norm(F.coalesce(F.col("s2"), F.lit(0.0)))
    out = []
    for name, model in models.items():
        jll0, jll1 = (F.lit(prior) + F.coalesce(F.col(f"a{c}_{name}"), F.lit(0.0)) * inv
                      for c, prior in enumerate((model.log_prior0, model.log_prior1)))
        out += [(jll1 > jll0).cast("int").alias(f"pred_{name}"),
                (F.lit(1.0) / (F.lit(1.0) + F.exp(jll0 - jll1))).alias(f"prob_{name}")]
    return doc.select(*by, *out)

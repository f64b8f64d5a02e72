"""Save and load a fitted model bundle as Spark-written tables.

Every artifact is a parquet table under one folder, so any executor or a later job can read it; scoring broadcasts the
small ones.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from ..operators.boosting import model_from
from ..operators.gru import GRUModel
from ..operators.naive_bayes import NBModel
from ..operators.scoring import ModelBundle
from ..operators.sequence import WordIndex
from ..operators.svd import SVDModel
from ..operators.tfidf import TfidfModel


def save_model(models: ModelBundle, path: str) -> None:
    """Write a bundle; of a bundle of Naive Bayes alone its tables. The meta row, which says what else is there, is
    written last, so a folder without it holds no model yet."""
    spark = models.vocab.table.sparkSession
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    write(models.vocab.table, "vocab")
    write(models.nb.table, "nb")
    meta = {"n_docs": models.vocab.n_docs, "n_terms": models.vocab.n_terms,
            "log_prior0": models.nb.log_prior0, "log_prior1": models.nb.log_prior1,
            "alpha": models.nb.alpha, "trees": models.gbt is not None, "gru": models.gru is not None}
    if models.gbt is not None:
        write(models.term_index, "term_index")
        write(models.svd.basis, "svd")
        write(models.gbt.table(spark), "gbt")
        meta |= {"svd_terms": models.svd.n_terms, "svd_blocks": models.svd.blocks, "gbt_base": models.gbt.base,
                 "singular_values": [float(x) for x in models.svd.singular_values]}
    if models.gru is not None:
        write(models.words.table, "words")
        core = [(k, list(v.shape), [float(x) for x in np.ravel(v)]) for k, v in models.gru.core.items()]
        write(spark.createDataFrame(core, "name string, shape array<int>, values array<double>"), "gru")
        write(models.gru.rows, "gru_rows")
        meta |= {"num_words": models.words.num_words, "n_words": models.words.n_words,
                 "maxlen": models.gru.maxlen, "threshold": models.gru.threshold, "gru_seed": models.gru.seed}
    write(spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1), "meta")


def load_model(spark: SparkSession, path: str) -> ModelBundle:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    meta = json.loads(read("meta").first()["meta"])
    vocab = TfidfModel(read("vocab"), meta["n_docs"], meta["n_terms"])
    nb = NBModel(read("nb"), meta["log_prior0"], meta["log_prior1"], meta["n_terms"], meta["alpha"])
    models = ModelBundle(vocab, nb)
    if meta["trees"]:
        models.term_index = read("term_index")
        models.svd = SVDModel(models.term_index, read("svd"), np.array(meta["singular_values"]), meta["svd_terms"], meta["svd_blocks"])
        models.gbt = model_from(meta["gbt_base"], read("gbt"))
    if meta["gru"]:
        models.words = WordIndex(read("words"), meta["num_words"], meta["n_words"])
        core = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in read("gru").collect()}
        models.gru = GRUModel(core, read("gru_rows"), meta["maxlen"], meta["threshold"], meta["gru_seed"], meta["num_words"])
    return models

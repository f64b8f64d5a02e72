"""TF-IDF as relational operators.

Documents become a long table ``(doc_id, term, tf)``: ``explode`` keeps every
token of a document in the task that read it, so the partial aggregate
collapses it to one row per (document, term) before the shuffle. What is stored
of it is one row per document (``stored_frequencies``), several times smaller.

The fitted vocabulary follows the public scikit-learn defaults: terms of two
letters or more, smooth idf ``ln((1+n)/(1+df)) + 1``, raw counts, L2 norm.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tfidf_terms
from .lineage import checkpoint_partitioned, lookup, lookup_sums, text_partitions, write_table
from .ranking import global_rank


@dataclass
class TfidfModel:
    table: DataFrame          # term, df, idf
    n_docs: int
    n_terms: int


def term_frequencies(docs: DataFrame, text: str = "clean", key: str = "doc_id",
                     keep: list[str] | tuple = ()) -> DataFrame:
    """``(key, *keep, term, tf)``; a document without terms keeps one row with
    a null term and tf 0 so it is never lost downstream."""
    keep = list(keep)
    exploded = docs.select(key, *keep, F.explode_outer(tfidf_terms(text)).alias("term"))
    return exploded.groupBy(key, *keep, "term").agg(F.count("term").alias("tf"))


@F.arrow_udf(T.StructType().add("terms", T.StringType()).add("tfs", T.ArrayType(T.IntegerType())))
def _counted(texts: pa.Array) -> pa.Array:
    """The terms (``tfidf_terms``) of each text, joined by spaces as first found, and how often each is; null for none."""
    terms, tfs, ends = [], array("i"), [0]
    for text in texts:
        found = Counter(text.as_py().split(" "))
        for short in [w for w in found if len(w) < 2]:
            del found[short]
        terms.append(" ".join(found) if found else None)
        tfs.extend(found.values())
        ends.append(len(tfs))
    # the offset of a null list is null
    starts = [None if t is None else at for t, at in zip(terms, ends)] + ends[-1:]
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(tfs, np.int32), pa.int32()))
    return pa.StructArray.from_arrays([pa.array(terms, pa.string()), lists], ["terms", "tfs"])


def packed_frequencies(docs: DataFrame, text: str = "clean", key: str = "doc_id",
                       keep: list[str] | tuple = ()) -> DataFrame:
    """``term_frequencies``, stored once: a row for each (key, *keep) with its terms joined by spaces (``_terms``) and
    their counts (``_tfs``), null for none."""
    keep = list(keep)
    one = docs.groupBy(key, *keep).agg(F.array_join(F.collect_list(text), " ").alias("_text"))
    found = one.select(key, *keep, _counted("_text").alias("_found"))
    packed = found.select(key, *keep, F.col("_found.terms").alias("_terms"), F.col("_found.tfs").alias("_tfs"))
    # the Arrow node hides the partitioning, so the counts, smaller than the text, move once
    return checkpoint_partitioned(packed.repartition(text_partitions(docs), key))


def spread(packed: DataFrame, key: str = "doc_id", keep: list[str] | tuple = ()) -> DataFrame:
    """``term_frequencies`` of packed ones, next to each other and in the partition of their document."""
    pairs = F.arrays_zip(F.split("_terms", " ").alias("term"), F.col("_tfs").alias("tf"))
    return (packed.select(key, *keep, F.explode_outer(pairs).alias("_pair"))
            .select(key, *keep, F.col("_pair.term").alias("term"),
                    F.coalesce(F.col("_pair.tf").cast("bigint"), F.lit(0)).alias("tf")))


def stored_frequencies(docs: DataFrame, text: str = "clean", key: str = "doc_id",
                       keep: list[str] | tuple = ()) -> DataFrame:
    """``packed_frequencies``, spread out anew by every use."""
    return spread(packed_frequencies(docs, text, key, keep), key, keep)


def fit_tfidf(train_tf: DataFrame, n_docs: int, min_df: int = 1,
              max_features: int | None = None, key: str = "doc_id") -> TfidfModel:
    """Vocabulary and idf from training term frequencies."""
    stats = (train_tf.where(F.col("term").isNotNull())
             .groupBy("term")
             .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    if min_df > 1:
        stats = stats.where(F.col("df") >= min_df)
    if max_features is not None:
        # top terms by corpus frequency, ties to the smaller term (exact
        # distributed rank: no task gathers the whole vocabulary)
        stats = global_rank(stats, [F.desc("cf"), F.asc("term")], k=max_features).drop("rank")
    n = float(n_docs)
    table = stats.select(
        "term", "df",
        (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    table = write_table(table, "tfidf-vocab")
    return TfidfModel(table, n_docs, table.count())


def weights(tf: DataFrame, model: TfidfModel, key: str = "doc_id",
            keep: list[str] | tuple = (), how: str = "inner") -> DataFrame:
    """Unnormalised weights ``w = tf * idf`` for vocabulary terms.

    ``how='left'`` keeps documents without any vocabulary term (null ``w``)."""
    # the rarer a term, the greater its idf
    return (lookup(tf, model.table.select("term", "idf"), "term", model.n_terms, -F.col("idf"), how)
            .select(key, *keep, "term", (F.col("tf") * F.col("idf")).alias("w")))


def norms(tf: DataFrame, model: TfidfModel, key: str = "doc_id") -> DataFrame:
    """``(key, _norm)``: the L2 norm of each document's weights, for documents with a vocabulary term."""
    w = F.col("tf") * F.col("idf")
    squares = lookup_sums(tf, model.table.select("term", "idf"), "term", model.n_terms, -F.col("idf"), [key], ["tf"], {"_s2": w * w})
    return squares.where(F.col("_s2").isNotNull()).select(key, F.sqrt("_s2").alias("_norm"))


def beside_norms(tf: DataFrame, model: TfidfModel, key: str = "doc_id", how: str = "inner") -> DataFrame:
    """``tf`` with its document's ``_norm``. Where ``tf`` is partitioned by document only the norms move; rows without
    a key are one document."""
    found = norms(tf, model, key)
    keyed = tf.where(F.col(key).isNotNull()).join(found.where(F.col(key).isNotNull()).hint("shuffle_hash"), key, how)
    # one norm at most
    unkeyed = tf.where(F.col(key).isNull()).join(F.broadcast(found.where(F.col(key).isNull()).drop(key)), how=how, on=F.lit(True))
    return keyed.select(*tf.columns, "_norm").unionByName(unkeyed)


def tfidf(tf: DataFrame, model: TfidfModel, key: str = "doc_id",
          keep: list[str] | tuple = (), how: str = "inner") -> DataFrame:
    """Sparse TF-IDF rows as ``(key, *keep, term, x)`` with unit L2 norm. The norms are an aggregate of their own, so
    no document's terms are sorted or moved for them."""
    normed = beside_norms(tf, model, key, how)
    return (weights(normed, model, key, [*keep, "_norm"], how)
            .select(key, *keep, "term", (F.col("w") / F.col("_norm")).alias("x")))


def inv_norm(sum_sq: Column) -> Column:
    """1/||w||, or 0 for a document with no vocabulary term."""
    return F.when(sum_sq > 0, F.lit(1.0) / F.sqrt(sum_sq)).otherwise(F.lit(0.0))

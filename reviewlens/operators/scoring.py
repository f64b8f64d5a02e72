"""Score any review table with all three fitted models in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_light, clean_ml, nfkc_delta
from . import boosting
from . import gru as gru_ops
from . import naive_bayes as nb_ops
from . import sequence as seq_ops
from . import svd as svd_ops
from . import tfidf as tfidf_ops
from .ensemble import guard_scores, vote
from .lineage import checkpoint_partitioned, text_partitions

MODEL_COLUMNS = ["pred_nb", "prob_nb", "pred_gbt", "prob_gbt", "pred_gru", "prob_gru"]


@dataclass
class ModelBundle:
    """All three models, or Naive Bayes alone."""
    vocab: tfidf_ops.TfidfModel
    nb: nb_ops.NBModel
    term_index: DataFrame | None = None
    svd: svd_ops.SVDModel | None = None
    gbt: boosting.LeafwiseModel | None = None
    words: seq_ops.WordIndex | None = None
    gru: gru_ops.GRUModel | None = None


def prepare(df: DataFrame, text: str = "text", key: str = "doc_id",
            keep: list[str] | tuple = (), partitions: int | None = None) -> DataFrame:
    """The reviews hash-partitioned by ``key`` and checkpointed once, with the
    cleaned texts as lazy columns. The three model branches read this one
    stored copy: the text is scanned, normalised and shuffled once (not once
    per branch), and every per-document step after it is shuffle-free.
    NFKC (an Arrow UDF) runs before the exchange so the partitioning stays
    visible to the planner; only its delta is stored next to the text."""
    n = text_partitions(df, partitions)
    moved = df.select(key, *keep, F.col(text).alias("_text"),
                      nfkc_delta(text).alias("_nfkc")).repartition(n, key)
    stored = checkpoint_partitioned(moved)
    norm = F.coalesce(F.col("_nfkc"), F.col("_text"))
    return stored.select(key, *keep, clean_ml(norm, normalize=False).alias("clean"),
                         clean_light(norm, normalize=False).alias("clean_light"))


def score_prepared(prepared: DataFrame, models: ModelBundle, key: str = "doc_id",
                   keep: list[str] | tuple = ()) -> DataFrame:
    """Six model columns, failure flags and the 2-of-3 vote per document; of a bundle of Naive Bayes alone its
    columns and flag.

    Each model produces one narrow row per document; they are joined on the key
    (left joins from the NB side, which has every document)."""
    keep = list(keep)
    # counted as by the fit; three passes read it, or one of Naive Bayes alone
    packed = tfidf_ops.packed_frequencies(prepared, "clean", key, keep)
    tf = tfidf_ops.spread(packed, key, keep)
    nb = nb_ops.score_nb(tf, models.nb, key, keep)
    if models.gbt is None:
        return guard_scores(nb, "nb")
    entries = packed.agg(F.sum(F.size("_tfs"))).first()[0] or 0
    side = models.svd.side
    # a basis that is not broadcast is sent to the parts
    in_parts = 8 * side.n * side.width > svd_ops.BROADCAST_BYTES
    rows = svd_ops.sparse_parts(packed.select(key, "_terms", "_tfs"), models.vocab, models.term_index,
                                svd_ops.parts_for(entries, side.n, side.width), key, stored=in_parts)
    rows = rows if in_parts else checkpoint_partitioned(rows)
    gbt = boosting.score_leafwise(svd_ops.svd_project(rows, models.svd, key), models.gbt, key=key)
    # stored: a large embedding's shards read them three times
    seqs = checkpoint_partitioned(seq_ops.encode_sequence(prepared.select(key, "clean_light"), models.words,
                                                          maxlen=models.gru.maxlen, key=key))
    gru = gru_ops.score_gru(seqs, models.gru, key=key)
    out = nb.join(gbt, key, "left").join(gru, key, "left")
    for m in ("nb", "gbt", "gru"):
        out = guard_scores(out, m)
    return out.withColumn("pred_vote", vote(F.col("pred_nb"), F.col("pred_gbt"), F.col("pred_gru")))


def score_reviews(df: DataFrame, models: ModelBundle, text: str = "text", key: str = "doc_id",
                  keep: list[str] | tuple = ()) -> DataFrame:
    return score_prepared(prepare(df, text, key, keep), models, key, keep)


def beside_inputs(df: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every column of ``df`` with the columns of ``scores`` (one row per ``key``) beside them. A score
    column named like an input column, in any case, is an error: it would hide the user's own. The scores are hashed, so
    no input row, with its text, is sorted."""
    names = {c.lower() for c in df.columns}
    clash = [c for c in scores.columns if c != key and c.lower() in names]
    if clash:
        raise ValueError(f"input columns named like score columns: {', '.join(clash)}")
    return df.join(scores.hint("shuffle_hash"), key, "left")

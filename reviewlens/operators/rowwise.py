"""Reviews scored where they are read: every model applied to one document at a time.

The fitted tables travel to the executors as sorted arrays, so a document needs no join, no grouping and no shuffle: one
review is one row of one task, and a stream is scored by a plain ``writeStream``. The text is cleaned once, in the JVM; a
batch of documents looks its words up in the arrays at once. This is for models within the broadcast bounds
(``RowScorer.of`` says so); larger ones are scored with joins, by ``scoring.score_reviews`` or, with the columns of
``score_rows``, by ``score_rows_by_joins``. ``score_any_rows`` takes the one that fits.

A model that fails on a batch is tried on the batch's halves, and so on down to single rows: a row it fails on gets label 0,
probability 0.0, ``score_ok_<model>`` false and the error's text in ``score_error_<model>``; all other rows are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_light, clean_ml, confidence_pct, label_text, nfkc_delta, tfidf_terms, words
from . import boosting, gru
from .columns import resolve_columns
from .ensemble import guard_scores, vote
from .lineage import MAX_BROADCAST_BYTES, checkpoint_partitioned, fits_broadcast, text_partitions
from .scoring import ModelBundle, score_prepared
from .svd import collected

#: Documents and non-zeros that a kernel takes in at a time.
ROWS, CELLS = 512, 4 << 20
TERMS, WORDS = "_row_terms", "_row_words"

#: (labels, probabilities) of a batch with the columns TERMS and WORDS.
Kernel = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def isolated(kernel: Kernel, batch: pa.RecordBatch) -> tuple[list, list, list]:
    """(labels, probabilities, errors) of each row; None and the error's text where the kernel fails on the row alone."""
    try:
        label, prob = kernel(batch)
        if len(label) != len(batch) or len(prob) != len(batch):
            raise ValueError(f"{len(label)} scores for {len(batch)} rows")
        return label.tolist(), prob.tolist(), [None] * len(batch)
    except Exception as error:  # whatever a model raises is the row's result
        if len(batch) == 1:
            return [None], [None], [f"{type(error).__name__}: {error}"[:500]]
    half = len(batch) // 2
    parts = isolated(kernel, batch.slice(0, half)), isolated(kernel, batch.slice(half))
    return tuple(a + b for a, b in zip(*parts))


def _counts(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of the known terms of each document."""
    lists = batch.column(TERMS)
    found = pc.index_in(lists.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    document = np.repeat(np.arange(len(batch)), size)
    n = max(len(terms), 1)
    pair, times = np.unique((document * n + found)[found >= 0], return_counts=True)
    return pair // n, pair % n, times


@dataclass
class RowScorer:
    """The arrays of a bundle, sorted by term or word."""

    terms: pa.Array
    idf: np.ndarray
    lp0: np.ndarray
    lp1: np.ndarray
    prior: tuple[float, float]
    basis: np.ndarray | None = None
    trees: boosting.LeafwiseModel | None = None
    words: pa.Array | None = None
    ids: np.ndarray | None = None
    core: dict = field(default_factory=dict)
    vectors: np.ndarray | None = None
    maxlen: int = 0
    threshold: float = 0.5

    @classmethod
    def of(cls, models: ModelBundle) -> RowScorer | None:
        """The bundle's arrays, or None if its tables are beyond the broadcast bounds."""
        table, n = models.nb.table, models.nb.n_terms
        k = len(models.svd.singular_values) if models.gbt is not None else 0
        fits = fits_broadcast(table, n) and 8 * k * n <= MAX_BROADCAST_BYTES
        if models.gru is not None:
            fits = fits and fits_broadcast(models.words.table, models.words.n_words) and 8 * models.gru.embed * models.words.num_words <= MAX_BROADCAST_BYTES
        if not fits:
            return None
        if k:
            table = table.join(models.term_index, "term", "left")
        held = table.orderBy("term").toArrow()
        column = lambda name: held.column(name).to_numpy()
        scorer = cls(held.column("term").combine_chunks().cast(pa.string()), column("idf"), column("lp0"), column("lp1"), (models.nb.log_prior0, models.nb.log_prior1))
        if k:
            at = held.column("idx").fill_null(-1).to_numpy()
            basis = collected(models.svd.basis, models.svd.side)
            scorer.basis = np.where(at[:, None] >= 0, basis[at], 0.0)
            scorer.trees = models.gbt
        if models.gru is not None:
            found = models.words.table.select("word", "id").orderBy("word").toArrow()
            scorer.words, scorer.ids = found.column("word").combine_chunks().cast(pa.string()), found.column("id").to_numpy().astype(np.int64)
            scorer.core, scorer.maxlen, scorer.threshold = models.gru.core, models.gru.maxlen, models.gru.threshold
            scorer.vectors = gru.init_rows(np.arange(models.gru.num_words), models.gru.embed, models.gru.seed)
            rows = models.gru.rows.toArrow()
            if len(rows):
                scorer.vectors[rows.column("id").to_numpy()] = rows.column("e").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        return scorer

    @property
    def models(self) -> list[str]:
        return ["nb", *(["gbt"] if self.trees else []), *(["gru"] if self.words is not None else [])]

    def nb(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        document, term, times = _counts(batch, self.terms)
        w = times * self.idf[term]
        total = lambda x: np.bincount(document, x, len(batch))
        s2 = total(w * w)
        inv = np.where(s2 > 0, 1.0 / np.sqrt(np.where(s2 > 0, s2, 1.0)), 0.0)
        # classes without a training row have the prior log 0
        with np.errstate(invalid="ignore", over="ignore"):
            j0, j1 = (p + total(w * lp[term]) * inv for p, lp in zip(self.prior, (self.lp0, self.lp1)))
            return (j1 > j0).astype(np.int32), 1.0 / (1.0 + np.exp(j0 - j1))

    def gbt(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        document, term, times = _counts(batch, self.terms)
        w = times * self.idf[term]
        norm = np.sqrt(np.bincount(document, w * w, len(batch)))
        features = np.zeros((len(batch), self.basis.shape[1]))
        step = max(1, CELLS // self.basis.shape[1])
        for at in range(0, len(term), step):
            some = slice(at, at + step)
            heads = np.flatnonzero(np.r_[True, np.diff(document[some]) != 0])
            part = (w[some] / norm[document[some]])[:, None] * self.basis[term[some]]
            features[document[some][heads]] += np.add.reduceat(part, heads, axis=0)
        return self.trees.predict(features)

    def gru(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(WORDS)
        size = np.minimum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), self.maxlen)
        head = pc.list_slice(lists.fill_null([]), 0, self.maxlen).flatten()
        found = pc.index_in(head, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.zeros((len(batch), self.maxlen), np.int64)
        ids[np.repeat(np.arange(len(batch)), size), np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size)] = np.where(found >= 0, self.ids[found], 1)
        prob = gru.forward({"E": self.vectors, **self.core}, ids)
        return (prob >= self.threshold).astype(np.int32), prob


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _score_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns that scoring makes first; those of ``df`` named like any that it adds are an error."""
    columns = [f"{kind}_{m}" for m in names for kind in ("pred", "prob", "score_error")]
    added = {*columns, *(f"{kind}_{m}" for m in names for kind in ("score_ok", "label", "percent")), "pred_vote", TERMS, WORDS, "_row_text", "_row_nfkc", "_row_id"}
    clash = [c for c in df.columns if c.lower() in added]
    if clash:
        raise ValueError(f"input columns named like score columns: {', '.join(clash)}")
    return columns


def _with_texts(df: DataFrame, text: str | None) -> DataFrame:
    """``df`` with its text, ``nan`` where it is missing, and what NFKC makes of it."""
    quoted = F.col(_quoted(text or resolve_columns(df.columns).text))
    return df.withColumn("_row_text", F.coalesce(quoted.cast("string"), F.lit("nan"))).withColumn("_row_nfkc", nfkc_delta("_row_text"))


def score_rows(df: DataFrame, models: ModelBundle | RowScorer, text: str | None = None, kernels: dict[str, Kernel] | None = None) -> DataFrame:
    """Every column of ``df``, batch or stream, and for each model ``pred_``, ``prob_``, ``score_ok_``, ``score_error_``,
    ``label_`` (Positif or Negatif) and ``percent_`` (whole per cent) columns; of all three models also ``pred_vote``.

    ``text`` defaults to the column that the accepted names point at; a missing text is the word ``nan``. ``kernels`` adds
    models of one's own. A score column named like an input column, in any case, is an error."""
    scorer = models if isinstance(models, RowScorer) else RowScorer.of(models)
    if scorer is None:
        raise ValueError("the models are beyond the broadcast bounds; use score_reviews")
    names = [*scorer.models, *(kernels or {})]
    score_columns = _score_columns(df, names)
    plain = _with_texts(df, text)
    norm = F.coalesce(F.col("_row_nfkc"), F.col("_row_text"))
    # inputs travel under plain names: Arrow functions do not take a name with a dot
    plain_names = [f"_row_input_{i}" for i in range(len(df.columns))]
    inputs = [F.col(_quoted(c)).alias(p) for c, p in zip(df.columns, plain_names)]
    taken = plain.select(*inputs, tfidf_terms(clean_ml(norm, normalize=False)).alias(TERMS), words(clean_light(norm, normalize=False)).alias(WORDS))
    kinds = {"pred": T.IntegerType(), "prob": T.DoubleType(), "score_error": T.StringType()}
    schema = T.StructType([*(T.StructField(p, f.dataType) for p, f in zip(plain_names, df.schema)), *(T.StructField(c, kinds[c.rsplit("_", 1)[0]]) for c in score_columns)])
    sent, n, own = df.sparkSession.sparkContext.broadcast(scorer), len(df.columns), kernels or {}
    arrow = {"pred": pa.int32(), "prob": pa.float64(), "score_error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        every = {**{m: getattr(held, m) for m in held.models}, **own}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                out = [pa.array(x, arrow[kind]) for kernel in every.values() for x, kind in zip(isolated(kernel, some), arrow)]
                yield pa.RecordBatch.from_arrays([*some.columns[:n], *out], schema.names)

    scored = taken.mapInArrow(run, schema)
    for m in names:
        scored = guard_scores(scored, m).withColumns({f"label_{m}": label_text(f"pred_{m}"), f"percent_{m}": confidence_pct(f"prob_{m}")})
    scored = scored.withColumnsRenamed(dict(zip(plain_names, df.columns)))
    if {"nb", "gbt", "gru"} <= set(names):
        scored = scored.withColumn("pred_vote", vote(F.col("pred_nb"), F.col("pred_gbt"), F.col("pred_gru")))
    return scored


def score_rows_by_joins(df: DataFrame, models: ModelBundle, text: str | None = None) -> DataFrame:
    """The columns of ``score_rows`` from models of any size, for a batch: the rows get a number, are stored by it once,
    and meet their narrow scores there. No model is tried row by row, so ``score_error_`` is null."""
    names = ["nb", *(["gbt"] if models.gbt else []), *(["gru"] if models.gru else [])]
    score_columns, n = _score_columns(df, names), text_partitions(df)
    numbered = _with_texts(df, text).withColumn("_row_id", F.monotonically_increasing_id())
    # the text is the input's own column but for a missing one
    stored = checkpoint_partitioned(numbered.drop("_row_text").repartition(n, "_row_id"))
    own = F.coalesce(F.col(_quoted(text or resolve_columns(df.columns).text)).cast("string"), F.lit("nan"))
    norm = F.coalesce(F.col("_row_nfkc"), own)
    prepared = stored.select("_row_id", clean_ml(norm, normalize=False).alias("clean"), clean_light(norm, normalize=False).alias("clean_light"))
    scored = stored.drop("_row_nfkc").join(score_prepared(prepared, models, "_row_id").hint("shuffle_hash"), "_row_id", "left")
    more = {}
    for m in names:
        more |= {f"score_error_{m}": F.lit(None).cast("string"), f"label_{m}": label_text(f"pred_{m}"), f"percent_{m}": confidence_pct(f"prob_{m}")}
    scored = scored.withColumns(more)
    last = [f"{kind}_{m}" for m in names for kind in ("score_ok", "label", "percent")] + (["pred_vote"] if len(names) == 3 else [])
    return scored.select(*(_quoted(c) for c in df.columns), *score_columns, *last)


def score_any_rows(df: DataFrame, models: ModelBundle, text: str | None = None) -> DataFrame:
    """``score_rows`` where the models are within the broadcast bounds, else ``score_rows_by_joins``."""
    scorer = RowScorer.of(models)
    return score_rows_by_joins(df, models, text) if scorer is None else score_rows(df, scorer, text)


def score_review(spark: SparkSession, review: str, models: ModelBundle | RowScorer) -> DataFrame:
    """One typed-in review: one row, read and scored in one task. A blank one is an error, as there is nothing to score."""
    if not review.strip():
        raise ValueError("an empty review")
    return score_rows(spark.createDataFrame([(review,)], "text string").coalesce(1), models)

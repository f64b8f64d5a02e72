"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every n-gram of 1 to ``ORDERS`` characters of the lower-cased text is hashed to one of ``BUCKETS`` buckets. Counts by
language and bucket are taken over all learning rows: each task sums its own batches in numpy, then Spark adds up the
tasks' counts. The model is a matrix of languages x buckets, whose size is fixed by the two, so it is broadcast; a batch
of texts is scored by gathering the matrix's rows for all its n-grams and adding them up per text.

The score of a row is the posterior probability of its predicted language. Texts that are null or have no letter get
``und`` and the score 0, as does every text when nothing could be learned. Ties go to the language that sorts first.
Repeated rows are scored alike; learning counts each of them. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, per_text, stored

BUCKET_BITS, ORDERS = 16, 3
BUCKETS = 1 << BUCKET_BITS
#: Characters whose n-grams are held at a time.
WINDOW = 1 << 18
#: Languages of a model at most: its matrix has so many rows of BUCKETS doubles.
MOST_LANGUAGES = 512
SMOOTHING = 0.5
UNKNOWN = "und"
_MULTIPLIER = np.uint32(2654435761)


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points, text of each, length of the overlap with the window before) over all texts of a batch. Texts are
    closed by a space on either side; a long text goes on in the next window."""
    points: list[str] = []
    owner: list[tuple[int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        at = 0
        while at < len(text):
            part = text[max(0, at - ORDERS + 1):at + WINDOW - size]
            fresh = min(len(text) - at, WINDOW - size)
            points.append(part)
            owner.append((i, len(part) - fresh))
            size += fresh
            at += fresh
            if size >= WINDOW:
                yield from _window(points, owner)
                points, owner, size = [], [], 0
    if points:
        yield from _window(points, owner)


def _window(parts: list[str], owner: list[tuple[int, int]]):
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths) - lengths
    yield code, np.array([o for o, _ in owner]), np.array([k for _, k in owner]), starts


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of all n-grams of a batch, window by window and order by order."""
    for code, owner, known, starts in windows(texts):
        ends = np.r_[starts[1:], len(code)]
        place = np.arange(len(code))
        text_of = np.repeat(np.arange(len(owner)), ends - starts)
        # an n-gram belongs to its last character; the overlap's own n-grams were counted before
        new = place >= (starts + known)[text_of]
        value = code.astype(np.uint32)
        h = np.zeros(len(code), np.uint32)
        for order in range(1, ORDERS + 1):
            shifted = value if order == 1 else np.r_[np.zeros(order - 1, np.uint32), value[:-(order - 1)]] if len(value) >= order else np.zeros_like(value)
            h = (h ^ (shifted + np.uint32(order))) * _MULTIPLIER
            whole = new & (place - (order - 1) >= starts[text_of])
            yield ((h * _MULTIPLIER) >> np.uint32(32 - BUCKET_BITS))[whole], owner[text_of][whole]


def _count(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            kinds = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for bucket, text in grams(batch.column(0).to_pylist()):
                total += np.bincount(kinds[text] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "n"])

    return run


@dataclass
class LanguageModel:
    languages: list[str]
    #: Log probability of each bucket in each language, [BUCKETS, languages].
    weights: np.ndarray
    #: Log share of the learning rows.
    prior: np.ndarray


def fit(df: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """Model of all rows of ``df`` with a text and a language."""
    rows = df.where(col(text).isNotNull() & col(language).isNotNull()).select(col(text).cast("string").alias("text"), col(language).cast("string").alias("lang"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would not be small enough to broadcast")
    languages = [r["lang"] for r in found]
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    sums = stored(rows.mapInArrow(_count(languages), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")), "language-counts").toPandas()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    counts = counts.reshape(len(languages), BUCKETS) + SMOOTHING
    share = np.array([r["n"] for r in found], float)
    return LanguageModel(languages, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T), np.log(share / share.sum()))


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """struct<lang string, score double> of a text column."""
    languages, sent = model.languages, df.sparkSession.sparkContext.broadcast((model.weights, model.prior))

    def task():
        weights, prior = sent.value

        def apply(batch: pa.Array) -> pa.Array:
            texts = batch.to_pylist()
            lettered = [i for i, t in enumerate(texts) if t and languages and (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)))]
            total = np.tile(prior, (len(lettered), 1))
            for bucket, row in grams([texts[i] for i in lettered]):
                if len(row):
                    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    total[row[starts]] += np.add.reduceat(weights[bucket], starts, axis=0)
            names: list[str] = [UNKNOWN] * len(texts)
            scores = np.zeros(len(texts))
            if lettered:
                best = total.argmax(axis=1)
                scores[lettered] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b in zip(lettered, best):
                    names[i] = languages[b]
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

        return apply

    return per_text(task, "struct<lang string, score double>")(col(text).cast("string"))


def identify(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from the rows where ``held_out`` is false."""
    out = F.coalesce(held_out, F.lit(False))
    model = fit(df.where(~out), text, language)
    scored = df.select(col(key).alias("doc_id"), out.alias("held_out"), predict(df, model, text).alias("p"))
    return scored.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))

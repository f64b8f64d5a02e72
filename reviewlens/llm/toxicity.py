"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed features: words, pairs of neighbours, and pairs with one word between them (words are
lower-cased and stripped of punctuation at their ends). FTRL-proximal keeps two numbers per coordinate, from which its
learning rate and its weight follow; the L1 term leaves weights at exactly zero until the evidence against it is strong,
so the model that is broadcast holds the few features that matter.

Learning is data-parallel: labelled rows (at most ``MOST_LABELLED``, those of the least key hash, a documented bound) are
dealt to ``SHARDS`` shards; each round every shard learns from its own rows on top of the common state, and the
change of a coordinate is the mean of the changes in the shards that met it: a shard without rows, or without the
coordinate, does not pull it back. (Summing the changes instead overshoots: held-out recall on check_s fell to 0.07.) A state has ``1 << BITS`` coordinates whatever the corpus. Scoring covers all rows and whole texts.

Null and empty texts have the score of the intercept alone, as any text without a weighted feature. With no labelled rows
every score is 0. Rows without a key are scored and never learned from. Repeated rows count each. Other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, per_text, stored

BITS = 18
SHARDS, ROUNDS = 8, 4
MOST_LABELLED = 24_000
#: FTRL parameters: learning rate, its damping, and the two penalties; how many times a toxic row counts.
ALPHA, BETA, L1, L2, POSITIVE = 4.0, 1.0, 2.0, 1.0, 2.0
REMEMBERED = 100_000
#: Words whose features are held at a time.
WINDOW = 1 << 16
_TRIM = string.punctuation
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, remembered for up to REMEMBERED words of a task."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.lower().strip(_TRIM).encode("utf-8", "surrogatepass"))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


_WORD = re.compile(r"\S+")


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _windows(text: str, known: WordHashes) -> Iterator[np.ndarray]:
    """Hashes of a text's words; windows of a long text overlap by two words."""
    if len(text) <= 8 * WINDOW:
        words = text.split()
        if words:
            yield np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return
    held: list[int] = []
    for word in _WORD.finditer(text):
        held.append(known[word.group()])
        if len(held) >= WINDOW:
            yield np.array(held, np.uint64)
            held = held[-2:]
    if held:
        yield np.array(held, np.uint64)


def buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of the words, neighbour pairs and pairs across one word of one window."""
    pair, skip = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    return np.concatenate([_bucket(words), _bucket(words[:-1] * pair + words[1:]), _bucket(words[:-2] * skip + words[2:])])


def features(text: str | None, known: WordHashes | None = None) -> np.ndarray:
    """The set of a text's buckets, sorted."""
    found = [np.unique(buckets(w)) for w in _windows(text or "", WordHashes() if known is None else known)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)


@dataclass
class State:
    """FTRL state; the last coordinate is the intercept, which is not penalised."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> State:
        return cls(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.arange(len(self.z))[at] == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, found: np.ndarray, label: int) -> None:
        at = np.append(found, len(self.z) - 1)
        w = self.weights(at)
        g = (sigmoid(w.sum()) - label) * (POSITIVE if label else 1.0)
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def _shard(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, State] = {}
        for batch in batches:
            for shard, label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if shard not in shards:
                    shards[shard] = State(*(x.copy() for x in sent.value))
                shards[shard].learn(np.frombuffer(found, "<i4"), label)
        for state in shards.values():
            z, n = state.z - sent.value[0], state.n - sent.value[1]
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(z[at]), pa.array(n[at])], ["at", "z", "n"])

    return run


def fit(rows: DataFrame) -> ToxicityModel | None:
    """Model of ``rows`` (h: hash of the key, y: 0 or 1, t: text), a bounded number of them."""
    spark = rows.sparkSession
    def task():
        known = WordHashes()
        return lambda batch: pa.array([features(t, known).astype("<i4").tobytes() for t in batch.to_pylist()], pa.binary())

    found = per_text(task, "binary")
    coded = stored(rows.select(F.pmod("h", F.lit(SHARDS)).cast("int").alias("shard"), "h", "y", found("t").alias("f")), "toxicity-rows")
    if not coded.head(1):
        return None
    rows_ = coded.repartition(SHARDS, "shard").sortWithinPartitions("shard", "h").select("shard", "y", "f")
    state = State.empty()
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((state.z, state.n))
        learned = rows_.mapInArrow(_shard(sent), "at bigint, z double, n double")
        added = learned.groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
        at = added.column("at").to_numpy()
        state.z[at] += added.column("z").to_numpy()
        state.n[at] += added.column("n").to_numpy()
        sent.destroy()
    w = state.weights(np.arange(len(state.z)))
    kept = np.flatnonzero(w[:-1])
    return ToxicityModel(kept, w[kept], float(w[-1]))


def score(df: DataFrame, model: ToxicityModel | None, text: str = "text") -> Column:
    """Probability that a text is toxic, as a column."""
    if model is None:
        return F.lit(0.0)
    sent = df.sparkSession.sparkContext.broadcast((model.buckets.astype(np.int64), model.weights, model.intercept))

    def task():
        at, w, intercept = sent.value
        table, known = np.zeros(1 << BITS), WordHashes()
        table[at] = w

        def one(text: str | None) -> float:
            found = []
            for words in _windows(text or "", known):
                b = buckets(words)
                found.append(b[table[b] != 0])
            return float(sigmoid(intercept + table[np.unique(np.concatenate(found))].sum())) if found else float(sigmoid(intercept))

        return lambda batch: pa.array([one(t) for t in batch.to_pylist()], pa.float64())

    return per_text(task, "double")(col(text).cast("string"))


def learn(df: DataFrame, labels: DataFrame, held_out: Column, column: str = "toxic", key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> ToxicityModel | None:
    """Model of the rows of ``df`` with a label of 0 or 1 (of several labels of one key the greatest counts) where
    ``held_out`` is false. Of more than ``most`` labels, those of the least key hash are taken: so few rows are
    broadcast, and the texts stay where they are."""
    wanted = labels.select(col(key).cast("bigint").alias("of"), col(column).cast("int").alias("y")).where("of is not null and y in (0, 1)").groupBy("of").agg(F.max("y").alias("y"))
    wanted = wanted.withColumn("h", F.xxhash64("of", F.lit("learn")))
    n = wanted.count()
    if n > most:
        wanted = wanted.where(F.pmod("h", F.lit(1 << 32)) < (1 << 32) * most // n)
    docs = df.where(~F.coalesce(held_out, F.lit(False))).select(col(key).cast("bigint").alias("doc_id"), col(text).cast("string").alias("t"))
    return fit(docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("of")).select("h", "y", "t"))


def classify(df: DataFrame, labels: DataFrame, held_out: Column, column: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = learn(df, labels, held_out, column, key, text)
    scored = df.select(col(key).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), score(df, model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def not_toxic(df: DataFrame, labels: DataFrame, held_out: Column, column: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the rows that score 0.5 or more."""
    return df.where(score(df, learn(df, labels, held_out, column, key, text), text) < 0.5)

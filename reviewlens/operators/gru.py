"""Embedding -> GRU -> sigmoid sequence classifier.

Cell (Cho et al., 2014):
    z = sig(x Wz + h Uz + bz)          update gate
    r = sig(x Wr + h Ur + br)          reset gate
    c = tanh(x Wh + (r * h) Uh + bh)   candidate
    h' = z * h + (1 - z) * c
Padding (id 0) is masked: the state is carried unchanged over padded steps, so
the output reads the state after the last real word.

The embedding is a table (id, e) with a row for every word that training met; it
has no bound and is never held whole by the driver or a task. A word without a
row has its starting vector, which follows from the seed and the id alone.

Rows of both training and scoring are dealt to *shards*, whose number grows with
the rows. A task reads first the vectors of its words, then its sequences, so its
memory depends on its rows and not on the vocabulary. A training task has several
shards, one after the other: a word's vector is sent to it once for all of them.

Training is data parallel by model averaging (Zinkevich et al., 2010; McMahan et
al., 2017): in every epoch each shard starts from the common weights and runs
mini-batch Adam over its own rows. A word's Adam slots (both moments and its own
step count) start when a batch first holds it and move only in batches that hold
it. The shards' vectors are summed by word id, weighted by the rows of the shards
that met the word: first in the task, then by buckets of ids, in messages of whole
arrays. The gates' weights travel as rows of negative ids in a bucket of their own.
Only the gates' weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import grouped
from .lineage import release, write_table

PARAM_NAMES = ["E", "Wz", "Wr", "Wh", "Uz", "Ur", "Uh", "bz", "br", "bh", "wo", "bo"]
CORE_NAMES = PARAM_NAMES[1:]
# Rows of a shard: fewer mean more shards and more copies of frequent words' vectors.
ROWS_PER_SHARD = 1024
# Rows that mini-batches are drawn from at once.
SHUFFLE_ROWS = 4096
# Shards of a training task at most, unless there are cores for less, and bytes of vectors in a bucket of ids.
SHARDS_PER_TASK = 128
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 4096
# Largest embedding that scoring broadcasts; beyond it every shard gets its own words' vectors.
BROADCAST_BYTES = 64 << 20


@dataclass
class GRUModel:
    """``core``: the gates' and output weights; ``rows`` (id, e): the embedding."""
    core: dict
    rows: DataFrame
    maxlen: int
    threshold: float = 0.5
    seed: int = 42
    num_words: int | None = None
    _sent: dict = field(default_factory=dict, repr=False)

    @property
    def embed(self) -> int:
        return self.core["Wz"].shape[0]

    @property
    def params(self) -> dict:
        """All weights in the driver's memory, for small models: tests and inspection."""
        e = init_rows(np.arange(self.num_words), self.embed, self.seed)
        for r in self.rows.toLocalIterator():
            e[r["id"]] = r["e"]
        return {"E": e, **self.core}

    def small_rows(self):
        """The embedding as a broadcast (sorted ids, vectors) if it is within ``BROADCAST_BYTES``, else None.
        Sent once per session and model, whatever the number of batches it scores."""
        sc = self.rows.sparkSession.sparkContext
        if sc.applicationId not in self._sent:
            n = self.rows.count()
            if n * (self.embed + 1) * 8 > BROADCAST_BYTES:
                self._sent[sc.applicationId] = None
            else:
                held = self.rows.orderBy("id").toArrow()
                e = held.column("e").combine_chunks().flatten().to_numpy().reshape(n, self.embed)
                self._sent[sc.applicationId] = sc.broadcast((held.column("id").to_numpy(), e))
        return self._sent[sc.applicationId]


def init_rows(ids: np.ndarray, embed: int, seed: int = 42) -> np.ndarray:
    """Starting vectors of words, uniform in [-0.05, 0.05): a counter-based draw (splitmix64) from seed, id and
    dimension, so any task can make any row."""
    with np.errstate(over="ignore"):
        at = np.asarray(ids).astype(np.uint64)[:, None] * np.uint64(embed) + np.arange(embed, dtype=np.uint64)
        x = (at + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53) * 0.1 - 0.05


def init_core(embed: int = 32, hidden: int = 32, seed: int = 42) -> dict:
    rng = np.random.default_rng(seed)

    def glorot(a, b):
        lim = np.sqrt(6.0 / (a + b))
        return rng.uniform(-lim, lim, (a, b))

    def orth(n):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        return q

    p = {}
    for g in "zrh":
        p["W" + g] = glorot(embed, hidden)
        p["U" + g] = orth(hidden)
        p["b" + g] = np.zeros(hidden)
    p["wo"] = glorot(hidden, 1)[:, 0]
    p["bo"] = np.zeros(1)
    return {k: p[k] for k in CORE_NAMES}


def init_params(num_words: int, embed: int = 32, hidden: int = 32, seed: int = 42) -> dict:
    return {"E": init_rows(np.arange(num_words), embed, seed), **init_core(embed, hidden, seed)}


def _sig(a):
    return 1.0 / (1.0 + np.exp(-np.clip(a, -60, 60)))


def _sig_in(a: np.ndarray) -> np.ndarray:
    """``_sig`` in place. Beyond 60 it is 1 in double precision anyway."""
    np.maximum(a, -60.0, out=a)
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1.0
    return np.reciprocal(a, out=a)


# Rows of a block that goes through the steps at once: its arrays stay in a core's cache.
BLOCK_ROWS = 256


class _Steps:
    """The words of a batch step by step. Rows stand by falling length, so step t has the first ``sizes[t]`` of them and
    padding at the end takes no part; ``ids`` holds the words of all steps one after the other."""

    def __init__(self, ids: np.ndarray):
        there = ids != 0
        lengths = np.where(there.any(axis=1), ids.shape[1] - there[:, ::-1].argmax(axis=1), 0)
        self.order = np.argsort(-lengths, kind="stable")
        self.sizes = (lengths[:, None] > np.arange(lengths.max(initial=0))).sum(axis=0)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        ranked = ids[self.order]
        self.ids = np.concatenate([ranked[:n, t] for t, n in enumerate(self.sizes)] or [np.zeros(0, np.int64)])
        # padding between words leaves the state as it is
        self.mask = None if self.ids.all() else (self.ids != 0)[:, None].astype(np.float64)

    def __iter__(self) -> Iterator[tuple[slice, int]]:
        return ((slice(a, a + n), n) for a, n in zip(self.starts.tolist(), self.sizes.tolist()))


def _run(p: dict, steps: _Steps):
    """(last state in the steps' order, words' vectors, z, r, c and the states before each step)."""
    width, n_all = p["Uz"].shape[0], len(steps.ids)
    x = p["E"][steps.ids]
    xz, xr, xc = (x @ p["W" + g] + p["b" + g] for g in "zrh")
    before = np.empty((n_all, width))
    state = np.zeros((len(steps.order), width))
    for at, n in steps:
        h, z, r, c = state[:n], xz[at], xr[at], xc[at]
        before[at] = h
        z += h @ p["Uz"]
        r += h @ p["Ur"]
        _sig_in(z)
        _sig_in(r)
        c += (r * h) @ p["Uh"]
        # tanh(c) = 2 sig(2 c) - 1
        c *= 2.0
        _sig_in(c)
        c *= 2.0
        c -= 1.0
        new = h - c
        new *= z
        new += c
        if steps.mask is not None:
            new = np.where(steps.mask[at] > 0, new, h)
        state[:n] = new
    return state, x, xz, xr, xc, before


def forward(p: dict, ids: np.ndarray) -> np.ndarray:
    """Probabilities for a batch of id sequences (B x T)."""
    prob = np.empty(len(ids))
    by_length = np.argsort((ids != 0).sum(axis=1), kind="stable")
    for at in range(0, len(ids), BLOCK_ROWS):
        mine = by_length[at:at + BLOCK_ROWS]
        steps = _Steps(ids[mine])
        prob[mine[steps.order]] = _sig(_run(p, steps)[0] @ p["wo"] + p["bo"][0])
    return prob


def sparse_grads(p: dict, ids: np.ndarray, y: np.ndarray):
    """Summed binary cross-entropy, its gradient for the core weights (BPTT), the embedding rows that the batch
    holds and their gradient."""
    steps = _Steps(ids)
    h_last, x, z, r, c, before = _run(p, steps)
    y = y[steps.order]
    prob = _sig(h_last @ p["wo"] + p["bo"][0])
    eps = 1e-12
    loss = -float(np.sum(y * np.log(prob + eps) + (1 - y) * np.log(1 - prob + eps)))
    dlogit = prob - y
    dh = dlogit[:, None] * p["wo"][None, :]
    # what the gradient of a step's new state is multiplied by on its way to the gates
    rest = 1.0 - z
    to_z, to_r, to_h = (before - c) * z * rest, before * r * (1.0 - r), rest * (1.0 - c * c)
    if steps.mask is not None:
        to_z, to_h, z = to_z * steps.mask, to_h * steps.mask, np.where(steps.mask > 0, z, 1.0)
    da_z, da_r, da_h = np.empty_like(z), np.empty_like(z), np.empty_like(z)
    uz, ur, uh = (np.ascontiguousarray(p["U" + g].T) for g in "zrh")
    for at, n in reversed(list(steps)):
        d = dh[:n]
        np.multiply(d, to_z[at], out=da_z[at])
        np.multiply(d, to_h[at], out=da_h[at])
        drh = da_h[at] @ uh
        np.multiply(drh, to_r[at], out=da_r[at])
        d *= z[at]
        drh *= r[at]
        d += drh
        d += da_z[at] @ uz
        d += da_r[at] @ ur
    g = {}
    for gate, da, h in (("z", da_z, before), ("r", da_r, before), ("h", da_h, r * before)):
        g["W" + gate], g["U" + gate], g["b" + gate] = x.T @ da, h.T @ da, da.sum(axis=0)
    g["wo"], g["bo"] = h_last.T @ dlogit, np.array([dlogit.sum()])
    dx = da_z @ p["Wz"].T + da_r @ p["Wr"].T + da_h @ p["Wh"].T
    words = np.flatnonzero(steps.ids)  # padding has no gradient
    by = words[np.argsort(steps.ids[words], kind="stable")]
    if not len(by):
        return loss, g, by, np.zeros((0, dx.shape[1]))
    found = steps.ids[by]
    starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    return loss, g, found[starts], np.add.reduceat(dx[by], starts, axis=0)


def loss_and_grads(p: dict, ids: np.ndarray, y: np.ndarray):
    """``sparse_grads`` with the embedding's gradient as a whole matrix."""
    loss, g, rows, de = sparse_grads(p, ids, y)
    g["E"] = np.zeros_like(p["E"])
    g["E"][rows] = de
    return loss, g


class LazyAdam:
    """Adam whose slots of an embedding row start with the first batch that holds it and rest in the others."""

    def __init__(self, p: dict, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.steps = np.zeros(len(p["E"]), np.int64)
        self.lr, self.b1, self.b2, self.eps, self.step = lr, b1, b2, eps, 0

    def _moved(self, name: str, at, g: np.ndarray, t):
        m, v = self.m[name], self.v[name]
        m[at] = self.b1 * m[at] + (1 - self.b1) * g
        v[at] = self.b2 * v[at] + (1 - self.b2) * g * g
        return self.lr * m[at] / (1 - self.b1 ** t) / (np.sqrt(v[at] / (1 - self.b2 ** t)) + self.eps)

    def update(self, p: dict, g: dict, rows: np.ndarray, de: np.ndarray, n: int) -> None:
        self.step += 1
        for k in CORE_NAMES:
            p[k] = p[k] - self._moved(k, slice(None), g[k] / n, self.step)
        self.steps[rows] += 1
        p["E"][rows] -= self._moved("E", rows, de / n, self.steps[rows][:, None].astype(np.float64))


def train_rows(p: dict, opt: LazyAdam, ids: np.ndarray, y: np.ndarray, rng, batch: int) -> float:
    """Mini-batches of the given rows in a drawn order; ``p`` moves in place. Returns the summed loss."""
    order, total = rng.permutation(len(y)), 0.0
    for s in range(0, len(order), batch):
        sel = order[s:s + batch]
        loss, g, rows, de = sparse_grads(p, ids[sel], y[sel])
        opt.update(p, g, rows, de, len(sel))
        total += loss
    return total


def _flat(core: dict, embed: int) -> np.ndarray:
    """The core weights as rows of the embedding's width, zeros at the end."""
    flat = np.concatenate([core[k].ravel() for k in CORE_NAMES])
    return np.concatenate([flat, np.zeros(-len(flat) % embed)]).reshape(-1, embed)


def _unflat(rows: np.ndarray, like: dict) -> dict:
    flat, out, at = rows.ravel(), {}, 0
    for k in CORE_NAMES:
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


# Columns of what a task reads: a shard's embedding rows (kind 0) and then its sequences (kind 1).
SHARD, KIND, ORDER, ROW, IDS = "_gru_shard", "_gru_kind", "_gru_order", "_gru_row", "_gru_ids"
# Where several shards share a task: its number, and words and their vectors in one message.
TASK, WORDS, VECTORS = "_gru_task", "_gru_words", "_gru_vectors"


def shard_words(seqs: DataFrame) -> DataFrame:
    """(shard, word id) of the distinct words of each shard's sequences."""
    return seqs.select(SHARD, F.explode(F.array_distinct(F.col(IDS).cast("array<bigint>"))).alias(ORDER)).where(f"{ORDER} <> 0").distinct()


def shard_feed(seqs: DataFrame, words: DataFrame | None, rows: DataFrame | None, shards: int, tasks: int | None = None) -> DataFrame:
    """The vectors of each shard's words, then its sequences, one shard a partition. Words are joined by id; a
    frequent word has at most a row for each shard. With ``tasks`` shards share partitions: ``words`` are the messages
    to them (task, words, vectors), and a task's shards follow each other."""
    if tasks is not None:
        feed = seqs.withColumns({TASK: F.pmod(F.col(SHARD), F.lit(tasks)), KIND: F.lit(1)})
        if words is not None:
            feed = feed.unionByName(words.withColumn(KIND, F.lit(0)), allowMissingColumns=True)
        return feed.repartitionById(tasks, F.col(TASK)).sortWithinPartitions(TASK, KIND, SHARD, ORDER)
    if rows is None:
        held = words.withColumn(ROW, F.lit(None).cast("array<double>"))
    else:
        held = words.join(rows.select(F.col("id").alias(ORDER), F.col("e").alias(ROW)), ORDER, "left")
    feed = held.withColumn(KIND, F.lit(0)).unionByName(seqs.withColumn(KIND, F.lit(1)), allowMissingColumns=True)
    return feed.repartitionById(shards, F.col(SHARD)).sortWithinPartitions(SHARD, KIND, ORDER)


def _parts(batches: Iterator[pa.RecordBatch], by: str = SHARD) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows) of the feed, cut where either changes."""
    for batch in batches:
        shard, kind = batch.column(by).to_numpy(zero_copy_only=False), batch.column(KIND).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])]) if len(shard) else []
        for a, b in zip(cuts, [*cuts[1:], len(shard)]):
            yield int(shard[a]), int(kind[a]), batch.slice(a, b - a)


def _vectors(part: pa.RecordBatch, embed: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    ids, given = part.column(ORDER).to_numpy(), part.column(ROW)
    e = init_rows(ids, embed, seed)
    known = given.is_valid().to_numpy(zero_copy_only=False)
    e[known] = given.flatten().to_numpy().reshape(-1, embed)
    return ids, e


def _sequences(column: pa.Array, maxlen: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, maxlen).astype(np.int64)


class _Held:
    """The words of the open shard in ascending order after padding, and their vectors."""

    def __init__(self, embed: int):
        self.ids, self.rows = [np.zeros(1, np.int64)], [np.zeros((1, embed))]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids.append(ids)
        self.rows.append(rows)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.ids), np.concatenate(self.rows)


class _Sums:
    """Vectors of a task's shards times their rows, added up by word, and the rows of the shards that met it."""

    def __init__(self, embed: int):
        self.kept = [(np.zeros(0, np.int64), np.zeros((0, embed)), np.zeros(0, np.int64))]
        self.added = 0

    def add(self, ids: np.ndarray, rows: np.ndarray, n: int) -> None:
        self.kept.append((ids, rows * n, np.full(len(ids), n)))
        self.added += len(ids)
        if self.added > max(len(self.kept[0][0]), 1 << 16):
            self.kept, self.added = [self.close()], 0

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return grouped(*(np.concatenate(x) for x in zip(*self.kept)))


_LEARNED = "bucket int, task int, ids binary, e binary, n binary, loss double"
_AFTER = "bucket int, ids binary, e binary, n bigint, loss double, tasks array<int>, ends array<int>, at binary"


def _trainer(core: dict, embed: int, maxlen: int, batch: int, lr: float, seed: int, epoch: int, buckets: int):
    def message(bucket: int, task: int, ids: np.ndarray, e: np.ndarray, n: np.ndarray, loss: float) -> pa.RecordBatch:
        blobs = (pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int64), e.astype(np.float64), n.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([task], pa.int32()), *blobs, pa.array([loss])],
                                          ["bucket", "task", "ids", "e", "n", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = shard = held = known = None
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        sums, flat, seen, loss = _Sums(embed), 0.0, 0, 0.0

        def learn() -> None:
            """The open shard's rows."""
            nonlocal rows, flat, seen, loss
            ids, y = (np.concatenate(x) for x in zip(*rows))
            rows = []
            words = np.union1d(ids, [0]).astype(np.int64)
            e = init_rows(words, embed, seed)
            e[0] = 0.0
            there = np.minimum(np.searchsorted(known[0], words), len(known[0]) - 1)
            met = (known[0][there] == words) & (words != 0)
            e[met] = known[1][there[met]]
            p = {"E": e, **{k: v.copy() for k, v in core.items()}}
            opt, rng = LazyAdam(p, lr), np.random.default_rng([seed, epoch, shard])
            for a in range(0, len(y), SHUFFLE_ROWS):
                loss += train_rows(p, opt, np.searchsorted(words, ids[a:a + SHUFFLE_ROWS]), y[a:a + SHUFFLE_ROWS], rng, batch)
            moved = np.flatnonzero(opt.steps)
            sums.add(words[moved], p["E"][moved], len(y))
            flat = flat + _flat(p, embed) * len(y)
            seen += len(y)

        def close() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            learn()
            yield message(-1, task, -1 - np.arange(len(flat)), flat, np.full(len(flat), seen), loss)
            ids, e, n = sums.close()
            order = np.argsort(ids % buckets, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(ids[order] % buckets)) + 1):
                if len(mine):
                    yield message(int(ids[mine[0]] % buckets), task, ids[mine], e[mine], n[mine], 0.0)

        for at, kind, part in _parts(batches, TASK):
            if at != task:
                yield from close()
                task, shard, held, known, sums, flat, seen, loss = at, None, _Held(embed), None, _Sums(embed), 0.0, 0, 0.0
            if kind == 0:
                for ids, e in zip(part.column(WORDS), part.column(VECTORS)):
                    held.add(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(e.as_buffer()).reshape(-1, embed))
                continue
            if known is None:
                ids, e = held.close()
                order = np.argsort(ids, kind="stable")
                known, held = (ids[order], e[order]), None
            for of, _, part in _parts([part]):
                if of != shard:
                    if rows:
                        learn()
                    shard = of
                rows.append((_sequences(part.column(IDS), maxlen).astype(np.int32), part.column("y").to_numpy()))
        yield from close()

    return run


def _averaged(embed: int):
    """One bucket's vectors from the tasks' messages: the sums over the rows, and which task met which of them."""

    def run(got: pa.Table) -> pa.Table:
        got = got.sort_by("task")
        parts = [np.frombuffer(x.as_buffer(), np.int64) for x in got.column("ids")]
        ids = np.concatenate(parts)
        e = np.concatenate([np.frombuffer(x.as_buffer()).reshape(-1, embed) for x in got.column("e")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in got.column("n")])
        words, e, n = grouped(ids, e, n)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (words, e / n[:, None], np.searchsorted(words, ids).astype(np.int32))]
        ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
        return pa.Table.from_arrays([
            pa.array([got.column("bucket")[0].as_py()], pa.int32()), *blobs[:2], pa.array([int(n[0])]), pa.array([float(sum(got.column("loss").to_pylist()))]),
            pa.array([got.column("task").to_pylist()], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int32())), blobs[2]],
            ["bucket", "ids", "e", "n", "loss", "tasks", "ends", "at"])

    return run


def _messages(after: DataFrame, embed: int) -> DataFrame:
    """To each task the vectors of the words that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, at = (np.frombuffer(batch.column(c)[r].as_buffer(), kind) for c, kind in (("ids", np.int64), ("at", np.int32)))
                e = np.frombuffer(batch.column("e")[r].as_buffer()).reshape(-1, embed)
                tasks, ends = (batch.column(c)[r].as_py() for c in ("tasks", "ends"))
                for task, a, b in zip(tasks, ends, ends[1:]):
                    mine = at[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *(pa.array([x[mine].tobytes()], pa.binary()) for x in (ids, e))],
                                                     [TASK, WORDS, VECTORS])

    return after.where("bucket >= 0").mapInArrow(run, f"{TASK} int, {WORDS} binary, {VECTORS} binary")


def _embedding(after: DataFrame, embed: int) -> DataFrame:
    """(id, e) of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, e in zip(batch.column("ids"), batch.column("e")):
                ids, e = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(e.as_buffer())
                for a in range(0, len(ids), 1 << 13):
                    some = ids[a:a + (1 << 13)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * embed, pa.int32()), pa.array(e[a * embed:(a + len(some)) * embed]))
                    yield pa.RecordBatch.from_arrays([pa.array(some), lists], ["id", "e"])

    return after.where("bucket >= 0").select("ids", "e").mapInArrow(run, "id bigint, e array<double>")


def fit_gru(train: DataFrame, num_words: int, maxlen: int, label: str = "score",
            ids: str = "ids", epochs: int = 6, embed: int = 32, hidden: int = 32,
            batch: int = 64, lr: float = 0.01, seed: int = 42, partitions: int | None = None,
            patience: int | None = 1, log=None) -> GRUModel:
    """Data-parallel training; stops early when the mean training loss has not
    improved for ``patience`` epochs and keeps the best epoch's weights.

    ``partitions``, the number of shards whose models are averaged, is part of
    the model: rows go to shards by key, so the fit does not depend on how many
    cores or input partitions there are. By default it grows with the rows, one
    for each ``ROWS_PER_SHARD``. Without a labelled row the starting weights stay."""
    spark = train.sparkSession
    data = train.where(F.col(label).isNotNull()).select(
        F.col(ids).alias(IDS), F.col(label).cast("double").alias("y"), F.xxhash64("doc_id").alias(ORDER))
    shards = partitions or max(1, -(-data.count() // ROWS_PER_SHARD))
    tasks = min(shards, max(2 * spark.sparkContext.defaultParallelism, -(-shards // SHARDS_PER_TASK)))
    buckets = min(max(1, -(-8 * embed * num_words // BUCKET_BYTES)), MOST_BUCKETS) if shards > 1 else 1
    # stored once: every epoch (and every retried task) reads the same rows
    data = write_table(data.withColumn(SHARD, F.pmod(ORDER, F.lit(shards)).cast("int")), "gru-sequences")
    core = init_core(embed, hidden, seed)
    after: DataFrame | None = None  # the vectors that the last epoch left, by bucket
    best, best_loss, stale = (core, after), float("inf"), 0
    for epoch in range(epochs):
        run = _trainer(core, embed, maxlen, batch, lr, seed, epoch, buckets)
        sent = None if after is None else _messages(after, embed)
        learned = shard_feed(data, sent, None, shards, tasks).mapInArrow(run, _LEARNED)
        found = write_table(learned.groupBy("bucket").applyInArrow(_averaged(embed), _AFTER), "gru-rows")
        release(spark)
        gates = found.where("bucket = -1").select("ids", "e", "n", "loss").first()
        if gates is None:
            break
        # the loss was measured while training from the weights before this epoch
        loss = gates["loss"] / gates["n"]
        if log:
            log(f"epoch {epoch}: mean loss {loss:.4f}")
        if loss < best_loss:
            best_loss, best, stale = loss, (core, after), 0
        else:
            stale += 1
            if patience is not None and stale >= patience:
                break
        # every epoch meets every word, so its table replaces the one before; the ids of the gates' rows fall
        core, after = _unflat(np.frombuffer(gates["e"]).reshape(-1, embed)[::-1], core), found
    else:
        best = (core, after)
    core, after = best
    rows = spark.createDataFrame([], "id bigint, e array<double>") if after is None else _embedding(after, embed)
    return GRUModel(core, rows, maxlen, seed=seed, num_words=num_words)


def predict_proba(df: DataFrame, model: GRUModel, ids: str = "ids", key: str = "doc_id",
                  keep: list[str] | tuple = ()) -> DataFrame:
    """``(key, *keep, prob_gru)`` per document. An embedding within ``BROADCAST_BYTES`` is broadcast; with a larger
    one the rows are dealt to shards that get their own words' vectors. Both give the same probabilities."""
    columns = [key, *keep]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("prob_gru", T.DoubleType())])
    core, embed, maxlen, seed = model.core, model.embed, model.maxlen, model.seed
    sent = model.small_rows()
    rows = df.select(*columns, F.col(ids).alias(IDS))

    def scored(part: pa.RecordBatch, words: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        x = _sequences(part.column(IDS), maxlen)
        prob = forward({"E": e, **core}, np.searchsorted(words, x)) if len(x) else np.zeros(0)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(prob, pa.float64())], schema.names)

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vectors = sent.value
        for batch in batches:
            words = np.union1d(_sequences(batch.column(IDS), maxlen), [0]).astype(np.int64)
            e = init_rows(words, embed, seed)
            e[0] = 0.0
            at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
            met = known[at] == words if len(known) else np.zeros(len(words), bool)
            e[met] = vectors[at[met]]
            yield scored(batch, words, e)

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = closed = None
        for at, kind, part in _parts(batches):
            if at != shard:
                shard, held, closed = at, _Held(embed), None
            if kind == 0:
                held.add(*_vectors(part, embed, seed))
                continue
            closed = closed or held.close()
            yield scored(part, *closed)

    if sent is not None:
        return rows.mapInArrow(by_batch, schema)
    # the order of a shard's rows does not matter, only that they follow its words; few large shards get few copies of a vector
    shards = max(1, -(-rows.count() // ROWS_PER_SHARD))
    shards = min(shards, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-shards // SHARDS_PER_TASK)))
    rows = rows.withColumn(ORDER, F.xxhash64(key)).withColumn(SHARD, F.pmod(ORDER, F.lit(shards)).cast("int"))
    return shard_feed(rows, shard_words(rows), model.rows, shards).mapInArrow(by_shard, schema)


def score_gru(df: DataFrame, model: GRUModel, ids: str = "ids", key: str = "doc_id",
              keep: list[str] | tuple = ()) -> DataFrame:
    """``(key, *keep, pred_gru, prob_gru)``: positive when ``prob >= threshold``."""
    keep = list(keep)
    p = predict_proba(df, model, ids, key, keep)
    return p.select(key, *keep, (F.col("prob_gru") >= F.lit(model.threshold)).cast("int")
                    .alias("pred_gru"), "prob_gru")

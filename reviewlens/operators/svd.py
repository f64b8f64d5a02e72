"""Truncated SVD of the TF-IDF matrix (no centring) and the projection onto it.

Fit: randomized range finder with power iterations (Halko, Martinsson & Tropp,
2011). The matrix is stored once in parts, groups of whole documents that stay
where they are stored. ``X^T X M`` is one pass: a part is sent the rows of M of its
own terms, multiplies, and gives its share of the rows of ``X^T Y``, which are
added up by term in a shuffle. What moves are arrays of many rows by bucket of terms. An
iterate beyond ``BROADCAST_BYTES`` travels in single precision between the passes, which
the next pass refines; the last pass, that the result is made of, in double. Terms with a
single entry, most of a vocabulary, never travel: those of a document stand in its part,
together one column of the norm of their entries, which leaves ``X X^T`` as it is. A task
holds the entries of its part and the rows of its terms. The iterate is orthonormalised
through its l x l Gram matrix; only l x l matrices and l-sized rows reach the driver. The
number of parts follows that of the entries, and a part's terms grow slower than its texts.

Projection: each document's sparse row times the V x k basis; a basis of at most
``BROADCAST_BYTES`` is broadcast, of a larger one each part gets the rows of its terms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import grouped
from .lineage import checkpoint_partitioned, lookup, release, write_table
from .ranking import global_rank
from .tfidf import TfidfModel

# Bytes of the dense block that a task holds of each side of a product.
BLOCK_BYTES = 32 << 20
# Bytes of the pieces in which a block travels and is summed.
PIECE_BYTES = 1 << 20
# Blocks of terms at least, by those of documents: they fix the random start.
LEAST_TILES = 16
# Parts of the documents at least, entries (12 bytes each) of one about, and bytes of a dense V x l matrix for each part.
LEAST_PARTS = 12
PART_ENTRIES = 32 << 20
PART_BYTES = 128 << 20
# Largest basis that is broadcast for a projection, and largest iterate that always travels in double precision.
BROADCAST_BYTES = 64 << 20
# Bytes of the rows of a bucket of terms about, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 4096
# Bytes of a product's temporary, which stays in a core's cache.
CACHE_BYTES = 1 << 20
DOUBLE, SINGLE = "<f8", "<f4"

DENSE = "block int, piece int, z binary"
_DENSE = pa.schema([("block", pa.int32()), ("piece", pa.int32()), ("z", pa.binary())])
# Least eigenvalue over the greatest of an iterate's Gram matrix below which its orthonormal basis is stored anew.
LEAST_EIGENVALUE = 1e-10
# Column of the part of the documents that a row belongs to.
PART = "_part"


@dataclass(frozen=True)
class Side:
    """``n`` rows dealt to blocks in turn: row q is row ``q // blocks`` of block ``q % blocks``."""
    n: int
    width: int
    blocks: int

    @classmethod
    def of(cls, n: int, width: int, least: int = 1) -> Side:
        return cls(n, width, max(least, math.ceil(8 * width * n / BLOCK_BYTES)))

    @property
    def step(self) -> int:
        """Rows of a piece."""
        return max(PIECE_BYTES // (8 * max(self.width, 1)), 1)

    def size(self, block: int) -> int:
        return max(self.n - block + self.blocks - 1, 0) // self.blocks

    def cut(self, block: int, z: np.ndarray) -> pa.RecordBatch:
        """The pieces of a block that are not all zero."""
        at = [p for p in range(0, len(z), self.step) if z[p:p + self.step].any()]
        return pa.RecordBatch.from_arrays([
            pa.array([block] * len(at), pa.int32()), pa.array([p // self.step for p in at], pa.int32()),
            pa.array([z[p:p + self.step].tobytes() for p in at], pa.binary())], schema=_DENSE)


@dataclass
class SVDModel:
    index: DataFrame          # term, idx
    basis: DataFrame          # block, piece, z: the V x k basis in blocks, see Side
    singular_values: np.ndarray
    n_terms: int
    blocks: int

    @property
    def side(self) -> Side:
        return Side(self.n_terms, len(self.singular_values), self.blocks)

    @property
    def components(self) -> np.ndarray:
        """k x V on the driver: for small bases and for tests."""
        return collected(self.basis, self.side).T


def index_terms(vocab: DataFrame, n_terms: int) -> DataFrame:
    """Dense 0-based index of the vocabulary in term order (exact distributed rank), with ``df`` where it is known."""
    df = [c for c in vocab.columns if c == "df"]
    ranked = global_rank(vocab.select("term", *df), [F.asc("term")], name="idx")
    return ranked.select("term", F.col("idx").cast("int").alias("idx"), *df)


def sparse_rows(x: DataFrame, index: DataFrame, n_terms: int, key: str = "doc_id",
                keep: list[str] | tuple = ()) -> DataFrame:
    """``(key, *keep, idx array<int>, val array<double>)``, one row per
    document, from ``(key, *keep, term, x)`` rows (bounded by document length).
    A document whose terms are all outside the index keeps empty arrays."""
    keep = list(keep)
    j = lookup(x, index, "term", n_terms, F.col("df") if "df" in index.columns else -F.col("idx"))
    pair = F.when(F.col("idx").isNotNull() & F.col("x").isNotNull(), F.struct("idx", "x"))
    pairs = F.array_sort(F.collect_list(pair))
    return (j.groupBy(key, *keep).agg(pairs.alias("p"))
            .select(key, *keep, F.col("p.idx").alias("idx"), F.col("p.x").alias("val")))


# Bytes of a dense nnz x l temporary inside a task, whatever the documents' lengths and l.
MAX_CHUNK_BYTES = 64 << 20


def _most_nnz(width: int) -> int:
    """Non-zeros handled at once with matrices of ``width`` columns."""
    return max(MAX_CHUNK_BYTES // (8 * width), 1)


def _chunks(pdf: pd.DataFrame, max_nnz: int):
    """Consecutive row slices of an Arrow batch with at most ``max_nnz``
    non-zeros each (a single longer document forms its own slice)."""
    lens = np.fromiter((len(a) for a in pdf["idx"]), dtype=np.int64, count=len(pdf))
    start, acc = 0, 0
    for i, n in enumerate(lens):
        if acc and acc + n > max_nnz:
            yield pdf.iloc[start:i]
            start, acc = i, 0
        acc += n
    if start < len(pdf):
        yield pdf.iloc[start:]


def _flatten(pdf: pd.DataFrame):
    lens = np.fromiter((len(a) for a in pdf["idx"]), dtype=np.int64, count=len(pdf))
    ptr = np.concatenate([[0], np.cumsum(lens)])
    if ptr[-1]:
        idx = np.concatenate(pdf["idx"].to_numpy()).astype(np.int64, copy=False)
        val = np.concatenate(pdf["val"].to_numpy()).astype(np.float64, copy=False)
    else:
        idx, val = np.zeros(0, np.int64), np.zeros(0, np.float64)
    return idx, val, ptr


def rows_times(idx, val, ptr, m: np.ndarray) -> np.ndarray:
    """Sparse rows (CSR pieces) times a dense matrix."""
    n = len(ptr) - 1
    out = np.zeros((n, m.shape[1]))
    if len(idx):
        nonempty = np.flatnonzero(np.diff(ptr) > 0)
        out[nonempty] = np.add.reduceat(val[:, None] * m[idx], ptr[:-1][nonempty], axis=0)
    return out


def rows_t_times(idx, val, ptr, y: np.ndarray, n_terms: int) -> np.ndarray:
    """Transposed sparse rows times a dense matrix: ``X^T y`` (V x l)."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    contrib = val[:, None] * y[doc]
    return np.stack([np.bincount(idx, weights=contrib[:, j], minlength=n_terms)
                     for j in range(y.shape[1])], axis=1)


def generated(spark: SparkSession, side: Side, rows) -> DataFrame:
    """Dense table whose entries a function gives, (block, its global rows) -> rows x width."""

    def task(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                yield side.cut(b, np.ascontiguousarray(rows(b, b + side.blocks * np.arange(side.size(b))), dtype=np.float64))

    return spark.range(0, side.blocks, 1, side.blocks).mapInArrow(task, DENSE)


def collected(dense: DataFrame, side: Side) -> np.ndarray:
    """A dense table on the driver (small ones only)."""
    out = np.zeros((side.n, side.width))
    for r in dense.collect():
        z = np.frombuffer(r.z).reshape(-1, side.width)
        out[r.block + side.blocks * (r.piece * side.step + np.arange(len(z)))] = z
    return out


def parts_for(entries: int, n_terms: int, width: int) -> int:
    return max(LEAST_PARTS, math.ceil(entries / PART_ENTRIES), math.ceil(8 * n_terms * width / PART_BYTES))


def tile_tasks(rows: DataFrame, tiles: int, n_terms: int = 0, width: int = 0) -> int:
    """Parts for ``rows`` by the entries there are, ``tiles`` at most."""
    entries = rows.agg(F.sum(F.size("idx"))).first()[0] or 0
    return max(1, min(tiles, parts_for(entries, n_terms, width)))


def in_parts(rows: DataFrame, parts: int, key: str | None = None) -> DataFrame:
    """``rows`` stored with the part of each in ``PART``, dealt by ``key`` or in turn."""
    turn = F.monotonically_increasing_id() if key is None else F.xxhash64(key)
    return _stored_parts(rows, parts, F.pmod(turn, F.lit(parts)))


def _stored_parts(rows: DataFrame, parts: int, number: Column) -> DataFrame:
    """``rows`` stored by part, which ``number`` says. The parts stay where they are stored; Spark's hash of a part's
    label gives each a partition of its own."""
    label = F.col("id").cast("int")
    found = (rows.sparkSession.range(64 * parts).groupBy(F.pmod(F.hash(label), F.lit(parts)).alias("at"))
             .agg(F.min(label).alias("label")).orderBy("at").collect())
    labels = F.array(*(F.lit(r["label"]) for r in found))
    dealt = rows.withColumn(PART, F.get(labels, F.pmod(number, F.lit(len(found))).cast("int")))
    return checkpoint_partitioned(dealt.repartition(parts, PART).sortWithinPartitions(PART))


# Columns of what a task reads that makes sparse rows: first its terms, then its documents.
_TASK, _KIND = "_svd_task", "_svd_kind"


def sparse_parts(packed: DataFrame, vocab: TfidfModel, index: DataFrame, parts: int, key: str = "doc_id",
                 keep: list[str] | tuple = (), stored: bool = True) -> DataFrame:
    """``sparse_rows`` of the TF-IDF weights, from ``packed_frequencies``, as ``in_parts`` stores them (or, not ``stored``,
    as they come); without ``keep`` a row for each key. Each part is sent its own distinct terms with their numbers and weights, and looks them up where its
    documents are: what enters the join is a row for each term of a part. All rows of a key are in one part, so they
    have one norm."""
    keep = list(keep)
    number = F.pmod(F.pmod(F.hash(key), F.lit(max(1, packed.rdd.getNumPartitions()))), F.lit(parts))
    docs = packed.select(key, *keep, "_terms", "_tfs", number.alias(_TASK))

    def distinct(batches):
        met: dict[int, list] = {}
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            for task in np.unique(tasks):
                texts = batch.column(1).filter(pa.array(tasks == task))
                met.setdefault(int(task), []).append(pc.unique(pc.split_pattern(texts, " ").flatten()))
        for task, terms in met.items():
            terms = pc.unique(pa.chunked_array(terms))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), task, np.int32)), terms], [_TASK, "term"])

    met = docs.select(_TASK, "_terms").mapInArrow(distinct, f"{_TASK} int, term string").repartition("term").distinct()
    table = index.select("term", "idx").join(vocab.table.select("term", "idf"), "term")
    feed = met.join(table, "term").withColumn(_KIND, F.lit(0)).unionByName(docs.withColumn(_KIND, F.lit(1)), allowMissingColumns=True)
    feed = feed.repartitionById(parts, F.col(_TASK)).sortWithinPartitions(_KIND, key)
    columns = [key, *keep]
    feed = feed.select(_TASK, _KIND, "term", "idx", "idf", "_terms", "_tfs", *columns)
    schema = T.StructType([*(packed.schema[c] for c in columns), T.StructField("idx", T.ArrayType(T.IntegerType())),
                           T.StructField("val", T.ArrayType(T.DoubleType())), T.StructField(_TASK, T.IntegerType())])

    def weighted(rows: pa.Table, terms: pa.Array, idx: np.ndarray, idf: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n = len(rows)
        words = pc.split_pattern(rows.column("_terms").combine_chunks(), " ")
        row = np.repeat(np.arange(n), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = pc.index_in(words.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(at >= 0)
        row, at = row[known], at[known]
        w = rows.column("_tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)[known] * idf[at]
        of = _runs(rows.column(key))
        norm = np.sqrt(np.bincount(of[row], w * w, n))[of[row]]
        if not keep:  # a row for each key
            row, n = of[row], int(of[-1]) + 1
            rows = rows.take(pa.array(np.flatnonzero(np.r_[True, of[1:] != of[:-1]])))
        place = row.astype(np.int64) * (1 << 32) + idx[at]
        order = np.argsort(place) if keep else np.lexsort((w, place))
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))], pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (idx[at], w / norm))
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in columns), *lists, rows.column(_TASK).combine_chunks()], schema.names)

    def run(batches):
        held, known, last = [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            first = int(np.searchsorted(batch.column(_KIND).to_numpy(), 1))
            if first:
                held.append(table.slice(0, first).select(["term", "idx", "idf"]))
            if first == len(table):
                continue
            if known is None:
                known = _dictionary(held)
            table = table.slice(first)
            table = table if last is None else pa.concat_tables([last, table])
            # the rows of the last key wait for the next batch
            cut = int(np.searchsorted(runs := _runs(table.column(key)), runs[-1]))
            last = table.slice(cut)
            if cut:
                yield weighted(table.slice(0, cut), *known)
        if last is not None:
            yield weighted(last, *known)

    rows = feed.mapInArrow(run, schema)
    return _stored_parts(rows, parts, F.col(_TASK)).drop(_TASK) if stored else rows.drop(_TASK)


def _dictionary(held: list[pa.Table]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, their numbers, their weights)."""
    if not held:
        return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0)
    whole = pa.concat_tables(held).combine_chunks()
    return whole.column("term").combine_chunks(), whole.column("idx").to_numpy(), whole.column("idf").to_numpy()


def _runs(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of the runs of equal values, nulls being equal."""
    codes = pa.chunked_array([column.combine_chunks()]).dictionary_encode(null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[0, codes[1:] != codes[:-1]]) if len(codes) else codes


def _stacked(column: pa.Array, width: int, kind: str = DOUBLE) -> np.ndarray:
    """The rows in a column of binary values, one or more in each."""
    if not len(column):
        return np.zeros((0, width))
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind).reshape(-1, width)


def _binary(z: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    z = np.ascontiguousarray(z, dtype=np.float64)
    return pa.Array.from_buffers(pa.binary(), len(z), [None, pa.py_buffer((np.arange(len(z) + 1) * (8 * z.shape[1])).astype(np.int32)), pa.py_buffer(z)])


class _Part:
    """The documents of a part. ``place``: of each of its ``terms``, the distinct ones ascending. An entry that is the only
    one of its term is ``alone``; ``h`` is the norm of a document's single entries, which together are one column of X."""

    def __init__(self, left: pa.Table, sent: pa.Table, n_terms: int):
        self.chunks = []  # first document, offsets of the documents, terms, values
        self.n = 0
        self.place = np.zeros(n_terms, np.int32)
        for batch in left.select(["idx", "val"]).to_batches():
            idx, val = batch.columns
            ptr = np.r_[0, np.cumsum(idx.value_lengths().to_numpy(zero_copy_only=False))]
            idx = idx.flatten().to_numpy(zero_copy_only=False)
            self.place[idx] = 1
            self.chunks.append((self.n, ptr, idx, val.flatten().to_numpy(zero_copy_only=False)))
            self.n += batch.num_rows
        self.terms = np.flatnonzero(self.place)
        self.place[self.terms] = np.arange(len(self.terms))
        known = sent.column("z").is_null().to_numpy()
        self.alone = np.zeros(n_terms, bool)
        for ids in sent.filter(pa.array(known)).column("idx"):
            self.alone[np.frombuffer(ids.as_buffer(), np.int64)] = True
        self.sent = sent.filter(pa.array(~known))
        self.h = np.zeros(self.n)
        for first, ptr, idx, x in self.chunks:
            single = np.flatnonzero(self.alone[idx])
            doc = first + np.searchsorted(ptr, single, "right") - 1
            self.h += np.bincount(doc, x[single] ** 2, self.n)
        self.h = np.sqrt(self.h)

    def received(self, label: int, n_terms: int, width: int, kind: str = DOUBLE) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the terms, rows of the documents' single entries), zeros where none was sent."""
        m, own = np.zeros((len(self.terms), width)), np.zeros((self.n, width))
        for ids, z in zip(self.sent.column("idx"), self.sent.column("z")):
            ids, z = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(z.as_buffer(), kind).reshape(-1, width)
            shared = ids < n_terms
            m[self.place[ids[shared]]] = z[shared]
            own[ids[~shared] - _own(n_terms, label)] = z[~shared]
        return m, own

    def times(self, m: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """X m; without ``own`` the rows of ``m`` serve single entries, too (else no row was sent for these)."""
        out = np.zeros((self.n, m.shape[1])) if own is None else self.h[:, None] * own
        for first, ptr, idx, x in self.chunks:
            at = self.place[idx]
            for d in np.flatnonzero(np.diff(ptr)):
                a, b = ptr[d], ptr[d + 1]
                out[first + d] += x[a:b] @ m.take(at[a:b], axis=0)
        return out

    def sums(self, y: np.ndarray, label: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        """The part's share of X^T y: (numbers, rows) of the shared terms, and of documents with single entries."""
        out = np.zeros((len(self.terms), y.shape[1]))
        for first, ptr, idx, x in self.chunks:
            for a in range(0, len(idx), 1 << 20):
                to = self.place[idx[a:a + (1 << 20)]]
                doc = first + np.searchsorted(ptr, np.arange(a, a + len(to)), "right") - 1
                _add_products(out, to, doc, x[a:a + (1 << 20)], y)
        used, own = np.flatnonzero(~self.alone[self.terms]), np.flatnonzero(self.h > 0)
        return np.r_[self.terms[used], own + _own(n_terms, label)], np.concatenate([out[used], self.h[own, None] * y[own]])

    def singles(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, row) of the single entries, from the documents' rows ``own``."""
        terms, rows = [np.zeros(0, np.int64)], [np.zeros((0, own.shape[1]))]
        for first, ptr, idx, x in self.chunks:
            mine = np.flatnonzero(self.alone[idx])
            doc = first + np.searchsorted(ptr, mine, "right") - 1
            mine, doc = mine[self.h[doc] > 0], doc[self.h[doc] > 0]
            terms.append(idx[mine])
            rows.append((x[mine] / self.h[doc])[:, None] * own[doc])
        return np.concatenate(terms), np.concatenate(rows)


def _own(n_terms: int, label: int) -> int:
    """The number of the first document's row in a part, beyond those of all terms."""
    return n_terms + (label << 32)


def _add_products(out: np.ndarray, to: np.ndarray, at: np.ndarray, x: np.ndarray, have: np.ndarray) -> None:
    """``out[to] += x * have[at]``, entry by entry."""
    sorted_already = not len(to) or (to[1:] >= to[:-1]).all()
    order = None if sorted_already else np.argsort(to, kind="stable")
    most = max(CACHE_BYTES // (8 * have.shape[1]), 1)
    for k in range(0, len(to), most):
        o = slice(k, k + most) if order is None else order[k:k + most]
        t = to[o]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        out[t[starts]] += np.add.reduceat(x[o][:, None] * have[at[o]], starts, axis=0)


# Rows of terms by bucket, the parts that gave them, and which of the rows each gave (``ends`` cut ``at`` by part).
_ITERATE = "bucket int, idx binary, z binary, parts array<int>, ends array<int>, at binary"
_SHARES = f"bucket int, {PART} int, idx binary, z binary"
_SENT = f"{PART} int, idx binary, z binary"


@dataclass
class Iterate:
    """A dense table of terms by ``width``, ``packed`` as in ``_ITERATE``; ``kind``: the precision of z."""
    packed: DataFrame
    width: int
    kind: str = DOUBLE

    def gram(self, steps: list[np.ndarray] | tuple = ()) -> np.ndarray:
        return gram(self.packed, self.width, steps, kind=self.kind)

    def messages(self) -> DataFrame:
        """To each part the rows of its terms."""
        kind, width = self.kind, self.width

        def task(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    idx, z, at = (np.frombuffer(batch.column(c)[r].as_buffer(), of) for c, of in (("idx", np.int64), ("z", kind), ("at", np.int32)))
                    parts, ends = (batch.column(c)[r].as_py() for c in ("parts", "ends"))
                    for part, a, b in zip(parts, ends, ends[1:]):
                        yield _message([("int32", part)], idx[at[a:b]], z.reshape(-1, width)[at[a:b]], [PART])

        return self.packed.mapInArrow(task, _SENT)

    def rows(self, steps: list[np.ndarray] | tuple = ()) -> DataFrame:
        """(idx, z), a row each, times ``steps``."""
        kind, width = self.kind, self.width

        def task(batches):
            for batch in batches:
                for idx, z in zip(batch.column(0), batch.column(1)):
                    idx, z = np.frombuffer(idx.as_buffer(), np.int64), np.frombuffer(z.as_buffer(), kind).reshape(-1, width)
                    for a in range(0, len(idx), 1 << 13):
                        yield pa.RecordBatch.from_arrays([pa.array(idx[a:a + (1 << 13)]), _binary(_stepped(z[a:a + (1 << 13)], steps))], ["idx", "z"])

        return self.packed.select("idx", "z").mapInArrow(task, "idx long, z binary")

    def applied(self, steps: list[np.ndarray]) -> Iterate:
        """Times ``steps``, stored."""
        kind, width = self.kind, self.width

        def task(batches):
            for batch in batches:
                z = [pa.scalar(_stepped(np.frombuffer(x.as_buffer(), kind).reshape(-1, width), steps).astype(DOUBLE).tobytes()) for x in batch.column("z")]
                yield batch.set_column(2, "z", pa.array([x.as_py() for x in z], pa.binary()))

        stored = write_table(self.packed.select("bucket", "idx", "z", "parts", "ends", "at").mapInArrow(task, _ITERATE), "svd-iterate")
        return Iterate(stored, len(steps[-1].T))


def _message(labels: list[tuple[str, int]], idx: np.ndarray, z: np.ndarray, names: list[str]) -> pa.RecordBatch:
    blobs = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (idx, z)]
    return pa.RecordBatch.from_arrays([*(pa.array([x], kind) for kind, x in labels), *blobs], [*names, "idx", "z"])


def _dealt(idx: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Places of the rows of each bucket that has any."""
    order = np.argsort(idx % buckets, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(idx[order] % buckets)) + 1) if len(x)]


@dataclass
class Matrix:
    """Sparse rows in parts, and (part, idx) of the terms that have a single entry, an array for each part."""
    parts: DataFrame
    singles: DataFrame
    n_terms: int
    n_parts: int

    @classmethod
    def of(cls, rows: DataFrame, n_terms: int, width: int) -> Matrix:
        if PART not in rows.columns:
            rows = in_parts(rows.select("idx", "val"), tile_tasks(rows, rows.count(), n_terms, width))
        rows = rows.select(PART, "idx", "val")
        met = rows.select(PART, F.explode("idx").alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.min(PART).alias(PART))

        def packed(got: pa.Table) -> pa.Table:
            idx = np.sort(got.column("idx").to_numpy()).astype(np.int64)
            return pa.table({PART: got.column(PART)[:1], "idx": pa.array([idx.tobytes()], pa.binary()), "z": pa.array([None], pa.binary())})

        singles = write_table(met.where("n = 1").select(PART, "idx").groupBy(PART).applyInArrow(packed, _SENT), "svd-singles")
        return cls(rows, singles, n_terms, max(1, rows.rdd.getNumPartitions()))

    def _run(self, work, schema: str, sent: DataFrame | None = None) -> DataFrame:
        """``work(part, label)`` of each part, to which its messages go."""
        n_terms = self.n_terms
        sent = self.singles.select(PART, "idx", "z") if sent is None else sent.unionByName(self.singles)

        def task(key, left, right):
            return work(_Part(left, right, n_terms), key[0].as_py())

        # the parts stay where they are stored; the rows of the iterate move
        return self.parts.groupBy(PART).cogroup(sent.groupBy(PART)).applyInArrow(task, schema)

    def buckets(self, width: int) -> int:
        return min(max(self.n_parts, -(-8 * width * self.n_terms // BUCKET_BYTES)), MOST_BUCKETS)

    def gram_pass(self, width: int, m: Iterate | None = None, steps: list[np.ndarray] | tuple = (), start=None, kind: str = DOUBLE) -> Iterate:
        """``X^T X`` times ``m`` and ``steps``, or times the rows that ``start`` gives for terms: a row for each
        term of several entries and for each document with single ones."""
        n_terms, buckets = self.n_terms, self.buckets(width)
        known = None if m is None else (m.width, m.kind)

        def work(part: _Part, label: int) -> pa.Table:
            if known is None:
                y = part.times(start(part.terms), None)
            else:
                y = part.times(*(_stepped(z, steps) for z in part.received(label, n_terms, *known)))
            idx, z = part.sums(y, label, n_terms)
            z = z.astype(kind)
            found = [_message([("int32", int(idx[o[0]] % buckets)), ("int32", label)], idx[o], z[o], ["bucket", PART]) for o in _dealt(idx, buckets)]
            return pa.Table.from_batches(found, pa.schema([("bucket", pa.int32()), (PART, pa.int32()), ("idx", pa.binary()), ("z", pa.binary())]))

        shares = self._run(work, _SHARES, None if m is None else m.messages())
        done = Iterate(write_table(shares.groupBy("bucket").applyInArrow(_added(width, kind), _ITERATE), "svd-iterate"), width, kind)
        release(self.parts.sparkSession)
        return done

    def gram_times(self, width: int, m: Iterate | None = None, steps: list[np.ndarray] | tuple = (), start=None) -> DataFrame:
        """(idx, z) of ``gram_pass``."""
        return self.gram_pass(width, m, steps, start).rows()

    def gram_after(self, m: Iterate, steps: list[np.ndarray]) -> np.ndarray:
        """l x l Gram matrix of X times ``m`` and ``steps``."""
        n_terms, width, kind = self.n_terms, m.width, m.kind

        def work(part: _Part, label: int) -> pa.Table:
            y = part.times(*(_stepped(z, steps) for z in part.received(label, n_terms, width, kind)))
            return pa.table({"z": pa.array([y.tobytes()] if len(y) else [], pa.binary())})

        return gram(self._run(work, "z binary", m.messages()), len(steps[-1].T) if steps else width, n_parts=self.n_parts)

    def by_term(self, m: Iterate, steps: list[np.ndarray] | tuple = ()) -> DataFrame:
        """(idx, z) of all terms from ``m`` times ``steps``: documents' rows are dealt to their single entries."""
        n_terms, width, kind = self.n_terms, m.width, m.kind

        def work(part: _Part, label: int) -> pa.Table:
            idx, z = part.singles(_stepped(part.received(label, n_terms, width, kind)[1], steps))
            return pa.Table.from_arrays([pa.array(idx, pa.int64()), _binary(z)], ["idx", "z"])

        rows = m.rows()

        def packed(batches):
            for batch in batches:
                idx, z = batch.column(0).to_numpy(), _stacked(batch.column(1), width)
                label = (idx - n_terms) >> 32
                for part in np.unique(label):
                    yield _message([("int32", int(part))], idx[label == part], z[label == part].astype(kind), [PART])

        shared = m.rows(steps).where(F.col("idx") < n_terms)
        return shared.unionByName(self._run(work, "idx long, z binary", rows.where(F.col("idx") >= n_terms).mapInArrow(packed, _SENT)))


def _stepped(z: np.ndarray, steps: list[np.ndarray] | tuple) -> np.ndarray:
    for step in steps:
        z = z @ step
    return z


def _added(width: int, kind: str):
    """A bucket's rows from the parts' messages, added up by idx."""

    def run(got: pa.Table) -> pa.Table:
        got = got.sort_by(PART)
        given = [np.frombuffer(x.as_buffer(), np.int64) for x in got.column("idx")]
        ids = np.concatenate(given)
        idx, z = grouped(ids, np.concatenate([np.frombuffer(x.as_buffer(), kind).reshape(-1, width) for x in got.column("z")]).astype(DOUBLE))
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (idx, z.astype(kind), np.searchsorted(idx, ids).astype(np.int32))]
        ends = np.r_[0, np.cumsum([len(x) for x in given])].astype(np.int32)
        return pa.Table.from_arrays([pa.array([got.column("bucket")[0].as_py()], pa.int32()), *blobs[:2], pa.array([got.column(PART).to_pylist()], pa.list_(pa.int32())),
                                     pa.array([ends], pa.list_(pa.int32())), blobs[2]], ["bucket", "idx", "z", "parts", "ends", "at"])

    return run


def gram(dense: DataFrame, width: int, steps: list[np.ndarray] | tuple = (), n_parts: int | None = None, kind: str = DOUBLE) -> np.ndarray:
    """l x l Gram matrix of a dense table times ``steps``. ``n_parts``: its partitions, where they are known; to ask a plan
    with shuffles for them runs these a time more."""
    steps = list(steps)

    def partial(batches):
        g = None
        for batch in batches:
            m = _stepped(_stacked(batch.column(0), width, kind).astype(DOUBLE, copy=False), steps)
            g = m.T @ m if g is None else g + m.T @ m
        if g is not None:
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["g"])

    def added(batches):
        total = np.zeros(width * width)
        for batch in batches:
            for g in batch.column(0):
                total += np.frombuffer(g.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    # an l x l matrix from each task, added by groups of about the root of their number, and these in one task
    parts = dense.select("z").mapInArrow(partial, "g binary")
    groups = math.isqrt(max((n_parts or dense.rdd.getNumPartitions()) - 1, 0)) + 1
    if groups > 1:
        parts = parts.repartition(groups).mapInArrow(added, "g binary")
    found = parts.repartition(1).mapInArrow(added, "g binary").collect()
    return np.frombuffer(found[0].g).reshape(width, width).copy() if found else np.zeros((width, width))


def orthonormal(dense: Iterate, enough: float, most: int = 8, least: list[float] | None = None) -> list[np.ndarray]:
    """Small matrices whose product makes the columns of ``dense`` orthonormal within ``enough``; columns beyond its rank
    become zero.

    As in Cholesky QR each round takes a factor of the inverse Gram matrix, here from its eigenvectors. The first round
    holds up eigenvalues under rounding error, so an ill-conditioned iterate loses no direction: the next round sees
    it at its own scale, and what depends on the others even then is dropped. ``least`` takes the first round's least
    eigenvalue over its greatest."""
    steps: list[np.ndarray] = []
    for k in range(most):
        g = dense.gram(steps)
        d = np.sqrt(np.diag(g))
        live = np.flatnonzero(d > 0)
        if steps and np.abs(g[np.ix_(live, live)] - np.eye(len(live))).max(initial=0.0) < enough:
            break
        scale = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
        evals, u = np.linalg.eigh(g * scale[:, None] * scale)
        top = max(evals.max(initial=0.0), 1e-300)
        if least is not None and not k:
            least.append(float(evals[len(evals) - len(live):].min(initial=top) / top))
        step = scale[:, None] * u / np.sqrt(np.maximum(evals, 1e-13 * top))
        if k:
            step[:, evals < 1e-10 * top] = 0.0
        steps.append(step)
    return steps


def _signs(rows: DataFrame, width: int) -> np.ndarray:
    """Sign of the entry of largest magnitude in each column of (idx, z); of equal ones the first row's."""

    def better(best, new):
        return new if best is None else np.where((new[0] > best[0]) | (new[0] == best[0]) & (new[1] > best[1]), new, best)

    def task(batches):
        best = None
        for batch in batches:
            m = _stacked(batch.column(1), width)
            if not len(m):
                continue
            idx = batch.column(0).to_numpy()
            order = np.argsort(idx)
            k = order[np.abs(m[order]).argmax(axis=0)]
            x = m[k, np.arange(width)]
            best = better(best, np.stack([np.abs(x), -idx[k], np.sign(x)]))
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best.tobytes()], pa.binary())], ["s"])

    best = None
    for r in rows.mapInArrow(task, "s binary").collect():
        best = better(best, np.frombuffer(r.s).reshape(3, -1))
    return np.ones(width) if best is None else np.where(best[2] < 0, -1.0, 1.0)


def gram_times(rows: DataFrame, m: np.ndarray) -> np.ndarray:
    """``X^T X m`` over all documents of ``rows``, on the driver (small ``m`` only)."""
    out = np.zeros(m.shape)
    x = Matrix.of(rows, *m.shape)
    for r in x.by_term(x.gram_pass(m.shape[1], start=lambda terms: m[terms])).collect():
        out[r["idx"]] = np.frombuffer(r["z"])
    return out


def fit_svd(rows: DataFrame, index: DataFrame, n_terms: int, k: int = 20,
            oversample: int = 10, power_iters: int = 5, seed: int = 42) -> SVDModel:
    """Top-``k`` right singular vectors of the sparse matrix in ``rows`` (in parts already, see ``in_parts``, or not)."""
    l = min(k + oversample, n_terms)
    terms = Side.of(n_terms, l, math.ceil(LEAST_TILES / Side.of(rows.count(), l).blocks))

    def start(at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), l))
        for b in range(terms.blocks):
            mine = np.flatnonzero(at % terms.blocks == b)
            if len(mine):
                out[mine] = np.random.default_rng([seed, b]).standard_normal((terms.size(b), l))[at[mine] // terms.blocks]
        return out

    x = Matrix.of(rows, n_terms, l)
    m, steps, least = None, [], []
    # ``power_iters`` passes of X^T X (re-orthonormalised each time), then X alone for the Rayleigh-Ritz step
    for i in range(power_iters):
        last = i == power_iters - 1
        kind = DOUBLE if last or 8 * l * n_terms <= BROADCAST_BYTES else SINGLE
        m = x.gram_pass(l, m, steps, start, kind)
        # on the way a well-conditioned basis is enough, the last one has to be orthonormal
        steps = orthonormal(m, 1e-11 if last else 1e-2, least=least if last else None)
    # directions that the steps hold up a lot are rounding errors, other ones in every task: they are stored
    for _ in range(3):
        if not least or least[-1] > LEAST_EIGENVALUE:
            break
        m = m.applied(steps)
        steps = orthonormal(m, 1e-11, least=least)
    evals, u = np.linalg.eigh(x.gram_after(m, steps))
    order = np.argsort(evals)[::-1][:k]
    side = Side(n_terms, len(order), terms.blocks)
    found = write_table(x.by_term(m, [*steps, u[:, order]]), "svd-terms")
    # fix the sign: largest-magnitude entry of each component positive
    basis = checkpoint_partitioned(_in_blocks(found, side, _signs(found, side.width)))
    return SVDModel(index, basis, np.sqrt(np.clip(evals[order], 0, None)), n_terms, side.blocks)


def _in_blocks(rows: DataFrame, side: Side, scale: np.ndarray) -> DataFrame:
    """A dense table of (idx, z), its columns times ``scale``."""

    def task(batches):
        block, z = None, None
        for batch in batches:
            blocks, idx = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = _stacked(batch.column(2), side.width) * scale
            for b in np.unique(blocks):
                if b != block:
                    if block is not None:
                        yield side.cut(block, z)
                    block, z = int(b), np.zeros((side.size(b), side.width))
                mine = blocks == b
                z[idx[mine] // side.blocks] = values[mine]
        if block is not None:
            yield side.cut(block, z)

    dealt = rows.select((F.col("idx") % side.blocks).cast("int").alias("block"), "idx", "z").repartition(side.blocks, "block")
    return dealt.sortWithinPartitions("block").mapInArrow(task, DENSE)


def given_basis(spark: SparkSession, index: DataFrame, n_terms: int, entries, k: int) -> SVDModel:
    """A model whose basis a function of the terms' indexes gives, array of idx -> len x k."""
    side = Side.of(n_terms, k, LEAST_TILES)
    return SVDModel(index, checkpoint_partitioned(generated(spark, side, lambda b, at: entries(at))), np.ones(k), n_terms, side.blocks)


def svd_project(rows: DataFrame, model: SVDModel, key: str = "doc_id",
                keep: list[str] | tuple = (), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(key, *keep, svd array<double>)``: each sparse row times the basis."""
    keep, terms = list(keep), model.side
    if 8 * terms.n * terms.width > broadcast_bytes:
        return _project_by_parts(rows, model, key, keep)
    sc = rows.sparkSession.sparkContext
    basis = sc.broadcast(collected(model.basis, terms))
    schema = T.StructType([rows.schema[c] for c in [key, *keep]]
                          + [T.StructField("svd", T.ArrayType(T.DoubleType(), False))])

    def project(batches):
        b = basis.value
        for batch in batches:
            for pdf in _chunks(batch, _most_nnz(b.shape[1])):
                idx, val, ptr = _flatten(pdf)
                y = rows_times(idx, val, ptr, b)
                out = pdf[[key, *keep]].copy()
                out["svd"] = list(y)
                yield out

    return rows.mapInPandas(project, schema)


def _project_by_parts(rows: DataFrame, model: SVDModel, key: str, keep: list[str]) -> DataFrame:
    """Each part of the documents gets the basis rows of its own terms."""
    n_terms, k = model.n_terms, model.side.width
    if PART not in rows.columns:
        rows = in_parts(rows, tile_tasks(rows, rows.count(), n_terms, k), key)
    rows = rows.select(PART, key, *keep, "idx", "val")
    side = model.side

    def wanted(got: pa.Table) -> pa.Table:
        idx = np.unique(np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in got.column("idx").chunks])).astype(np.int64)
        part, blocks = got.column(PART)[:1].combine_chunks(), [idx[o] for o in _dealt(idx, side.blocks)]
        return pa.table({"block": pa.array([int(x[0] % side.blocks) for x in blocks], pa.int32()), PART: pa.concat_arrays([part] * len(blocks)) if blocks else part[:0],
                         "idx": pa.array([x.tobytes() for x in blocks], pa.binary())})

    def answered(asked: pa.Table, basis: pa.Table) -> pa.Table:
        found = []
        if len(asked) and len(basis):
            z = np.zeros((side.size(asked.column("block")[0].as_py()), k))
            for piece, rows in zip(basis.column("piece").to_pylist(), basis.column("z")):
                some = np.frombuffer(rows.as_buffer()).reshape(-1, k)
                z[piece * side.step:piece * side.step + len(some)] = some
            for part, idx in zip(asked.column(PART).to_pylist(), asked.column("idx")):
                idx = np.frombuffer(idx.as_buffer(), np.int64)
                found.append(_message([("int32", part)], idx, z[idx // side.blocks], [PART]))
        return pa.Table.from_batches(found, pa.schema([(PART, pa.int32()), ("idx", pa.binary()), ("z", pa.binary())]))

    asked = rows.select(PART, "idx").groupBy(PART).applyInArrow(wanted, f"block int, {PART} int, idx binary")
    sent = asked.groupBy("block").cogroup(model.basis.groupBy("block")).applyInArrow(answered, _SENT)
    columns, listed = [key, *keep], pa.list_(pa.field("element", pa.float64(), nullable=False))
    schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField("svd", T.ArrayType(T.DoubleType(), False))])

    def task(left, right):
        part = _Part(left, right, n_terms)
        y = part.times(part.received(0, n_terms, k)[0], None)
        ends = pa.array(np.arange(len(y) + 1) * k, pa.int32())
        return pa.Table.from_arrays([*(left.column(c) for c in columns), pa.ListArray.from_arrays(ends, pa.array(y.ravel()), type=listed)], [*columns, "svd"])

    return rows.groupBy(PART).cogroup(sent.groupBy(PART)).applyInArrow(task, schema)

"""Benchmark decontamination: the words of documents that lie inside a passage of a benchmark.

A phrase is a window of ``width`` consecutive words of a benchmark item (a shorter item is one phrase). Documents stay in
their input partition; each task reads them into *shards* and indexes a shard's words with an FM-index (``fmindex``):
phrases are found by backward search over wavelet-tree ranks, their places from sampled suffix positions, and the places
in a document are merged into spans. There is no shuffle, and a task holds one shard.

The index's alphabet is the words of the phrases; any other word ends a run, and runs shorter than the shortest phrase
can hold none, so they are left out. That loses no occurrence of any phrase. Benchmarks of more than ``BLOCK_WORDS``
words are searched in blocks of about so many, one pass over the documents each: a block is what the driver and the tasks
hold. Long texts are cut into words piece by piece; only their word numbers are held whole.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. Null and empty texts have no words and no hits.
Items without words have no phrase; an item without an id still marks hits and is not listed. Rows that repeat an
item_id are one item with the phrases of all its rows. Repeated documents each get their own row. An empty benchmark
hits nothing. Columns other than key, text and those in ``keep`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, col, fresh
from .fmindex import FMIndex

WIDTH = 10
#: Words of the benchmark searched in one pass.
BLOCK_WORDS = 500_000
#: Indexed symbols and documents after which a shard is closed; it ends with a slice of documents.
SHARD_SYMBOLS, SHARD_DOCUMENTS = 1 << 20, 1 << 17
#: Bytes of text cut into words at a time.
PIECE = 1 << 20
_MARK = b"\x01"
_WORD_BYTE = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
#: A-Z lowered, everything that no word holds a blank.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if word else 32 for b, word in enumerate(_WORD_BYTE))
SPANS = "array<struct<first:bigint,last:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Phrases:
    """A block of a benchmark: word -> symbol, and the distinct phrases by length with the items that hold each."""

    symbols: dict[bytes, int]
    rows: list[np.ndarray]       # for each length: a matrix of symbols, one phrase a row
    items_at: list[np.ndarray]   # for each length: offsets into ``items`` by phrase
    items: list[np.ndarray]      # for each length: item numbers
    ids: np.ndarray              # item number -> item_id

    @property
    def shortest(self) -> int:
        return min((r.shape[1] for r in self.rows), default=0)


def phrases_of(items: list[tuple[int | None, bytes]], width: int = WIDTH) -> Phrases:
    symbols: dict[bytes, int] = {}
    ids = sorted({i for i, _ in items if i is not None})
    number = {i: k for k, i in enumerate(ids)}
    found: dict[int, dict[tuple, set[int]]] = {}
    for item, text in items:
        coded = [symbols.setdefault(w, len(symbols) + 1) for w in words_of(text)]
        n = min(width, len(coded))
        for at in range(len(coded) - n + 1 if n else 0):
            holders = found.setdefault(n, {}).setdefault(tuple(coded[at:at + n]), set())
            if item is not None:
                holders.add(number[item])
    rows, items_at, listed = [], [], []
    for n in sorted(found):
        rows.append(np.array(list(found[n]), np.int64).reshape(-1, n))
        items_at.append(np.cumsum([0, *(len(h) for h in found[n].values())]))
        listed.append(np.array([i for h in found[n].values() for i in sorted(h)], np.int64))
    return Phrases(symbols, rows, items_at, listed, np.array(ids, np.int64))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A lowered text in pieces that end between words."""
    blank, at = text.translate(_TABLE), 0
    while len(blank) - at > PIECE:
        end = blank.find(b" ", at + PIECE)
        if end < 0:
            break
        yield blank[at:end]
        at = end
    yield blank[at:] if at else blank


def word_symbols(texts: list[bytes | None], symbols: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each word of all texts, 0 for words without one; number of words of each text)."""
    marked = {**symbols, _MARK: -1} if _MARK not in symbols else symbols
    coded, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0
    owners: list[int] = []

    def close() -> None:
        nonlocal group, owners, size
        words = (b" " + _MARK + b" ").join(group).split()
        found = np.fromiter(map(marked.get, words, repeat(0)), np.int64, len(words))
        cuts = np.flatnonzero(found == -1)
        np.add.at(counts, owners, np.diff(np.r_[-1, cuts, len(found)]) - 1)
        coded.append(found[found != -1])
        group, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for piece in _pieces(text or b""):
            group.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= PIECE:
                close()
    if group:
        close()
    return np.concatenate(coded) if coded else np.zeros(0, np.int64), counts


class Shard:
    """Documents of a task and the runs of their words that can hold a phrase."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.words = phrases, 0
        self.kept: list[list[pa.Array]] = []
        self.counts: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []  # word number, in the shard, of each run's first word
        self.lengths: list[np.ndarray] = []
        self.size = self.documents = 0

    def add(self, kept: list[pa.Array], texts: list[bytes | None], marked: dict[bytes, int]) -> None:
        symbols, counts = word_symbols(texts, marked)
        owner_end = np.cumsum(counts)
        breaks = np.zeros(len(symbols) + 1, bool)
        breaks[owner_end] = True  # a document's first word starts a run
        known = symbols > 0
        first = known & (breaks[:-1] | ~np.r_[False, known[:-1]])
        last = known & (breaks[1:] | ~np.r_[known[1:], False])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = ends - starts >= max(self.phrases.shortest, 1)
        starts, lengths = starts[long], (ends - starts)[long]
        # the runs' symbols, a 0 after each
        out = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
        to = np.cumsum(lengths + 1) - lengths - 1
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(to, lengths) + inside] = symbols[np.repeat(starts, lengths) + inside]
        self.kept.append(kept)
        self.counts.append(counts)
        self.symbols.append(out)
        self.starts.append(starts + self.words)
        self.lengths.append(lengths)
        self.words += len(symbols)
        self.size += len(out)
        self.documents += len(texts)

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each document; document, first and last + 1 of each merged span; pairs document, item number)."""
        counts = np.concatenate(self.counts)
        text, starts, lengths = np.concatenate(self.symbols), np.concatenate(self.starts), np.concatenate(self.lengths)
        first_word = np.cumsum(counts) - counts
        run_at = np.cumsum(lengths + 1) - lengths - 1  # where each run starts in the index's text
        places, widths, pairs = [], [], [np.zeros((0, 2), np.int64)]
        index = FMIndex(text, len(self.phrases.symbols)) if len(text) else None
        for rows, items_at, items in zip(self.phrases.rows, self.phrases.items_at, self.phrases.items) if index else ():
            low, high = index.ranges(rows)
            n = high - low
            phrase = np.repeat(np.arange(len(rows)), n)
            at = index.locate(np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
            run = np.searchsorted(run_at, at, "right") - 1
            word = starts[run] + at - run_at[run]
            places.append(word)
            widths.append(np.full(len(word), rows.shape[1]))
            # the last document that starts at the word or before it; documents without words are passed over
            document = np.searchsorted(first_word, word, "right") - 1
            held = np.unique(np.column_stack([document, phrase]), axis=0)
            many = items_at[held[:, 1] + 1] - items_at[held[:, 1]]
            inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.column_stack([np.repeat(held[:, 0], many), items[np.repeat(items_at[held[:, 1]], many) + inside]]))
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        end = place + (np.concatenate(widths) if widths else place)
        document, first, last = merged_spans(np.searchsorted(first_word, place, "right") - 1, place, end)
        return counts, document, first - first_word[document], last - first_word[document], np.unique(np.concatenate(pairs), axis=0)


def merged_spans(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each owner joined where they overlap or touch, by owner and start."""
    if not len(owner):
        return owner, first, last
    by = np.lexsort((first, owner))
    owner, first, last = owner[by], first[by], last[by]
    offset = np.cumsum(np.r_[0, np.diff(owner) > 0]) * (int(last.max()) + 1)  # the running end starts anew with each owner
    reach = np.maximum.accumulate(last + offset)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (first[1:] + offset[1:] > reach[:-1])]
    heads = np.flatnonzero(new)
    return owner[heads], first[heads], (reach - offset)[np.r_[heads[1:], len(owner)] - 1]


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), values)


def _search(df: DataFrame, phrases: Phrases, keep: list[str], width_names: list[str]) -> DataFrame:
    """``df``'s columns ``keep`` with the block's n_words, spans and items; the last column of ``df`` is the text."""
    sent = df.sparkSession.sparkContext.broadcast(phrases)
    n = len(keep)

    def rows(shard: Shard) -> Iterator[pa.RecordBatch]:
        counts, document, first, last, pairs = shard.search()
        spans = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["first", "last"])
        spans = _lists(document, len(counts), spans)
        items = _lists(pairs[:, 0], len(counts), pa.array(shard.phrases.ids[pairs[:, 1]], pa.int64()))
        at = 0
        for kept in shard.kept:
            size = len(kept[0])
            columns = [*kept, pa.array(counts[at:at + size], pa.int64()), spans.slice(at, size), items.slice(at, size)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *width_names])
            at += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        shard = Shard(block)
        for batch in batches:
            text = batch.column(n).cast(pa.binary())
            size = max(1, SLICE_BYTES * len(text) // max(text.nbytes, 1))
            for at in range(0, len(text), size):
                shard.add([batch.column(i).slice(at, size) for i in range(n)], text.slice(at, size).to_pylist(), block.symbols)
                if shard.size >= SHARD_SYMBOLS or shard.documents >= SHARD_DOCUMENTS:
                    yield from rows(shard)
                    shard = Shard(block)
        if shard.documents:
            yield from rows(shard)

    kinds = T._parse_datatype_string(f"{width_names[0]} bigint, {width_names[1]} {SPANS}, {width_names[2]} array<bigint>")
    schema = T.StructType([*(df.schema[c] for c in keep), *kinds])
    return df.mapInArrow(run, schema)


def blocks_of(benchmark: DataFrame, width: int, key: str, text: str, most: int) -> Iterator[Phrases]:
    """The benchmark in blocks of about ``most`` words: equal texts share a block, whose rows the driver reads."""
    items = benchmark.select(col(key).cast("bigint").alias("id"), col(text).cast("string").alias("t")).where("t is not null")
    size = F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // most))
    block = F.pmod(F.xxhash64("t"), F.lit(n))
    for b in range(n):
        yield phrases_of([(r["id"], r["t"].encode()) for r in items.where(block == b).toLocalIterator()], width)


def find(df: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = (), key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, ``keep``, n_words, spans, items) of every row: the number of words, the hit stretches as word numbers
    (first, last exclusive) in order, and the ids of the items with a phrase in the text, ascending."""
    own = fresh(["doc_id", *keep], "n_words", "spans", "items", "body")
    names, body = own[:3], own[3]
    columns = [col(key).alias("doc_id"), *(col(c).alias(c) for c in keep)]
    found, earlier = df.select(*columns, col(text).cast("string").alias(body)), []
    blocks = blocks_of(benchmark, width, item, item_text, block_words)
    held = next(blocks)
    while held is not None:
        after = next(blocks, None)
        tag = [f"{name}_{len(earlier)}" for name in names]
        carried = [c for c in found.columns if c != body]
        # every pass but the last hands the text on
        inputs = found.select(*map(col, carried), *([col(body)] if after is None else [col(body), col(body).alias(body + "_")]))
        found = _search(inputs, held, [*carried, *([] if after is None else [body])], tag)
        earlier.append(tag)
        held = after
    spans = col(earlier[0][1]) if len(earlier) == 1 else union_spans(F.concat(*(col(t[1]) for t in earlier)))
    items = col(earlier[0][2]) if len(earlier) == 1 else F.array_sort(F.array_distinct(F.concat(*(col(t[2]) for t in earlier))))
    return found.select("doc_id", *map(col, keep), col(earlier[0][0]).alias(names[0]), spans.alias(names[1]), items.alias(names[2]))


def union_spans(spans):
    """One document's spans, of several blocks, merged."""

    def join(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), join)


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of ``find`` rows."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["last"] - x["first"])
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    done = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"))
    return done.withColumn("contaminated", F.col("n_hit") > 0)


def without(text: str, spans: list[dict]) -> str:
    """A text without the words of its spans and what stands between them."""
    raw, out, at, word, todo = text.encode(), [], 0, 0, iter(spans)
    span, blank = next(todo, None), text.encode().translate(_TABLE)
    place, n = 0, len(raw)
    while span is not None and place < n:
        while place < n and blank[place] == 32:
            place += 1
        end = blank.find(b" ", place)
        end = n if end < 0 else end
        if word == span["first"]:
            out.append(raw[at:place])
        if word == span["last"] - 1:
            at, span = end, next(todo, None)
        word, place = word + 1, end
    out.append(raw[at:])
    return b"".join(out).decode()


def removed(df: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """``df``'s (doc_id, text) with the hit words cut out of each text; texts without hits unchanged."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([t and without(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    cut = F.arrow_udf(run, "string")
    found = find(df, benchmark, width, (text,), key, text, **columns)
    hit = F.size("spans") > 0
    # only texts with spans go to Python
    return found.select("doc_id", F.coalesce(cut(F.when(hit, col(text)), F.when(hit, F.col("spans"))), col(text)).alias(text))

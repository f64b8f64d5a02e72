"""Token ids in fixed-width bit packing.

File format: one record (table row) is a *segment* of whole documents in ascending document order.

    payload   "FWB1", bits per id (u8), 3 zero bytes, ids per block (u32), number of ids (u64),
              block offsets (u64 for each block, from the payload's start), then the blocks
    block     ``ids_per_block`` ids (the last one fewer), ``bits`` bits each, lowest bit first, padded to a byte

``bits`` is the least width that holds every id of the vocabulary. An id is found by one multiplication and
one block offset, a whole block is unpacked by a few numpy calls. Segments are rows of a Parquet table, so
Spark's committer makes the write safe against lost executors and any file system will do.

Null and empty texts are documents of the end id alone. Rows with equal doc_id are kept, in any order among
themselves; a null doc_id comes first. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import col

BLOCK_IDS = 4096
#: Ids after which a segment is closed; a segment ends with a slice of documents.
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4sBxxxIQ")
#: Bytes of remembered pieces and their ids after which a worker's table starts anew.
REMEMBERED = 48 << 20
#: Bytes of text encoded at a time: the more, the fewer pieces that are distinct in it.
TEXT_BYTES = 8 << 20
#: Words of letters of Latin scripts, which every version of Unicode has as letters, maybe with a space before them.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+")
#: Each byte's printable character in byte-level vocabularies.
_BYTE_NAMES = {b: s for b, s in enumerate(byte_symbols()) if b != 10}
_BLANK, _LINE, _HIDDEN, _ALPHA, _STOP = 1, 2, 4, 8, 16
#: What each byte is to the cuts. Hidden: controls and white space, and the first bytes of characters some of which are.
_KIND = np.zeros(256, np.uint8)
_KIND[[*b" \n"]] |= _BLANK
_KIND[[*b"\n"]] |= _LINE
_KIND[[*range(33), 0xC2, 0xE1, 0xE2, 0xE3]] |= _HIDDEN
_KIND[[*range(65, 91), *range(97, 123)]] |= _ALPHA
_KIND[[*b".,;:!?"]] |= _STOP

SEGMENTS = "part int, segment int, inside bigint, doc_ids array<bigint>, doc_tokens array<bigint>, n_ids bigint, payload binary"


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a payload of the format."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = []
    for at in range(0, len(ids), BLOCK_IDS):
        raw = np.ascontiguousarray(ids[at:at + BLOCK_IDS], "<u4")
        if bits in (8, 16, 32):
            blocks.append(raw.astype(f"<u{bits // 8}").tobytes())
        else:
            by_bit = np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
            blocks.append(np.packbits(by_bit, bitorder="little").tobytes())
    first = _HEAD.size + 8 * len(blocks)
    offsets = first + np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    return b"".join([_HEAD.pack(b"FWB1", bits, BLOCK_IDS, len(ids)), offsets.astype("<u8").tobytes(), *blocks])


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; only the blocks that hold them are read."""
    magic, bits, per_block, total = _HEAD.unpack_from(payload)
    if magic != b"FWB1":
        raise ValueError("not a packed payload")
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, "<u4")
    offsets = np.frombuffer(payload, "<u8", -(-total // per_block), _HEAD.size)
    out = []
    for block in range(start // per_block, -(-stop // per_block)):
        n = min(per_block, total - block * per_block)
        if bits in (8, 16, 32):
            out.append(np.frombuffer(payload, f"<u{bits // 8}", n, int(offsets[block])).astype("<u4"))
            continue
        raw = np.frombuffer(payload, np.uint8, -(-n * bits // 8), int(offsets[block]))
        by_bit = np.unpackbits(raw, bitorder="little", count=n * bits).reshape(n, bits)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = by_bit
        out.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel())
    base = start // per_block * per_block
    return np.concatenate(out)[start - base:stop - base]


class TextIds:
    """Texts -> ids by the tokenizers library. A byte-level vocabulary splits a text by a fixed pattern before it merges
    anything, so a text can be cut wherever the pattern ends a token: before the last white space of a run that a
    visible character follows, before a mark after a letter, and between a line end and a letter. The cuts of a whole
    slice are found at once; each distinct piece of it is encoded once, a word of letters by the library's merge model
    alone, any other piece by the whole library. Pieces are remembered in a table that is bounded in bytes."""

    def __init__(self, path: str):
        self.library, self.specials, self.by_piece = _library(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Put pieces that are not in the table into it; their rows."""
        simple = np.fromiter((_WORD.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        pieces, n = [pieces[i] for i in order], int(simple.sum())
        # no word holds a line end, so one call names the bytes of all of them
        named = b"\n".join(pieces[:n]).decode("latin-1").translate(_BYTE_NAMES).split("\n") if n else []
        merged = [*map(self.library.model.tokenize, named)]
        other = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces[n:]], add_special_tokens=False)]
        width = np.fromiter(map(len, chain(merged, other)), np.int64, len(pieces))
        ids = np.fromiter(chain((t.id for tokens in merged for t in tokens), chain.from_iterable(other)), "<u4", int(width.sum()))
        rows = np.empty(len(pieces), np.int64)
        rows[order] = len(self.known) + np.arange(len(pieces))
        self.known = pa.concat_arrays([self.known, pa.array(pieces, pa.binary())])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(width) - width])
        self.width, self.ids = np.concatenate([self.width, width]), np.concatenate([self.ids, ids])
        return rows

    def _forget(self) -> None:
        self.known, self.ids = pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.first = self.width = np.zeros(0, np.int64)

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """The table's row of each distinct piece."""
        if self.known.nbytes + self.ids.nbytes + 2 * self.first.nbytes > REMEMBERED:
            self._forget()
        found = pc.index_in(pieces, value_set=self.known)
        rows, new = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), found.is_null()
        rows[new.to_numpy(zero_copy_only=False)] = self._learn(pieces.filter(new).to_pylist()) if found.null_count else 0
        return rows

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        strings = texts.to_pylist()
        alone = [i for i, t in enumerate(strings) if t and (not self.by_piece or any(s in t for s in self.specials))]
        if alone:  # special tokens are found before the pattern, and change what is at a piece's ends
            whole = dict(zip(alone, self._whole([strings[i] for i in alone])))
            rest, counts = self.arrays(pa.array(["" if i in whole else t for i, t in enumerate(strings)], pa.string()))
            ends = np.cumsum(counts)
            parts = [np.frombuffer(whole[i], "<u4") if i in whole else rest[ends[i] - counts[i]:ends[i]] for i in range(len(strings))]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        data = "".join([t or "" for t in strings]).encode()
        sizes = np.array([0 if t is None else len(t.encode()) if not t.isascii() else len(t) for t in strings], np.int64)
        if not data:
            return np.zeros(0, "<u4"), np.zeros(len(strings), np.int64)
        starts = np.cumsum(sizes) - sizes
        cuts = _cuts(np.frombuffer(data, np.uint8), starts)
        offsets = pa.py_buffer(np.append(cuts, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(cuts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        row = self._rows(coded.dictionary)[coded.indices.to_numpy()]
        many = self.width[row]
        before = np.cumsum(many) - many
        flat = self.ids[np.repeat(self.first[row] - before, many) + np.arange(int(many.sum()))]
        at = np.append(before, len(flat))[np.searchsorted(cuts, starts)]
        return flat, np.diff(np.append(at, len(flat)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        flat, counts = self.arrays(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [flat[e - n:e].tobytes() for n, e in zip(counts, ends)]


def _cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in UTF-8 texts, one after the other, where the split pattern ends a token, and all texts' starts."""
    kind = _KIND[raw]
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(len(raw), bool)
    # a blank before a visible character ...
    cut[:-1] = (before & _BLANK != 0) & (after & _HIDDEN == 0)
    # ... a mark after a letter, a letter after a line end
    cut[1:] |= (before & _ALPHA != 0) & (after & _STOP != 0) | (before & _LINE != 0) & (after & _ALPHA != 0)
    # what a text's last byte is followed by is another text
    ends = starts[1:] - 1
    cut[ends[ends >= 0]] = False
    cut[starts[starts < len(raw)]] = True
    return np.flatnonzero(cut)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def _library(path: str):
    """(tokenizer, its special tokens, whether it is a byte-level one that cuts by its own pattern alone)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    by_piece = (not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library, [t.content for t in library.get_added_tokens_decoder().values()], by_piece


@lru_cache(maxsize=1)
def _ids_of(path: str) -> TextIds:
    return TextIds(path)


def write_segments(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the segments of the format to ``path`` in ascending ``key`` order.

    One shuffle: texts go to ranges of the key. Within a range they are sorted (spilling as needed) and streamed.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    named = df.select(col(key).cast("bigint").alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    ordered = named.repartitionByRange(parts, F.asc("doc_id")).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, segment = TaskContext.get().partitionId(), _ids_of(tokenizer), 0
        bits = id_bits(max(encoder.size, end_id + 1))
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        held_ids: list[np.ndarray] = []
        held = inside = 0  # ids in the open segment, and in this part's earlier ones

        def close() -> pa.RecordBatch:
            columns = [[part], [segment], [inside], [docs], [np.concatenate(counts)], [held], [pack(np.concatenate(held_ids), bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            names = ["part", "segment", "inside", "doc_ids", "doc_tokens", "n_ids", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            rows = max(1, TEXT_BYTES * len(batch) // max(batch.nbytes, 1))
            for at in range(0, len(batch), rows):
                some = batch.slice(at, rows)
                flat, n = encoder.arrays(some.column(1))
                ids = np.full(len(flat) + len(n), end_id, "<u4")  # each document's ids and the end id
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                docs += some.column(0).to_pylist()
                counts.append(n + 1)
                held_ids.append(ids)
                held += len(ids)
                if held >= SEGMENT_IDS:
                    yield close()
                    inside += held
                    docs, counts, held_ids, held, segment = [], [], [], 0, segment + 1
        if docs:
            yield close()

    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The written segments with ``start``: the ids of all segments before. Writers count within their part, so
    the running total over the whole stream is taken over one row per part (as many as write tasks), and only
    these rows are broadcast; payloads don't move."""
    data = spark.read.schema(SEGMENTS).parquet(path)
    parts = data.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(F.col("part").alias("of"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return data.join(F.broadcast(before), F.col("part") == F.col("of")).withColumn("start", F.col("before") + F.col("inside"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary u32) of every document, unpacked from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(row["doc_tokens"], dtype=np.int64)
                for a in range(0, len(ends), 512):  # some documents at a time
                    b = min(a + 512, len(ends))
                    low = int(ends[a - 1]) if a else 0
                    ids = unpack(row["payload"], low, int(ends[b - 1]))
                    cuts = [low, *ends[a:b].tolist()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row["doc_ids"][a:b], pa.int64()),
                        pa.array([row["start"] + c for c in cuts[:-1]], pa.int64()),
                        pa.array([y - x for x, y in zip(cuts, cuts[1:])], pa.int64()),
                        pa.array([ids[x - low:y - low].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])

    wanted = segments(spark, path).select("start", "doc_ids", "doc_tokens", "payload")
    return wanted.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_tokens(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of the whole stream; ``count`` is what the caller holds in memory."""
    near = segments(spark, path).where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start))
    found = [unpack(r["payload"], max(0, start - r["start"]), start + count - r["start"]) for r in near.select("start", "payload").orderBy("start").toLocalIterator()]
    return np.concatenate(found) if found else np.zeros(0, "<u4")


def checksums(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_documents`` rows."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))



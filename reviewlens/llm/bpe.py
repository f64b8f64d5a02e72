"""BPE encoding and decoding as bounded-lookahead streaming transducers.

A merge of rank r that ends at a position can only be pre-empted from the right by a merge of a lower
rank whose left part is a suffix of the merged right part, and that one again only by a lower rank, and
so on. The longest such chain, measured in symbols, is the merge list's *sufficient lookahead*: once that
many symbols after a position are known, whether a token ends there can no longer change. The encoder
holds the symbols since the last emitted token end, at most ``lookahead + BLOCK`` of them, and emits every
token whose end is stable; a word of any length takes constant memory. The decoder feeds the bytes of each
id to an incremental UTF-8 machine and emits text as soon as its bytes are complete.

Texts are cut at white space, which no token and no composed character spans, and the tokens of a short
piece are remembered, in a table of bounded size, for the next time it occurs.

Null and empty texts give no ids and the empty text. Texts are never cut short; columns other than the text
are carried along unchanged, and an output name that is taken gets underscores appended.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, per_text

#: Symbols that the encoder takes in between two emissions.
BLOCK = 512
#: Pieces up to this many characters are remembered, at most so many of them in a task.
SHORT, REMEMBERED = 48, 120_000
#: Characters of a text that are split into pieces at a time.
WINDOW = 1 << 16
ID_BITS, ID_MASK, NONE = 32, (1 << 32) - 1, 1 << 90

# Fixed values of the Unicode standard: the White_Space property.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = regex.compile(f"[{SPACE}]+")
#: What str.split() cuts at although it has not the property.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Marks that often end a piece.
_STOPS = frozenset(".,;:!?")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], end: str = "") -> int:
    """Symbols after a position that can decide whether a token ends there."""
    reach: dict[str, int] = {}
    for left, right in merges:
        if end and right.endswith(end):  # nothing follows the end of a word
            n = len(right) - len(end)
        else:
            n = len(right) + max(reach.get(right[i:], 0) for i in range(len(right)))
        if n > reach.get(left, 0):
            reach[left] = n
    return max(reach.values(), default=0)


class Model:
    """Vocabulary, merge list and text rules of a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only plain BPE models are read")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges, self.end)
        #: Pair of ids -> rank and merged id, each packed into one integer.
        self.ranks = {self.vocab[a] << ID_BITS | self.vocab[b]: rank << ID_BITS | self.vocab[a + b] for rank, (a, b) in enumerate(merges)}
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        names = {i: t for t, i in self.vocab.items()}
        names.update({t["id"]: t["content"] for t in spec["added_tokens"]})
        #: Base symbols that a token covers.
        self.width = {i: len(t) - len(self.end) * bool(self.end and t.endswith(self.end)) for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._read_rules(spec)
        self.bytes_of = self._decode_table(spec.get("decoder"), names, symbols)
        self.between = b"" if spec.get("decoder") else b" "

    def _read_rules(self, spec: dict) -> None:
        rules = spec.get("normalizer") or {}
        kinds = [x["type"] for x in rules.get("normalizers", [rules] if rules else [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        if set(kinds) - {"NFC", "Lowercase", "Replace"}:
            raise ValueError(f"unknown text rules: {kinds}")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        cut = next((s for s in steps if s["type"] == "Split"), None)
        if cut is None or not cut.get("invert") or cut["behavior"] != "Removed":
            raise ValueError("only vocabularies that cut words out of white space are read")
        pattern = cut["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", SPACE))
        #: Runs of letters and runs of punctuation are words whatever stands beside them.
        self.letters_are_words = r"|[\p{L}]+|" in pattern and pattern.endswith(r"|[^\s\p{L}\p{N}]+")
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _decode_table(self, decoder: dict | None, names: dict[int, str], symbols: list[str]) -> list[bytes]:
        as_byte = {s: bytes([b]) for b, s in enumerate(symbols)}
        table = [b""] * (max(names) + 1)
        for i, token in names.items():
            if decoder and decoder["type"] == "ByteLevel" and all(c in as_byte for c in token):
                table[i] = b"".join(as_byte[c] for c in token)
            else:
                table[i] = token.encode()
        return table


def merge(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """Ids after all merges, lowest rank first and leftmost among equals."""
    if len(symbols) > 64:
        return _merge_long(symbols, ranks)
    get = ranks.get
    found = [get(a << ID_BITS | b, NONE) for a, b in zip(symbols, symbols[1:])]
    while found and (best := min(found)) != NONE:
        i = found.index(best)
        symbols[i] = best & ID_MASK
        del symbols[i + 1], found[i]
        if i:
            found[i - 1] = get(symbols[i - 1] << ID_BITS | symbols[i], NONE)
        if i < len(found):
            found[i] = get(symbols[i] << ID_BITS | symbols[i + 1], NONE)
    return symbols


def _merge_long(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (found := ranks.get(symbols[i] << ID_BITS | symbols[j])) is not None:
            heapq.heappush(heap, (found, i, symbols[i], symbols[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        found, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], alive[j] = found & ID_MASK, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s, live in zip(symbols, alive) if live]


class WordEncoder:
    """Transducer bytes of one word -> ids; holds at most ``lookahead + 2 * BLOCK`` symbols."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), BLOCK):
            self.held += data[at:at + BLOCK]
            if len(self.held) > self.model.lookahead + BLOCK:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Ids whose ends can no longer change. The newest byte waits: it may turn out to end the word."""
        known = self.held[:-1]
        limit, done, out = len(known) - self.model.lookahead, 0, []
        for token in merge([self.model.inner[b] for b in known], self.model.ranks):
            if done + self.model.width[token] > limit:
                break
            done += self.model.width[token]
            out.append(token)
        self.held = self.held[done:]
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        if not held:
            return []
        return merge([*(self.model.inner[b] for b in held[:-1]), self.model.last[held[-1]]], self.model.ranks)


class Words(dict):
    """Word -> packed ids; remembers the short ones."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        m, data = self.model, word.encode()
        if len(word) <= SHORT:
            symbols = [m.inner[b] for b in data]
            symbols[-1] = m.last[data[-1]]
            ids = merge(symbols, m.ranks)
        else:
            encoder, ids = WordEncoder(m), []
            for at in range(0, len(data), WINDOW):
                ids += encoder.push(data[at:at + WINDOW])
            ids += encoder.finish()
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


class Encoder(dict):
    """Text -> packed ids (little-endian unsigned 32 bit). As a dict: ids of the short pieces met so far;
    ``words``: those of their words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.words = model, Words(model)
        self.marks = {s[0] for s in model.special}

    def __missing__(self, piece: str) -> bytes:
        m = self.model
        if m.specials and not self.marks.isdisjoint(piece):
            ids = b"".join([struct.pack("<I", m.special[part]) if part in m.special else self._plain(part) for part in m.specials.split(piece)])
        else:
            ids = self._plain(piece)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        m = self.model
        if text.isascii():
            text = text.lower() if m.lower else text
        else:
            text = unicodedata.normalize("NFC", text) if m.nfc else text
            # each character by itself: no rule for a final sigma
            text = text.replace("Σ", "σ").lower() if m.lower else text
        if m.letters_are_words and text.isalpha():
            return self.words[text]
        if m.letters_are_words and text[-1:] in _STOPS and text[:-1].isalpha():
            return self.words[text[:-1]] + self.words[text[-1]]
        return b"".join([self.words[found.group()] for found in m.pieces.finditer(text)])

    def blocks(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, window by window; windows end at white space."""
        at, n = 0, len(text)
        while at < n:
            end = at + WINDOW
            if end < n:
                if space := _SPACES.search(text, end):
                    end = space.start()
                else:
                    end = n
            window = text[at:end]
            words = _SPACES.split(window) if _SEPARATORS.search(window) else window.split()
            yield b"".join(map(self.__getitem__, words))
            at = end

    def __call__(self, text: str | None) -> bytes:
        return b"".join(self.blocks(text or ""))


class Decoder:
    """State machine ids -> text: bytes of an unfinished character wait for the next ids."""

    def __init__(self, model: Model):
        self.model = model
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def push(self, ids: bytes) -> str:
        table = self.model.bytes_of
        found = [table[i] for i in np.frombuffer(ids, "<u4").tolist()]
        if not found:
            return ""
        data = self.model.between.join(found)
        if self.started:
            data = self.model.between + data
        self.started = True
        return self.utf8.decode(data)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def decode_ids(model: Model, ids: bytes | None) -> str:
    decoder = Decoder(model)
    parts = [decoder.push((ids or b"")[at:at + 4 * WINDOW]) for at in range(0, len(ids or b""), 4 * WINDOW)]
    return "".join([*parts, decoder.finish()])


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as a binary column of little-endian unsigned 32-bit integers."""

    def task():
        encoder = Encoder(load(tokenizer))
        return lambda batch: pa.array([encoder(x) for x in batch.to_pylist()], pa.binary())

    return df.withColumn(fresh(df, out)[0], per_text(task, "binary")(col(text)))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each binary id column, special tokens written out."""

    def task():
        model = load(tokenizer)
        return lambda batch: pa.array([decode_ids(model, x) for x in batch.to_pylist()], pa.string())

    return df.withColumn(fresh(df, out)[0], per_text(task, "string")(col(ids)))


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids binary, decoded string) of every row: encoded, then decoded again from the ids alone. Both run in
    one worker, so a task has one vocabulary in memory."""

    def task():
        model = load(tokenizer)
        encoder = Encoder(model)

        def apply(batch: pa.Array) -> pa.Array:
            ids = [encoder(x) for x in batch.to_pylist()]
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([decode_ids(model, x) for x in ids], pa.string())], ["ids", "decoded"])

        return apply

    coded = df.select(col(key).alias("doc_id"), per_text(task, "struct<ids binary, decoded string>")(col(text).cast("string")).alias("c"))
    return coded.select("doc_id", "c.ids", "c.decoded")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip`` rows."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

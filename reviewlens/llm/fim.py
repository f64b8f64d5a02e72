"""Fill-in-middle: texts cut at two token ranks and written in prefix-suffix-middle or suffix-prefix-middle order.

The tokens of a text lie in an indexable skip list. The lowest lane has a link for each token, each higher lane one link
for ``SPAN`` links of the lane below; every link carries the units (tokens), code points and bytes it passes. A search
for a rank starts on the top lane, follows links while the units passed stay within the rank, and goes down a lane where
the next link would pass it: at most ``SPAN - 1`` links on each of log(n) lanes, and the sums of the followed links are
the rank's code point and byte offset, exactly. Lanes are arrays built once for a text, so node heights are fixed by
position and nothing is left to chance.

Null texts are empty, an empty text is plain. Texts that hold a sentinel are plain, so every output can be undone from
itself and its form. The draw depends on the seed and the key alone, so repeated rows get the same cut; a null key draws
as the empty string. Whole texts are cut; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, col

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Links of one lane that a link of the next higher lane spans.
SPAN = 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class SkipList:
    """Tokens of one text as lanes of links; ``lanes[k]`` has three rows: units, code points and bytes of each link."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        blank = _SPACE[raw]
        # a token ends where a blank follows a visible character, and at the end of the text
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 if len(raw) else np.zeros(0, np.int64)
        if len(raw):
            ends = np.append(ends, len(raw))
        points = np.cumsum((raw & 0xC0) != 0x80)[ends - 1] if len(ends) else ends
        lane = np.stack([np.ones(len(ends), np.int64), np.diff(points, prepend=0), np.diff(ends, prepend=0)])
        self.lanes = [lane]
        while lane.shape[1] > SPAN:
            lane = np.add.reduceat(lane, np.arange(0, lane.shape[1], SPAN), axis=1)
            self.lanes.append(lane)
        self.units = len(ends)

    def find(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the unit of this rank, 0 to ``units``."""
        at = units = points = size = 0
        for lane in reversed(self.lanes):
            while at < lane.shape[1] and units + lane[0, at] <= rank:
                units, points, size = units + int(lane[0, at]), points + int(lane[1, at]), size + int(lane[2, at])
                at += 1
            at *= SPAN
        return points, size


def draws(key: Column, seed: int = 42) -> list[Column]:
    """Four stable numbers below 2^32 for each key: the first groups of eight hex digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


RESULT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _cut(text: bytes, h1: int, h2: int, h3: int, h4: int, rate: int, spm_rate: int) -> tuple:
    lanes = SkipList(text)
    n = lanes.units
    if not text or h3 % 100 >= rate or any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None  # the text itself is the output
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (p1, b1), (p2, b2) = lanes.find(low), lanes.find(high)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_rate:
        return n, "spm", p1, p2 - p1, b"".join([s, text[b2:], p, text[:b1], m, text[b1:b2]])
    return n, "psm", p1, p2 - p1, b"".join([p, text[:b1], s, text[b2:], m, text[b1:b2]])


def transform(df: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; ``rate`` and ``spm_rate`` are per cent."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            body = batch[0].cast(pa.binary())
            rows = max(1, SLICE_BYTES * len(body) // max(body.nbytes, 1))
            for at in range(0, len(body), rows):
                drawn = zip(body.slice(at, rows).to_pylist(), *(h.slice(at, rows).to_pylist() for h in batch[1:]))
                found = list(zip(*(_cut(*d, rate, spm_rate) for d in drawn)))
                columns = [pa.array(c, f.type) for c, f in zip(found[:-1], RESULT)] + [pa.array(found[-1], pa.binary()).cast(pa.string())]
                yield pa.StructArray.from_arrays(columns, fields=list(RESULT))

    cut = F.arrow_udf(run, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    named = df.select(col(key).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    done = named.withColumn("cut", cut(F.col("text"), *draws(F.col("doc_id"), seed)))
    return done.select("doc_id", "cut.n", "cut.form", "cut.prefix_chars", "cut.middle_chars", F.coalesce("cut.output", "text").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(done: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``transform`` rows."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))

"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small bit distance.

Pigeonhole: a fingerprint is cut into ``distance + 2`` blocks. Two fingerprints that differ in at most
``distance`` bits agree on at least two blocks, so every pair of blocks is a join key, long enough that unlike
fingerprints rarely share one; distances are then verified. Equal fingerprints are one row from the start.
Keys with many fingerprints are dealt to tiles (pairs of hashed halves of the group), so no task holds a whole
group, and each task gives back a spanning forest of its links, at most one row for each row read.

Null, empty and white texts have the fingerprint zero and link like any other; a text of fewer words than a
shingle is one shingle. Repeated rows are rows of their own. Rows without a doc_id get a fingerprint and the
component of their fingerprint (null if no other row shares or links it). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_bytes, col, fresh, per_text, stored
from .components import components, local_roots

BITS = 64
SEED = 42
#: Shingles that are hashed and counted at a time.
WINDOW = 1 << 15
#: Fingerprints of one key above which its group is dealt to tiles.
TILE = 4096


def _hashes(words: list[bytes], shingle: int) -> bytes:
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Fingerprint of lower-cased UTF-8 text: bit i is 1 if it is set in over half of the shingles' hashes."""
    words = (text or b"").split()  # bytes are cut at the six ASCII spaces only
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n, ones = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, WINDOW):
        raw = np.frombuffer(_hashes(words[at:min(at + WINDOW, n) + shingle - 1], shingle), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every row."""

    def task():
        return lambda batch: pa.array([fingerprint(x, shingle) for x in ascii_lower_bytes(batch)], pa.int64())

    return df.select(col(key).cast("bigint").alias("doc_id"), per_text(task, "bigint")(col(text).cast("string")).alias("fp"))


def _block_keys(distance: int):
    """Array of (which, key) for a column fp: its bits outside all but two blocks cleared."""
    n = distance + 2
    edges = [BITS * i // n for i in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    signed = [int.from_bytes((a | b).to_bytes(8, "big"), "big", signed=True) for a, b in combinations(masks, 2)]
    return F.array(*(F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))


def _links(distance: int):
    """Rows sorted by (which, key, tile) -> a spanning forest (a, b) of the links within each run of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            group = np.column_stack(columns[:3])
            last = np.flatnonzero((group[1:] != group[:-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
            held = [c[cut:] for c in columns]
            if cut:
                yield from _forest(group[:cut], columns[3][:cut], columns[4][:cut], distance)
        if held is not None and len(held[0]):
            yield from _forest(np.column_stack(held[:3]), held[3], held[4], distance)

    return run


def _forest(group: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    ends = np.r_[starts[1:], n][run_of]  # where each row's run ends
    roots, bits = np.arange(n), fp.view(np.uint64)
    at = np.arange(n)
    for gap in range(1, n):  # rows with the one ``gap`` further on, if it is in the same run
        at = at[at + gap < ends[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(bits[at] ^ bits[at + gap]) <= distance]
        if len(near):
            roots = local_roots(near, near + gap, roots)
    moved = np.flatnonzero(roots != np.arange(n))
    if len(moved):
        yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[roots[moved]])], ["a", "b"])


def link_components(distinct: DataFrame, distance: int = 3, tile: int = TILE) -> DataFrame:
    """(node, component) over the linked rows of ``distinct`` (fp bigint, rep bigint; each fp once)."""
    keyed = distinct.select("fp", "rep", F.explode(_block_keys(distance)).alias("k")).select("fp", "rep", "k.which", "k.key")
    sizes = keyed.groupBy("which", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    sizes = sizes.select(F.col("which").alias("w"), F.col("key").alias("k"), F.ceil(F.col("n") / tile).cast("int").alias("s"))
    sizes = stored(sizes, "simhash-keys")
    # fingerprints alone under their key drop out here: they have no partner in this block pair
    shared = keyed.join(sizes, (F.col("which") == F.col("w")) & (F.col("key") == F.col("k")))
    mine = F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("s")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda other: F.least(mine, other) * F.col("s") + F.greatest(mine, other))
    dealt = shared.select("which", "key", F.explode(tiles).alias("tile"), "fp", "rep")
    dealt = dealt.repartition("which", "key", "tile").sortWithinPartitions("which", "key", "tile", "rep")
    edges = dealt.select(*(F.col(c).cast("bigint") for c in ("which", "key", "tile", "fp", "rep"))).mapInArrow(_links(distance), "a bigint, b bigint")
    return components(edges, "simhash-components")


def near_duplicates(df: DataFrame, shingle: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row: the smallest doc_id that is reached over
    links of at most ``distance`` differing bits, itself included."""
    prints = stored(fingerprints(df, shingle, key, text), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    linked = link_components(distinct.where(F.col("rep").isNotNull()), distance)
    smallest = distinct.join(linked, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(smallest, F.col("fp") == F.col("of"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_print(text: str, shingle: int):
    """The fingerprint of a text column."""
    task = lambda: lambda batch: pa.array([fingerprint(x, shingle) for x in ascii_lower_bytes(batch)], pa.int64())
    return per_text(task, "bigint")(col(text).cast("string"))


def one_of_each(df: DataFrame, shingle: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component of fingerprints: one of its smallest doc_id, of several such rows the one
    with the least fingerprint, then text, then other columns. Rows without an id stay.

    Unlike texts that share an id are judged each by their own fingerprint, so no text goes that nothing else stands for.
    Only rows that repeat an id are looked at by themselves again; texts are neither stored nor shuffled, but for those."""
    id_, fp_, other_ = fresh(df, "_id", "_fp", "_fp2")
    prints = fingerprints(df, shingle, key, text).where("doc_id is not null").groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    prints = stored(prints, "simhash-rows")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    linked = link_components(distinct.select("fp", F.col("fp").alias("rep")), distance)
    found = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("id", "fp", F.coalesce("component", "fp").alias("component"))
    chosen = found.groupBy("component").agg(F.min(F.struct("id", "fp")).alias("c"))
    chosen = stored(chosen.select(F.col("c.id").alias(id_), F.col("c.fp").alias(fp_)), "simhash-chosen")
    per_id = prints.groupBy("doc_id").agg(F.sum("n").alias("n"))
    repeated = stored(per_id.where("n > 1").select(F.col("doc_id").alias(id_)), "simhash-repeated")
    gone = per_id.where("n = 1").select(F.col("doc_id").alias(id_)).join(chosen.select(id_), id_, "left_anti")
    same_id = col(key).cast("bigint") == col(id_)
    kept = df.join(gone, same_id, "left_anti")
    if not repeated.head(1):
        return kept
    again = df.join(repeated, same_id, "left_semi").withColumn(other_, _row_print(text, shingle))
    mine = again.join(chosen, same_id & (col(other_) == col(fp_)), "left_semi")
    row = F.min(F.struct(*(col(c) for c in [text, *(c for c in df.columns if c != text)]))).alias("row")
    least = mine.groupBy(col(key).cast("bigint").alias(id_), col(other_)).agg(row)
    single = least.select(*(F.col("row").getField(c).alias(c) for c in df.columns))
    return kept.join(repeated, same_id, "left_anti").unionByName(single)

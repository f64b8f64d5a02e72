"""Filter interaction audit: what each filter removes in every order in which the filters can be applied.

Each document's failures are one bit mask. Documents are counted by (part, mask, labels), and each such *mask cell* is
folded over the array of all orders with higher-order SQL functions: ``transform`` walks the orders, ``aggregate`` the
filters of one order, and a cell gives one weighted struct for each order and step (600 for five filters). The structs of
a part's cells are merged by sums, position by position. The orders are a literal of the plan, ``n!`` arrays of ``n``
numbers, so every task has them; their number depends on the filters alone.

Identical texts share their mask, so the table-wide filter needs no group of equal texts in one place: rows are counted
by (digest of the text, part, labels) with their least key before they are shuffled, and the digest's least key is then
joined to these counts.

Null and empty texts are the empty text, a null part is the empty string. Rows without a key are never later copies and
make nothing else one. Rows that repeat a key count each; they are no copies of each other, but of smaller keys. Of
several labels of one key any 1 counts; labels without a key are not read. A table without rows gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, stored

WORD = r"[^\x20\x09-\x0D]+"
#: What is counted at each step of each order.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of one text by filter: too short, too repetitive, too many capitals, odd marks."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(df: DataFrame, labels: DataFrame, filters: Callable[[Column, Column], dict[str, Column]] = text_filters,
          key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by failures and labels. Bit i of ``mask`` is the i-th filter; the last
    bit is "identical to the text of a smaller key"."""
    body = df.select(col(key).cast("bigint").alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"),
                     F.coalesce(col(text).cast("string"), F.lit("")).alias("body"))
    split = body.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), 0))
    failed = list(filters(F.col("body"), F.col("words")).values())
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    rows = split.select("id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.select(col("doc_id").cast("bigint").alias("of"), (col("quality") == 1).alias("q"), (col("toxic") == 1).alias("t")).where("of is not null")
    known = known.groupBy("of").agg(F.coalesce(F.max("q"), F.lit(False)).alias("q"), F.coalesce(F.max("t"), F.lit(False)).alias("t"))
    known = known.select(F.col("of").cast("string").alias("of"), "q", "t")
    # rows without a key are spread by their text and meet no label
    met = rows.withColumn("k", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.hex("digest")))).join(known, F.col("k") == F.col("of"), "left")
    met = met.select("id", "part", "digest", "mask", "n", F.coalesce("q", F.lit(False)).cast("int").alias("good"), F.coalesce("t", F.lit(False)).cast("int").alias("toxic"))
    has_id = F.col("id").isNotNull()
    least = F.min(F.when(has_id, F.struct("id", "n"))).alias("least")
    texts = met.groupBy("digest", "mask", "part", "good", "toxic").agg(
        least, F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("n_bare"))
    texts = stored(texts, "audit-texts")
    first = texts.groupBy(F.col("digest").alias("same")).agg(F.min("least.id").alias("first"))
    ahead = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    copied = 1 << len(failed)
    sides = F.array(F.struct(F.col("mask").alias("mask"), (ahead + F.col("n_bare")).alias("n")),
                    F.struct(F.col("mask").bitwiseOR(F.lit(copied)).alias("mask"), (F.col("n") - ahead).alias("n")))
    both = texts.join(first, F.col("digest") == F.col("same")).select("part", "good", "toxic", F.explode(sides).alias("side"))
    return both.where("side.n > 0").groupBy("part", F.col("side.mask").alias("mask"), "good", "toxic").agg(F.sum("side.n").alias("n"))


def _walk(order: Column, mask: Column, good: Column, toxic: Column, n: Column) -> Column:
    """One order folded over one cell: an array with a struct of COUNTS for each step."""
    zero = F.lit(0).cast("bigint")

    def step(state: Column, bit: Column) -> Column:
        fails, gone = mask.bitwiseAND(bit) != 0, state["gone"]
        removed = fails & ~gone
        counted = {"kept": ~fails & ~gone, "removed": removed, "redundant": fails & gone, "unique_fails": mask == bit,
                   "good_lost": removed & (good == 1), "toxic_lost": removed & (toxic == 1)}
        weighted = F.struct(*(F.when(counted[c], n).otherwise(zero).alias(c) for c in COUNTS))
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(weighted)).alias("steps"))

    kinds = ",".join(f"{c}:bigint" for c in COUNTS)
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<struct<{kinds}>>").alias("steps"))
    return F.aggregate(order, start, step, lambda state: state["steps"])


def fold(counted: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley) of ``cells`` rows: one row for each part, order and step."""
    orders = list(permutations(range(len(letters))))
    bits = F.array(*(F.array(*(F.lit(1 << i) for i in order)) for order in orders))
    names = F.array(*(F.lit("".join(letters[i] for i in order)) for order in orders))
    walks = F.flatten(F.transform(bits, lambda order: _walk(order, F.col("mask"), F.col("good"), F.col("toxic"), F.col("n"))))
    each = counted.select("part", F.posexplode(walks).alias("at", "w"))
    merged = each.groupBy("part", "at").agg(*(F.sum(f"w.{c}").alias(c) for c in COUNTS))
    n = len(letters)
    placed = merged.withColumn("filter_order", F.element_at(names, (F.floor(F.col("at") / n) + 1).cast("int"))).withColumn("step", (F.col("at") % n + 1).cast("int"))
    # the rows of one part and filter: one for each order
    same = W.partitionBy("part", F.substr("filter_order", F.col("step"), F.lit(1)))
    return placed.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(same).alias("shapley"))


def audit(df: DataFrame, labels: DataFrame, letters: str = "ABCDE", **columns: str) -> DataFrame:
    """The audit of ``text_filters`` and the table-wide copy filter over ``df``, parts by language."""
    return fold(cells(df, labels, **columns), letters)

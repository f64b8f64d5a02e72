"""Secret scans: rules, and Shannon entropy over sliding windows. DataFrame functions only, one pass, no shuffle.

Base spans come from three rules (``assign``, ``access``, ``hex``), leftmost and non-overlapping for each. The method adds
spans: candidate strings (runs of key characters with a letter and a digit) belong to the narrowest character class that
holds them; a window slides over the candidate, and the entropy of its characters is kept up by counts: the character that
enters raises one count, the one that leaves lowers another, and the sum of n log2 n changes by these two terms only.
Windows at or above the class's threshold make spans (overlapping ones are joined) unless the candidate is on the
allow-list. The allow-list never takes a base span away.

Positions are code points, ends exclusive. Null and empty texts have no spans. Rows are independent: repeated rows give
repeated results, other columns are not read (``redact`` carries them along).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

# The base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What a text with an assignment holds, quicker to look for.
ASSIGN_HINT = r"""[PpSsTtAa](?i:assword|asswd|ecret|oken|pi_?key)["']?\x20*[:=]"""
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_key"]

KEY = "A-Za-z0-9+/_-"
#: Runs of key characters with a digit and a letter, from the length of a window on.
CANDIDATE = rf"(?<![{KEY}])(?=[{KEY}]*[0-9])(?=[{KEY}]*[A-Za-z])[{KEY}]{{20,}}"
HEX_ONLY = r"^(?:[0-9a-f]+|[0-9A-F]+)$"
WINDOW = 20
#: Bits for each class; no window's entropy comes near these values without passing them.
HEX_BITS, KEY_BITS = 3.051, 3.851
#: Candidates that are no secrets: UUIDs, words joined by dashes, underscores or slashes, placeholders, runs of one sequence.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?(?:[a-z]+[0-9]{0,4}|[0-9]{1,4}|[A-Z][a-z]+)(?:[_/-]+(?:[a-z]+[0-9]{0,4}|[0-9]{1,4}|[A-Z][a-z]+))+[_/-]*$",
    r"(?i:example|sample|dummy|placeholder|changeme)",
    r"(?i:0123456789abcdef|abcdefghijklmnop|1234567890)",
]

_SPAN = "array<struct<start: int, kind: int, end: int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Array of struct(start, value) of a pattern's matches; what lies between them gives their places."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.filter(
        F.zip_with(pieces, found, lambda a, b: F.struct(F.char_length(a).alias("skip"), F.char_length(b).alias("n"), b.alias("value"))),
        lambda x: x["n"].isNotNull())
    kind = "array<struct<start: int, value: string>>"
    start = F.struct(F.lit(0).alias("at"), _empty(kind).alias("out"))
    walked = F.aggregate(steps, start, lambda acc, x: F.struct(
        (acc["at"] + x["skip"] + x["n"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), x["value"].alias("value")))).alias("out")))
    return F.when(text.rlike(hint or pattern), walked["out"]).otherwise(_empty(kind))


def _spans(matches: Column, kind: int, holds: Callable[[Column], Column] | None = None) -> Column:
    kept = F.filter(matches, lambda m: holds(m["value"])) if holds else matches
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["value"])).alias("end")))


def _high_windows(value: Column, bits: Column, window: int) -> Column:
    """Joined spans (start, end), from the start of ``value``, of the windows with at least ``bits`` bits of entropy."""
    logs = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)))
    low, slots = ord("+"), ord("z") - ord("+") + 1
    kind = "array<struct<start: int, end: int>>"
    start = F.struct(F.array_repeat(F.lit(0), slots).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(-1).alias("to"), _empty(kind).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        counts, enters, leaves = acc["counts"], x["enters"], x["leaves"]
        more, less = F.get(counts, enters), F.get(counts, leaves)
        added = F.get(logs, more + 1) - F.get(logs, more)
        taken = F.when(leaves.isNull(), F.lit(0.0)).otherwise(F.get(logs, less - 1) - F.get(logs, less))
        same = F.coalesce(enters == leaves, F.lit(False))
        total = F.when(same, acc["sum"]).otherwise(acc["sum"] + added + taken)
        moved = F.when(same, counts).otherwise(F.transform(counts, lambda n, k: n + F.when(k == enters, 1).when(k == leaves, -1).otherwise(0)))
        high = (x["end"] >= window) & (F.lit(math.log2(window)) - total / window >= bits)
        first = x["end"] - window
        joins = first <= acc["to"]
        return F.struct(
            moved.alias("counts"), total.alias("sum"),
            F.when(high & ~joins, first).otherwise(acc["from"]).alias("from"),
            F.when(high, x["end"]).otherwise(acc["to"]).alias("to"),
            F.when(high & ~joins & (acc["to"] >= 0), F.concat(acc["done"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))).otherwise(acc["done"]).alias("done"))

    codes = F.transform(F.regexp_extract_all(value, F.lit("."), F.lit(0)), lambda c: F.ascii(c) - low)
    steps = _let(codes, lambda all_: F.transform(all_, lambda c, i: F.struct(
        c.alias("enters"), F.when(i >= window, F.get(all_, i - window)).alias("leaves"), (i + 1).alias("end"))))
    last = F.aggregate(steps, start, step, lambda acc: F.when(acc["to"] >= 0, F.concat(
        acc["done"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))).otherwise(acc["done"]))
    return last


def _entropy_spans(candidates: Column, window: int, hex_bits: float, key_bits: float, allowed: list[str]) -> Column:
    def listed(value: Column) -> Column:
        hit = F.lit(False)
        for pattern in allowed:
            hit = hit | value.rlike(pattern)
        return hit

    def of(m: Column) -> Column:
        narrow = m["value"].rlike(HEX_ONLY)
        found = _high_windows(m["value"], F.when(narrow, F.lit(hex_bits)).otherwise(F.lit(key_bits)), window)
        kind = F.when(narrow, F.lit(KINDS.index("entropy_hex"))).otherwise(F.lit(KINDS.index("entropy_key")))
        return F.transform(found, lambda s: F.struct((m["start"] + s["start"]).alias("start"), kind.alias("kind"), (m["start"] + s["end"]).alias("end")))

    return F.flatten(F.transform(F.filter(candidates, lambda m: ~listed(m["value"])), of))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, hex_bits: float = HEX_BITS,
         key_bits: float = KEY_BITS, allowed: list[str] | None = None) -> DataFrame:
    """(doc_id, text, base, added) of every row; ``base`` and ``added`` are sorted arrays of (start, kind, end), the kind
    being an index of KINDS."""
    named = df.select(col(key).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    return _scanned(named, "text", "base", "added", window, hex_bits, key_bits, ALLOWED if allowed is None else allowed)


def _scanned(df: DataFrame, text: str, base: str, added: str, window: int, hex_bits: float, key_bits: float, allowed: list[str]) -> DataFrame:
    value = col(text)
    assigned = _spans(_matches(value, ASSIGN, ASSIGN_HINT), 0, lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 6)
    spans = F.concat(assigned, _spans(_matches(value, ACCESS), 1), _spans(_matches(value, HEX), 2))
    more = _entropy_spans(_matches(value, CANDIDATE), window, hex_bits, key_bits, allowed)
    return df.withColumns({base: F.array_sort(spans.cast(_SPAN)), added: F.array_sort(more.cast(_SPAN))})


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan`` rows."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark`` (overlapping spans by one); null texts stay null."""
    from .common import fresh

    whole, base, added, spans = fresh(df, "_whole", "_base", "_added", "_spans")
    named = df.withColumn(whole, F.coalesce(col(text).cast("string"), F.lit("")))
    found = _scanned(named, whole, base, added, WINDOW, HEX_BITS, KEY_BITS, ALLOWED)
    found = found.withColumn(spans, F.array_sort(F.concat(col(base), col(added)))).drop(base, added)
    value = col(whole)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] >= acc["at"], F.array(F.substring(value, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    # of spans that touch or overlap only the first leaves a mark: the others start before the end so far
    cut = F.aggregate(col(spans), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(value, acc["at"] + 1, F.char_length(value))))
    new = F.when(F.size(col(spans)) > 0, cut).otherwise(col(text))
    return found.withColumn(text, new).select(*map(col, df.columns))

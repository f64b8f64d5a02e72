"""Token counts: totals by source, language and tokenizer version, kept up by signed deltas.

A batch is a table of changes (insert, delete, revise) with an id. Applying it looks up what its documents count for so
far, turns each change into signed deltas (docs, tokens), writes these to the ledger, and then the batch's own totals;
the success marker of this last write is the commit. A batch id that is committed is not applied again, and what an
attempt that died has left is overwritten by the next. Totals are the sum over the committed batches' totals: a few rows
each, so reading them does not touch documents.

A document counts once for each tokenizer version. Rows that share a doc_id, or have none, are told apart by the
changes' optional ``copy`` number, and a change can stand for several like rows (optional ``docs``; ``tokens`` is that of
one): a caller with repeated ids sends both, and every row counts. An insert of one that counts already, and a delete or revision of one
that does not, change nothing. Of several changes of one document in a batch the one with the greatest ``seq`` holds (then the
greatest op, tokens, source, language). A revision takes the new source and language. A null id is an id like another, null sources and
languages are groups, null tokens are 0. Hot sources are summed on the map side. Changes' other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
LEDGER = "doc_id bigint, version string, source string, lang string, docs bigint, tokens bigint"
_LEDGER = f"{LEDGER}, copy bigint"
_ENTRY = ["doc_id", "version", "copy", "source", "lang"]
TOTALS = "source string, lang string, version string, docs bigint, tokens bigint"
OPS = ["insert", "delete", "revise"]


class TokenRollup:
    """A rollup in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _list(self) -> list[str]:
        jvm, path = self.spark.sparkContext._jvm, f"{self.path}/totals"
        if not self._exists(path):
            return []
        target = jvm.org.apache.hadoop.fs.Path(path)
        found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
        return sorted(s.getPath().getName() for s in found)

    def committed(self) -> list[str]:
        return [b for b in self._list() if self._exists(f"{self.path}/totals/{b}/_SUCCESS")]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """(doc_id, version, source, lang, tokens, docs, copy) of what counts now; tokens of all its rows."""
        held = self._read("ledger", _LEDGER).withColumn("copy", _number("copy", 0))
        sums = held.groupBy(*_ENTRY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where(F.col("docs") > 0).select("doc_id", "version", "source", "lang", "tokens", "docs", "copy")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens); groups with no document left are gone."""
        sums = self._read("totals", TOTALS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where(F.col("docs") > 0)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, version, op, source, lang, tokens, optional seq, copy and docs) as ``batch``;
        False if it is committed already."""
        if self._exists(f"{self.path}/totals/{batch}/_SUCCESS"):
            return False
        given = lambda name, default: _number(name, default) if name in changes.columns else F.lit(default).cast("bigint")
        docs = given("docs", 1)
        last = F.max(F.struct(given("seq", 0).alias("seq"), F.col("op"), (docs * given("tokens", 0)).alias("tokens"), F.col("source"), F.col("lang"), docs.alias("docs"))).alias("c")
        new = changes.where(F.col("op").isin(OPS)).groupBy(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("version").cast("string").alias("version"), given("copy", 0).alias("copy")).agg(last)
        new = new.select("doc_id", "version", "copy", *(F.col(f"c.{c}").alias(c) for c in ("op", "source", "lang", "tokens", "docs")))
        old = self.documents().select(*(F.col(c).alias(f"old_{c}") for c in ("doc_id", "version", "source", "lang", "tokens", "docs", "copy")))
        if self.committed():
            same = F.col("doc_id").eqNullSafe(F.col("old_doc_id")) & F.col("version").eqNullSafe(F.col("old_version")) & (F.col("copy") == F.col("old_copy"))
            both = new.join(old, same, "left")
        else:
            none = {c: F.lit(None).cast(kind) for c, kind in (("old_source", "string"), ("old_lang", "string"), ("old_tokens", "bigint"), ("old_docs", "bigint"))}
            both = new.withColumns(none)
        counts = F.col("old_tokens").isNotNull()
        op = F.col("op")
        out, into = _delta(-1, "old_").alias("d"), _delta(1, "").alias("d")
        moves = F.when((op == "insert") & ~counts, F.array(into)).when((op == "delete") & counts, F.array(out)).when((op == "revise") & counts, F.array(out, into))
        deltas = both.select("doc_id", "version", "copy", F.explode(moves).alias("d")).select("doc_id", "version", "copy", "d.source", "d.lang", "d.docs", "d.tokens")
        deltas = deltas.groupBy(*_ENTRY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.where((F.col("docs") != 0) | (F.col("tokens") != 0)).write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        written = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{batch}")
        written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        return True


def _number(name: str, default: int) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(default).cast("bigint"))


def _delta(sign: int, prefix: str) -> Column:
    return F.struct(F.col(f"{prefix}source").alias("source"), F.col(f"{prefix}lang").alias("lang"), *((F.lit(sign) * F.col(prefix + c)).alias(c) for c in ("docs", "tokens")))

"""Lookups in model tables beyond the broadcast bounds: frequent keys stay where they are, the others are shuffled once."""

import os
import re
import sys

import duckdb
import pytest
from conftest import ROOT, SF_SMALL
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(ROOT, "tools"))
from oracle_check import digest  # noqa: E402
from reviewlens.operators import lineage  # noqa: E402
from reviewlens.plans import catalog, models  # noqa: E402


@pytest.fixture()
def skewed(spark):
    """A third of all rows hold one word; the table has 3,000 words, each with the number of its rows."""
    left = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, F.lit("the")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("w"), (F.col("id") % 2999).cast("string"))).alias("word"))
    table = left.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where("word <> 'w7'")
    return left, lineage.write_table(table, "lookup-test")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("most", [1, 50, 100_000])
def test_lookup_equals_a_join(skewed, monkeypatch, how, most):
    left, table = skewed
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", most)
    got = lineage.lookup(left, table, "word", table.count(), F.col("n"), how)
    want = left.join(table, "word", how)
    assert sorted(map(str, got.select("id", "word", "n").collect())) == sorted(map(str, want.select("id", "word", "n").collect()))


def test_frequent_keys_enter_no_shuffle(spark, skewed, monkeypatch):
    left, table = skewed
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 50)
    hot = lineage.stored_hot(table, F.col("n"))
    words = [r.word for r in hot.collect()]
    assert "the" in words and len(words) <= 50
    got = lineage.lookup(left, table, "word", table.count(), F.col("n"))
    previous = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", previous)
    # one exchange of the other words' rows and one of the table's, both by word
    assert len(re.findall(r"Exchange hashpartitioning\(word", plan)) == 2
    assert plan.count("Exchange hashpartitioning") == 2 and "Cartesian" not in plan


def test_bytes_in_memory_bound_a_broadcast(spark, monkeypatch):
    table = lineage.write_table(spark.range(20).select(F.repeat(F.lit("x"), 10_000).alias("word"), "id"), "wide-words")
    assert lineage.memory_bytes(table) == 20 * (10_000 + lineage.ROW_BYTES + 8)
    assert lineage.fits_broadcast(table, 20)
    monkeypatch.setattr(lineage, "MAX_BROADCAST_BYTES", 100_000)
    assert not lineage.fits_broadcast(table, 20)
    assert lineage.fits_broadcast(lineage.stored_hot(table, F.col("id")), 20)


@pytest.mark.parametrize("name", ["score_nb", "tfidf", "encode_sequence", "score_conversations_nb"])
def test_queries_stay_green_beyond_the_bounds(spark, monkeypatch, name):
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 1_000)
    monkeypatch.setattr(models, "_CACHE", {})
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF_SMALL)
    want = con.sql(catalog.ORACLE[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(want.columns, want.fetchall())[0]


def test_empty_sides(spark, skewed, monkeypatch):
    left, table = skewed
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 50)
    assert lineage.lookup(left.limit(0), table, "word", table.count(), F.col("n")).count() == 0
    none = lineage.lookup(left, table.limit(0), "word", 3000, F.col("n"))
    assert none.count() == 9000 and none.where("n is not null").count() == 0

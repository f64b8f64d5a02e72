"""Repeated and null ids, clashing columns and empty tables in rollups, de-duplication and the pipeline; few labels."""

import duckdb
import corpus_pipeline
import pytest
from conftest import SF_SMALL as SF
from llm_fixtures import nothing, odd  # noqa: F401
from pyspark.sql import functions as F

from reviewlens.llm import catalog, rollup, simhash, toxicity
from reviewlens.llm.common import crc_mod

X, Y = "first text about one thing and more words of it", "an unlike text that says something else again today"


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(map(tuple, simhash.one_of_each(df).collect()), key=str)


def test_no_text_of_a_repeated_id_is_lost(spark):
    assert kept(spark, [(5, X), (5, Y), (3, Y)]) == [(3, Y), (5, X)]
    assert kept(spark, [(5, X), (5, Y), (3, Y), (3, X)]) == [(3, Y), (3, X)]


def test_two_components_of_one_id_each_keep_a_row(spark):
    """Two unlike texts under one id, of which nothing else stands for either, both stay."""
    assert kept(spark, [(5, X), (5, Y)]) == sorted([(5, X), (5, Y)])


def test_repeated_rows_leave_one(spark):
    assert kept(spark, [(1, X), (1, X), (2, X), (4, Y), (4, Y)]) == [(1, X), (4, Y)]
    assert kept(spark, [(None, X), (1, X), (None, X)]) == [(1, X), (None, X), (None, X)]
    assert kept(spark, []) == []


def test_one_of_each_keeps_a_row_for_each_text(spark, odd):
    """Every dropped row has its fingerprint, or one linked to it, among the rows that stay."""
    one = simhash.one_of_each(odd).where("doc_id is not null")
    stay = [simhash.fingerprint((r.text or "").lower().encode()) for r in one.collect()]
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    assert one.columns == odd.columns and all(not near(a, b) for i, a in enumerate(stay) for b in stay[:i])
    for r in odd.where("doc_id is not null").collect():
        assert any(near(simhash.fingerprint((r.text or "").lower().encode()), f) for f in stay)


def test_links_of_nodes_over_the_whole_range(spark):
    """Fingerprints as nodes: sums of some of them are beyond 64 bits."""
    from reviewlens.llm.components import components
    big = (1 << 63) - 1
    edges = spark.createDataFrame([(big - i, big - i - 1) for i in range(8)] + [(-big, -big + 1)], "a bigint, b bigint")
    got = {(r.node, r.component) for r in components(edges).collect()}
    assert got == {(big - i, big - 8) for i in range(9)} | {(-big, -big), (-big + 1, -big)}


# ---------------------------------------------------------------- rollup

def test_rows_that_share_an_id_count_each(spark, tmp_path):
    kept = rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = [(1, 0, 2, "v", "insert", "a", "en", 10), (1, 7, 1, "v", "insert", "b", "en", 3), (None, 5, 3, "v", "insert", "a", "en", 4), (None, 6, 1, "v", "insert", "a", "fr", 1)]
    send = lambda batch, rows: kept.apply(batch, spark.createDataFrame(rows, "doc_id bigint, copy bigint, docs bigint, version string, op string, source string, lang string, tokens bigint"))
    total = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in kept.totals().collect()}
    assert send("1", rows) and total() == {("a", "en"): (5, 32), ("b", "en"): (1, 3), ("a", "fr"): (1, 1)}
    assert send("2", [(1, 0, 2, "v", "delete", "", "", 0), (None, 5, 3, "v", "revise", "c", "en", 5)])
    assert total() == {("b", "en"): (1, 3), ("a", "fr"): (1, 1), ("c", "en"): (3, 15)}


def test_op9_counts_rows_as_its_sql_does(spark, tmp_path):
    """Repeated ids with like and unlike rows, null ids, and columns named like the query's own."""
    docs = [(i, f"word{i} a b c\nline\nline", "en" if i % 3 else None, f"s{i % 2}") for i in range(40)]
    docs += docs[:15] + [(i, "other text", "fr", "s0") for i in range(10, 20)] + [(None, t, None, "s1") for t in ("x y", "x y", "z", None)]
    df = spark.createDataFrame([(*d, 1, "c", 2) for d in docs], "doc_id bigint, text string, lang string, source string, `of` int, copy string, docs int")
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(0, 40, 3)] + [(None, 0, 1)], "doc_id bigint, quality int, toxic int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = catalog.op9_token_counts(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toArrow())
    con.register("labels", labels.toArrow())
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE['op9_token_counts']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


# ---------------------------------------------------------------- toxicity

def test_twelve_labels_are_learned_from(spark):
    """A word that settles the label, in a handful of rows that lie in some of the shards only."""
    rows = [(i, f"some words w{i % 5} here " + ("vile" if i % 2 else "nice"), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = toxicity.classify(df.drop("toxic"), df.where("doc_id < 12").select("doc_id", "toxic"), crc_mod("doc_id", 5) == 0).collect()
    assert len({round(r.score, 3) for r in got}) > 1
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 45


# ---------------------------------------------------------------- pipeline

def test_pipeline_on_an_empty_table(spark, nothing, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = nothing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert docs.columns == nothing.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0

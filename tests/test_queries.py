"""Every registered query runs over the sf0.001 tables; where an oracle SQL
exists, DuckDB on the same parquet files gives the same rows."""

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402
from reviewlens.plans import catalog  # noqa: E402
from reviewlens.sources.tables import TABLES  # noqa: E402


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns


# Fitted by iteration from random starting weights, so SQL cannot repeat their numbers. The operators behind
# them are checked by SQL through the queries of plans/checked.py and by unit tests.
WITHOUT_SQL = {
    "fit_svd", "svd_project", "fit_gbt", "score_gbt", "fit_gru", "score_gru", "score_all", "vote",
    "class_distribution_vote", "top_tokens_vote", "evaluate_all", "score_stream", "class_distribution_gbt",
    "top_tokens_gbt", "class_distribution_gru", "top_tokens_gru", "score_conversations",
    "timing_table",  # measured seconds
}


def test_every_query_has_a_callable_and_oracles_are_known_keys():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


def test_only_the_named_queries_lack_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == WITHOUT_SQL


@pytest.mark.parametrize("name", list(E.queries()))
def test_query_against_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        # one row per document at least, or a fitted table that is not empty
        assert rows and len(rows[0]) == len(df.columns)
        return
    rel = duck.sql(sql)
    cols = rel.columns
    assert sorted(cols) == sorted(df.columns)
    duck_types = dict(zip(cols, (str(t) for t in rel.types)))
    for f in df.schema.fields:
        assert SPARK_TO_DUCK.get(f.dataType.simpleString()) == duck_types[f.name], f.name
    assert digest(df.columns, rows)[0] == digest(cols, rel.fetchall())[0]

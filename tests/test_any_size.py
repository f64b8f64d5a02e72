"""Row scores of models beyond the broadcast bounds: made by joins, with the columns and rows of the others."""

import os
import sys

import duckdb
import pytest
from conftest import ROOT, SF_SMALL
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(ROOT, "tools"))
from oracle_check import digest  # noqa: E402
from reviewlens.operators import lineage, rowwise  # noqa: E402
from reviewlens.plans import catalog, checked, models  # noqa: E402, F401
from reviewlens.streaming.score_stream import score_rows_stream  # noqa: E402


@pytest.mark.parametrize("name", ["score_rows_nb", "stream_rows_nb", "observed_scoring"])
def test_queries_score_beyond_the_bounds(spark, monkeypatch, name):
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 1_000)
    monkeypatch.setattr(models, "_CACHE", {})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = catalog.QUERIES[name](spark, SF_SMALL)
    want = con.sql(catalog.ORACLE[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(want.columns, want.fetchall())[0]


def test_row_scores_by_joins_have_the_same_columns_and_rows(spark, monkeypatch, tmp_path):
    words = ["bagus puas cepat", "rusak lambat jelek"]
    rows = [(i, f"{words[i % 2]} barang{i % 7}", i % 2) for i in range(60)]
    fitted = models.fit_models(spark.createDataFrame(rows, "doc_id long, text string, score int"), k=3, maxlen=6, epochs=1, trees=2)
    # no key at all, rows that come twice, a missing text, a name with a dot
    df = spark.createDataFrame([(t, i) for i, t in enumerate(["bagus", "rusak", "rusak", None, "", "ﬁ puas"])] + [("bagus", 0)], "Ulasan string, `Shop.Id` long")
    within = rowwise.score_any_rows(df, fitted)
    want = within.collect()
    df.write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 3)
    assert rowwise.RowScorer.of(fitted) is None
    beyond = rowwise.score_any_rows(df, fitted)
    assert beyond.dtypes == within.dtypes
    near = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert near(beyond.collect()) == near(want)
    with pytest.raises(ValueError, match="Pred_NB"):
        rowwise.score_any_rows(df.withColumn("Pred_NB", F.lit(1)), fitted)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    score_rows_stream(stream, fitted, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert near(spark.read.parquet(str(tmp_path / "out")).select(*(f"`{c}`" for c in beyond.columns)).collect()) == near(want)

"""Row-wise scoring: equal to the joins, one task for a review, failing rows apart from the others, streams."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import lineage, rowwise, scoring
from reviewlens.plans.models import fit_models
from reviewlens.streaming.score_stream import score_rows_stream

GOOD, BAD = "bagus cepat mantap puas sekali".split(), "rusak lambat kecewa jelek buruk".split()


@pytest.fixture(scope="module")
def reviews(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        y = i % 2
        own = list(rng.choice(GOOD if y else BAD, 4)) + list(rng.choice("barang toko kirim produk".split(), 5))
        rows.append((i, " ".join(rng.permutation(own)), y))
    rows += [(200, None, None), (201, "", None), (202, "@toko http://x.y ！ﬁ", None), (203, "bagus " * 400, None), (204, "bagus rusak", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


@pytest.fixture(scope="module")
def models(reviews):
    return fit_models(reviews.where("score is not null"), k=4, maxlen=8, epochs=2, trees=4)


def test_equals_the_scores_by_joins(reviews, models):
    filled = reviews.withColumn("text", F.coalesce("text", F.lit("nan")))
    want = {r.doc_id: r for r in scoring.score_reviews(filled, models).collect()}
    got = rowwise.score_rows(reviews, models).collect()
    assert len(got) == len(want) == 125
    for r in got:
        w = want[r.doc_id]
        for m in ("nb", "gbt", "gru"):
            assert abs(r[f"prob_{m}"] - w[f"prob_{m}"]) < 1e-9 and r[f"score_ok_{m}"] and r[f"score_error_{m}"] is None
            assert r[f"pred_{m}"] == w[f"pred_{m}"] or abs(w[f"prob_{m}"] - 0.5) < 1e-9
            assert r[f"label_{m}"] == ("Positif" if r[f"pred_{m}"] else "Negatif") and abs(r[f"percent_{m}"] - 100 * r[f"prob_{m}"]) <= 0.5
        assert r.pred_vote == int(r.pred_nb + r.pred_gbt + r.pred_gru >= 2)
    assert sum(r.pred_nb == r.score for r in got if r.score is not None) > 110


def test_one_review_is_one_row_of_one_task(spark, models):
    df = rowwise.score_review(spark, "bagus sekali, puas", models)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "Join" not in plan
    assert df.rdd.getNumPartitions() == 1
    row = df.first()
    assert row.label_nb == "Positif" and 0 <= row.percent_gru <= 100
    with pytest.raises(ValueError):
        rowwise.score_review(spark, " \n", models)


def test_a_failing_row_fails_alone(reviews, models):
    def picky(batch):
        texts = [" ".join(t or []) for t in batch.column(rowwise.WORDS).to_pylist()]
        if any("bagus rusak" in t for t in texts):
            raise RuntimeError("poisoned")
        return np.ones(len(texts), np.int32), np.full(len(texts), 0.75)

    df = rowwise.score_rows(reviews.coalesce(1), models, kernels={"own": picky}).collect()
    bad = [r for r in df if not r.score_ok_own]
    assert bad and all("bagus rusak" in (r.text or "") for r in bad) and 204 in {r.doc_id for r in bad}
    assert all((r.pred_own, r.prob_own, r.score_error_own) == (0, 0.0, "RuntimeError: poisoned") for r in bad)
    assert all(r.prob_own == 0.75 and r.score_error_own is None for r in df if r.score_ok_own)
    assert all(r.score_ok_nb and r.score_ok_gru for r in df) and len(df) == 125


def test_halving_calls_few_kernels():
    calls = []

    def kernel(batch):
        calls.append(len(batch))
        values = batch.column(0).to_numpy()
        if (values == 7).any():
            raise KeyError("seven")
        return values, values / 2.0

    batch = pa.RecordBatch.from_arrays([pa.array(range(256))], ["x"])
    labels, probs, errors = rowwise.isolated(kernel, batch)
    assert labels == [None if i == 7 else i for i in range(256)] and errors[7] == "KeyError: 'seven'" and len(calls) == 17
    assert [e for e in errors if e] == [errors[7]]
    wrong = rowwise.isolated(lambda b: (np.zeros(1), np.zeros(1)), batch.slice(0, 2))
    assert wrong[0] == [0.0, 0.0]  # a wrong number of scores is a failure of the batch, not of its rows


def test_names_are_resolved_and_inputs_kept(spark, models):
    df = spark.createDataFrame([("x", "bagus puas", 1.5), ("y", None, None)], "`Shop.Id` string, Ulasan string, price double")
    got = rowwise.score_rows(df, models)
    assert got.columns[:3] == ["Shop.Id", "Ulasan", "price"] and {r["Shop.Id"] for r in got.collect()} == {"x", "y"}
    assert rowwise.score_rows(df.limit(0), models).count() == 0
    with pytest.raises(ValueError, match="Pred_NB"):
        rowwise.score_rows(df.withColumn("Pred_NB", F.lit(1)), models)


def test_models_beyond_the_bounds_are_refused(reviews, models, monkeypatch):
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 3)
    assert rowwise.RowScorer.of(models) is None
    with pytest.raises(ValueError, match="score_reviews"):
        rowwise.score_rows(reviews, models)


def test_stream_equals_batch(spark, reviews, models, tmp_path):
    named = reviews.select("doc_id", F.col("text").alias("Comment"), "score")
    named.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(named.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_rows_stream(stream, models, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), rowwise.score_rows(named, models)
    assert got.columns == want.columns
    near = lambda df: sorted(map(str, df.select(*(F.round(c, 9).alias(c) if c.startswith("prob_") else c for c in df.columns)).collect()))
    assert near(got) == near(want)
    # started again on the same state, nothing is written twice
    again = spark.readStream.schema(named.schema).parquet(str(tmp_path / "in"))
    score_rows_stream(again, models, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 125

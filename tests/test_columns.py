import pytest
from pyspark.sql import functions as F

from reviewlens.operators import columns as C


def test_resolve_priority_and_case():
    assert C.resolve_columns(["Content", "Label"]) == C.ResolvedColumns("Content", "Label")
    # candidate order wins over column order
    assert C.resolve_columns(["comment", "text"]).text == "text"
    # duplicates by lower-case name: the last one
    assert C.resolve_columns(["Text", "TEXT"]).text == "TEXT"
    assert C.resolve_columns(["isi"]).score is None
    with pytest.raises(C.MissingTextColumn):
        C.resolve_columns(["body", "stars"])


def test_standardize_keeps_columns_and_maps_missing(spark):
    df = spark.createDataFrame([("Bagus", "1"), (None, "0")], "Ulasan string, Nilai string")
    out = C.standardize(df)
    assert out.columns == ["Ulasan", "Nilai", "text", "score"]
    rows = out.collect()
    assert [r.text for r in rows] == ["Bagus", "nan"]
    assert [r.text for r in C.standardize(df, missing="empty").collect()] == ["Bagus", ""]


def test_standardize_case_sensitive_duplicates(spark):
    df = spark.createDataFrame([("a", "b")], "Text string, TEXT string")
    out = C.standardize(df)
    assert out.columns == ["Text", "TEXT", "text"]
    assert out.first()["text"] == "b"


def test_input_quality_counts(spark):
    df = spark.createDataFrame([("ok", 1), ("  ", 0), (None, None), ("x", 5)], "text string, score int")
    r = C.input_quality(df).first().asDict()
    assert r == {"n_rows": 4, "null_text": 1, "blank_text": 1, "null_label": 1, "bad_label": 1,
                 "n_positive": 1, "n_negative": 1}


def test_select_prediction_fallbacks(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 0, 1)], "pred_nb int, pred_gbt int, pred_gru int")
    assert [r[0] for r in df.select(C.select_prediction(df, "all")).collect()] == [1, 0]
    only_gru = df.select("pred_gru")
    assert [r[0] for r in only_gru.select(C.select_prediction(only_gru)).collect()] == [1, 1]
    none = df.select(F.lit(1).alias("x"))
    assert [r[0] for r in none.select(C.select_prediction(none)).collect()] == [0, 0]


def test_preview_and_filters(spark):
    df = spark.createDataFrame([(i, "t" if i % 2 else " ", i % 2) for i in range(10)],
                               "doc_id int, text string, pred int")
    assert [r.doc_id for r in C.preview(df).collect()] == [0, 1, 2, 3, 4]
    assert C.nonblank(df).count() == 5
    assert C.class_filter(df, "pred", 1).count() == 5


def test_empty_inputs_give_empty_tables(spark):
    from reviewlens.operators import summary
    empty = spark.createDataFrame([], "doc_id long, text string, pred int")
    assert summary.class_distribution(empty, "pred").count() == 0
    top = summary.top_tokens(empty, "pred")
    assert top.count() == 0 and top.columns == ["class", "rank", "token", "count"]


def test_one_class_only_and_ties(spark):
    from reviewlens.operators import summary
    df = spark.createDataFrame([(1, "b a c", 1), (2, "c a b", 1), (3, "z", 1)],
                               "doc_id long, text string, pred int")
    dist = summary.class_distribution(df, "pred").collect()
    assert [(r["class"], r["count"], r.percent) for r in dist] == [(1, 3, 100.0)]
    top = summary.top_tokens(df, "pred", n=2).orderBy("rank").collect()
    assert [(r.token, r["count"]) for r in top] == [("a", 2), ("b", 2)]


def test_with_doc_id_is_stable_across_actions(spark):
    df = spark.createDataFrame([(f"review {i}",) for i in range(50)], "text string").repartition(4)
    keyed = C.with_doc_id(df)
    first = {r.text: r.doc_id for r in keyed.collect()}
    second = {r.text: r.doc_id for r in keyed.orderBy("text").collect()}
    assert first == second and len(set(first.values())) == 50
    assert C.with_doc_id(keyed) is keyed      # an existing key is kept


def test_blank_means_any_unicode_space(spark):
    df = spark.createDataFrame([("\n\t", 1), ("\u3000", 1), ("", 0), (None, 0), (" a ", 1)], "text string, score int")
    r = C.input_quality(df).first()
    assert (r.blank_text, r.null_text) == (3, 1)
    assert [x.text for x in C.nonblank(df).collect()] == [" a "]


def test_case_insensitive_sessions_lose_no_column(spark):
    df = spark.createDataFrame([("a", 1)], "Text string, Label int")
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        with pytest.raises(ValueError, match="Text"):
            C.standardize(df)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")
    assert C.standardize(df).columns == ["Text", "Label", "text", "score"]

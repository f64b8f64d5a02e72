"""Readers, writers, model artifacts and the stream."""

import io
import json
import os
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from reviewlens.operators import summary
from reviewlens.operators.columns import standardize
from reviewlens.sources import experiments, reviews, sinks, workbooks

SAMPLE = (
    'content,label\n'
    '"pengiriman cepat, barang bagus banget",1\n'
    'kemasan penyok 😡 dan isi tumpah kecewa,0\n'
    '"katanya ""original"" padahal palsu",0\n'
    'harga oke dan barang sesuai ,1\n'
    '"baris\nkedua dalam satu sel",1\n'
    'ga sesuai foto dan ga bisa retur,0\n'
)


def _sample(tmp_dir):
    p = os.path.join(tmp_dir, "sample.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write(SAMPLE)
    return p


def test_csv_reads_like_pandas(spark, tmp_dir):
    p = _sample(tmp_dir)
    df = reviews.read_reviews(spark, p)
    assert df.columns == ["content", "label"]
    want = pd.read_csv(p)
    assert [r.content for r in df.collect()] == want["content"].tolist()
    assert [int(r.label) for r in df.collect()] == want["label"].tolist()


def brute_top(texts, labels, cls, n):
    """Tokens of the class by falling count, then by name."""
    words = [w for t, y in zip(texts, labels) if y == cls for w in re.split(r"\W+", t.lower()) if w]
    return sorted(((w, words.count(w)) for w in set(words)), key=lambda x: (-x[1], x[0]))[:n]


def test_top_tokens_and_distribution_match_brute_force(spark, tmp_dir):
    df = standardize(reviews.read_reviews(spark, _sample(tmp_dir)))
    pdf = pd.read_csv(_sample(tmp_dir))
    top = summary.top_tokens(df, F.col("score").cast("int"), n=4).collect()
    for c in (0, 1):
        got = [(r.token, r["count"]) for r in sorted(top, key=lambda r: r["rank"]) if r["class"] == c]
        assert got == brute_top(pdf["content"].tolist(), pdf["label"].tolist(), c, 4)
    dist = {r["class"]: (r["count"], r.percent)
            for r in summary.class_distribution(df, F.col("score").cast("int")).collect()}
    assert dist == {0: (3, 50.0), 1: (3, 50.0)}


def test_na_markers_and_dispatch(spark, tmp_dir):
    p = os.path.join(tmp_dir, "r.CSV")
    with open(p, "w") as f:
        f.write('Review,Rating\n"a ""quoted"", text",1\nNA,0\nnull,1\n')
    df = standardize(reviews.read_reviews(spark, p))
    assert [r.text for r in df.collect()] == ['a "quoted", text', "nan", "nan"]
    with pytest.raises(reviews.UnreadableInput):
        reviews.read_reviews(spark, os.path.join(tmp_dir, "r.txt"))


def _tiny_xlsx(rows):
    strings, cells_xml = [], []
    for r, row in enumerate(rows, start=1):
        cs = []
        for c, v in enumerate(row):
            ref = chr(65 + c) + str(r)
            if isinstance(v, str):
                strings.append(v)
                cs.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            elif v is not None:
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells_xml.append(f'<row r="{r}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets>'
                   '<sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="ws"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet {ns}><sheetData>{"".join(cells_xml)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(
            f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
    return buf.getvalue()


def test_workbooks_bulk_ingest(spark, tmp_dir):
    d = os.path.join(tmp_dir, "books")
    os.makedirs(d)
    with open(os.path.join(d, "a.xlsx"), "wb") as f:
        f.write(_tiny_xlsx([["Content", "Label"], ["bagus sekali", 1], ["jelek", 0]]))
    with open(os.path.join(d, "b.xlsx"), "wb") as f:
        f.write(_tiny_xlsx([["Content", "Label"], ["lumayan", None]]))
    df = standardize(reviews.read_reviews(spark, d))
    got = sorted((r.text, r.score) for r in df.collect())
    assert got == [("bagus sekali", "1"), ("jelek", "0"), ("lumayan", None)]


def test_a_folder_loses_no_file_and_no_column(spark, tmp_dir):
    d = os.path.join(tmp_dir, "mixed")
    os.makedirs(d)
    for name, text in [("a.csv", "content,label\nsatu,1\n"), ("b.csv", "label,content\n0,dua\n"),
                       ("c.CSV", "content,label,toko\ntiga,1,x\n")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    for name, rows in [("d.xlsx", [["content", "label"], ["empat", 1]]),
                       ("e.xlsx", [["label", "content", "extra"], [0, "lima", "y"]])]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(_tiny_xlsx(rows))
    got = sorted((r.content, r.label, r.toko, r.extra) for r in reviews.read_reviews(spark, d).collect())
    assert got == [("dua", "0", None, None), ("empat", "1", None, None), ("lima", "0", None, "y"),
                   ("satu", "1", None, None), ("tiga", "1", "x", None)]


def test_experiments_json(spark, tmp_dir):
    p = os.path.join(tmp_dir, "exp.json")
    with open(p, "w") as f:
        json.dump({" lightgbm ": {"accuracy": 0.81234, "precision": 0.7, "recall": 0.6,
                                  "f1_score": 0.65},
                   "GRU": {"accuracy": 0.9, "precision": 0.8, "recall": 0.7, "f1": 0.75},
                   "gru": {"accuracy": 0.1}}, f)
    rows = [tuple(r) for r in experiments.read_experiments(spark, p).collect()]
    assert rows == [("GRU", 0.9, 0.8, 0.7, 0.75), ("LightGBM", 0.8123, 0.7, 0.6, 0.65)]
    missing = experiments.read_experiments(spark, os.path.join(tmp_dir, "none.json")).collect()
    assert [r.Model for r in missing] == ["GRU", "Naive Bayes", "LightGBM"]


def test_write_results_formats(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a, \"b\"", 0.03125, 1, True), (2, "", 0.5, 0, None)],
                               "doc_id int, text string, prob_gbt double, pred_gbt int, ok boolean")
    out = os.path.join(tmp_dir, "csv")
    sinks.write_results(df, out, exact_format=True)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out))
                   if f.endswith(".csv"))
    lines = [x for x in text.splitlines() if x]
    assert lines[0] == "doc_id,text,prob_lgbm,pred_lgbm,ok"
    assert '1,"a, ""b""",0.0312,1,True' in lines
    assert "2,,0.5000,0," in lines
    out2 = os.path.join(tmp_dir, "csv2")
    sinks.write_results(df, out2)
    back = spark.read.csv(out2, header=True).orderBy("doc_id").collect()
    assert back[0]["prob_lgbm"] in ("0.0313", "0.0312")


@pytest.fixture(scope="module")
def bundle(spark):
    from reviewlens.plans.models import model_bundle
    return model_bundle(spark, SF_SMALL)


def test_model_save_load_same_scores(spark, bundle, tmp_dir):
    from reviewlens.operators.scoring import score_reviews
    from reviewlens.plans.corpus import reviews as corpus
    from reviewlens.sources.artifacts import load_model, save_model
    docs = corpus(spark, SF_SMALL).select("doc_id", "text")
    a = score_reviews(docs, bundle).toPandas().sort_values("doc_id").reset_index(drop=True)
    save_model(bundle, os.path.join(tmp_dir, "m"))
    b = score_reviews(docs, load_model(spark, os.path.join(tmp_dir, "m"))).toPandas()
    b = b.sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(b.columns)], check_exact=False,
                                  atol=1e-9)
    assert len(a) == docs.count()


def test_stream_equals_batch(spark, bundle, tmp_dir):
    from reviewlens.operators.scoring import score_reviews
    from reviewlens.plans.corpus import reviews as corpus
    from reviewlens.streaming.score_stream import review_stream, score_stream
    docs = corpus(spark, SF_SMALL).select("doc_id", "text")
    src = os.path.join(tmp_dir, "in")
    docs.repartition(3).write.parquet(src)
    q = score_stream(review_stream(spark, src, docs.schema, max_files_per_trigger=1), bundle,
                     os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination()
    streamed = spark.read.parquet(os.path.join(tmp_dir, "out")).drop("batch_id").toPandas()
    batch = score_reviews(docs, bundle).toPandas()
    cols = sorted(batch.columns)
    s = streamed[cols].sort_values("doc_id").reset_index(drop=True)
    b = batch[cols].sort_values("doc_id").reset_index(drop=True)
    assert streamed["batch_id"].nunique() if "batch_id" in streamed else True
    pd.testing.assert_frame_equal(s, b, check_exact=False, atol=1e-9)


def test_single_review_scores(spark, bundle):
    from reviewlens.operators.scoring import score_reviews
    one = spark.createDataFrame([(1, "The service was good and fast")], "doc_id long, text string")
    r = score_reviews(one, bundle).first()
    assert r.pred_nb in (0, 1) and 0.0 <= r.prob_gru <= 1.0 and r.score_ok_gbt


def test_fit_models_on_an_uploaded_file(spark, tmp_dir):
    """The user flow: read a file, standardise, key it, fit all three models,
    score it and export it."""
    from reviewlens.operators.columns import with_doc_id
    from reviewlens.operators.scoring import score_reviews
    from reviewlens.plans.models import fit_models
    pos = ["barang bagus pengiriman cepat", "mantap sesuai pesanan", "puas banget seller ramah"]
    neg = ["barang rusak kecewa", "lama banget tidak sesuai", "kecewa parah refund lama"]
    p = os.path.join(tmp_dir, "upload.csv")
    pd.DataFrame({"Ulasan": [t + f" {i}" for i in range(20) for t in pos + neg],
                  "Nilai": [1, 1, 1, 0, 0, 0] * 20}).to_csv(p, index=False)
    df = with_doc_id(standardize(reviews.read_reviews(spark, p)))
    models = fit_models(df, num_words=50, k=4, maxlen=8, epochs=3, trees=5)
    scored = score_reviews(df.select("doc_id", "text"), models)
    out = scored.join(df.select("doc_id", F.col("score").cast("int").alias("y")), "doc_id").toPandas()
    assert len(out) == 120
    assert (out["pred_nb"] == out["y"]).mean() > 0.9
    sinks.write_results(scored, os.path.join(tmp_dir, "export"))
    assert spark.read.csv(os.path.join(tmp_dir, "export"), header=True).count() == 120


def test_csv_stream_equals_batch(spark, bundle, tmp_dir):
    from reviewlens.operators.scoring import score_reviews
    from reviewlens.streaming.score_stream import review_stream, score_stream
    rows = [(1, "barang bagus, pengiriman cepat"), (2, 'kata ""bagus"" tapi rusak'),
            (3, "the product arrived quickly"), (4, None)]
    src = os.path.join(tmp_dir, "csv_in")
    os.makedirs(src)
    for i in range(2):
        pd.DataFrame(rows[2 * i: 2 * i + 2], columns=["doc_id", "text"]).to_csv(
            os.path.join(src, f"part{i}.csv"), index=False)
    schema = "doc_id long, text string"
    q = score_stream(review_stream(spark, src, schema, fmt="csv", max_files_per_trigger=1), bundle,
                     os.path.join(tmp_dir, "csv_out"), os.path.join(tmp_dir, "csv_ckpt"))
    q.awaitTermination()
    streamed = spark.read.parquet(os.path.join(tmp_dir, "csv_out"))
    assert streamed.select("batch_id").distinct().count() == 2
    same = standardize(reviews.read_reviews(spark, src)).withColumn("doc_id", F.col("doc_id").cast("long"))
    batch = score_reviews(same.select("doc_id", "text"), bundle).toPandas()
    cols = sorted(batch.columns)
    s = streamed.drop("batch_id").toPandas()[cols].sort_values("doc_id").reset_index(drop=True)
    b = batch[cols].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(s, b, check_exact=False, atol=1e-9)

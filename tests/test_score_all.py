"""What is made of the three models' scores, recomputed by SQL from the written ``score_all`` table."""

import os
import sys

import duckdb
import pytest
from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
from oracle_check import digest  # noqa: E402
from reviewlens.plans import catalog  # noqa: E402
from reviewlens.plans import sql_text as S  # noqa: E402

SQL = {
    "vote": "SELECT doc_id, CAST(pred_nb + pred_gbt + pred_gru >= 2 AS INTEGER) AS pred_vote FROM scores",
    "class_distribution_vote": """WITH v AS (SELECT CAST(pred_nb + pred_gbt + pred_gru >= 2 AS INTEGER) AS class FROM scores)
        SELECT {columns} FROM v GROUP BY class""",
    "evaluate_all": """WITH u AS ({models}), c AS (SELECT model, count_if(y = 1 AND p = 1) AS tp, count_if(y = 0 AND p = 1) AS fp,
        count_if(y = 1 AND p = 0) AS fn, count_if(y = 0 AND p = 0) AS tn FROM u GROUP BY model)
        SELECT model, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 4) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 4) AS precision,
          round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM c""",
    "top_tokens_vote": """WITH t AS (SELECT pred_vote AS class, unnest({tokens}) AS token FROM scores JOIN documents USING (doc_id)),
        c AS (SELECT class, token, count(*) AS count FROM t GROUP BY class, token),
        k AS (SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY count DESC, token) AS INTEGER) AS rank, token, count FROM c)
        SELECT class, rank, token, count FROM k WHERE rank <= 10""",
}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scores") / "score_all")
    catalog.QUERIES["score_all"](spark, SF_SMALL).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW scores AS SELECT * FROM read_parquet('{path}/*.parquet')")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_sql_over_the_written_scores(spark, written, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    models = " UNION ALL ".join(f"SELECT '{m}' AS model, score AS y, pred_{m} AS p FROM scores WHERE NOT is_train AND score IS NOT NULL" for m in ("nb", "gbt", "gru", "vote"))
    share = "round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v), 1)"
    known = {"class": "class", "count": "count(*) AS count"}
    columns = ", ".join(known.get(c, f"{share} AS {c}") for c in df.columns)
    want = written.sql(SQL[name].format(models=models, columns=columns, tokens=S.raw_tokens("text")))
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(want.columns) and got
    assert digest(df.columns, got)[0] == digest(want.columns, want.fetchall())[0]


def test_every_document_has_all_scores(written):
    n = written.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert written.sql("SELECT count(*), count(DISTINCT doc_id), count_if(prob_nb BETWEEN 0 AND 1 AND prob_gbt BETWEEN 0 AND 1 AND prob_gru BETWEEN 0 AND 1) FROM scores").fetchall() == [(n, n, n)]

"""DuckDB spelling of the TF-IDF + Naive Bayes fit and score (oracle only)."""

from __future__ import annotations

from . import sql_text as S


def nb_ctes(alpha: float = 1.0, max_features: int | None = None, label: str = "lang = 'en'",
            source: str = "documents") -> str:
    """``label``: SQL for the 0/1 label; ``source``: the table or join it and the text come from."""
    a = repr(float(alpha))
    cut = "" if max_features is None else f"ORDER BY cf DESC, term LIMIT {max_features}"
    return f"""
r AS (SELECT doc_id, CAST({label} AS INTEGER) AS score, {S.std_text()} AS text,
             {S.clean_ml(S.std_text())} AS clean, {S.is_train()} AS is_train FROM {source}),
toks AS (SELECT doc_id, unnest(string_split(clean, ' ')) AS term FROM r),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE length(term) >= 2 GROUP BY doc_id, term),
ttf AS (SELECT tf.doc_id, r.score, tf.term, tf.tf FROM tf JOIN r USING (doc_id)
        WHERE r.is_train AND r.score IN (0, 1)),
n AS (SELECT count(*) AS n, count_if(score = 0) AS n0, count_if(score = 1) AS n1
      FROM r WHERE is_train AND score IN (0, 1)),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM ttf GROUP BY term {cut}),
nv AS (SELECT count(*) AS v FROM vocab),
idf AS (SELECT term, df, ln((1.0 + n) / (CAST(df AS DOUBLE) + 1.0)) + 1.0 AS idf FROM vocab, n),
tw AS (SELECT t.doc_id, t.score, t.term, t.tf * i.idf AS w FROM ttf t JOIN idf i USING (term)),
tx AS (SELECT doc_id, score, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM tw),
fc AS (SELECT term, sum(CASE WHEN score = 0 THEN x ELSE 0.0 END) AS fc0,
              sum(CASE WHEN score = 1 THEN x ELSE 0.0 END) AS fc1 FROM tx GROUP BY term),
tot AS (SELECT sum(fc0) + {a} * (SELECT v FROM nv) AS d0,
               sum(fc1) + {a} * (SELECT v FROM nv) AS d1 FROM fc),
model AS (SELECT fc.term, idf.idf, ln((fc0 + {a}) / d0) AS lp0, ln((fc1 + {a}) / d1) AS lp1
          FROM fc JOIN idf USING (term), tot),
prior AS (SELECT ln(CAST(n0 AS DOUBLE) / n) AS p0, ln(CAST(n1 AS DOUBLE) / n) AS p1 FROM n),
dsum AS (SELECT r.doc_id, r.score, r.is_train,
                sum((tf.tf * m.idf) * (tf.tf * m.idf)) AS s2,
                sum((tf.tf * m.idf) * m.lp0) AS a0,
                sum((tf.tf * m.idf) * m.lp1) AS a1
         FROM r LEFT JOIN tf ON r.doc_id = tf.doc_id LEFT JOIN model m ON tf.term = m.term
         GROUP BY r.doc_id, r.score, r.is_train),
jll AS (SELECT doc_id, score, is_train,
               p0 + coalesce(a0, 0.0) * (CASE WHEN coalesce(s2, 0.0) > 0 THEN 1.0 / sqrt(s2) ELSE 0.0 END) AS j0,
               p1 + coalesce(a1, 0.0) * (CASE WHEN coalesce(s2, 0.0) > 0 THEN 1.0 / sqrt(s2) ELSE 0.0 END) AS j1
        FROM dsum, prior),
scored AS (SELECT doc_id, score, is_train, CAST(j1 > j0 AS INTEGER) AS pred_nb,
                  1.0 / (1.0 + exp(j0 - j1)) AS prob_nb FROM jll)"""


def with_nb(select: str, **options) -> str:
    return f"WITH {nb_ctes(**options)}\n{select}"

"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole driver tables. ``ORACLE`` holds the DuckDB spelling where one exists.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import columns, ensemble, evaluate, summary
from ..operators import sequence as sequence_ops
from ..operators import tfidf as tfidf_ops
from ..operators.gru import CORE_NAMES
from ..operators.scoring import score_reviews
from ..session import scratch_path
from ..sources.sinks import format_floats
from ..sources.tables import table
from ..streaming.score_stream import review_stream, score_stream
from . import sql_text as S
from .corpus import reviews, with_split
from .models import (FIT_ROWS, all_scores, model_bundle, nb_context, once, quality_context,
                     review_docs, round6, scored_reviews, sequence_context, trees_context, whole_word_index)
from .sql_models import with_nb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------- word counts

_TOP_TOKENS_BY_LABEL_SQL = f"""
WITH r AS ({S.REVIEWS}),
t AS (SELECT label AS class, unnest({S.raw_tokens('text')}) AS token FROM r),
c AS (SELECT class, token, count(*) AS count FROM t GROUP BY class, token),
k AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY count DESC, token) AS rank,
             token, count FROM c)
SELECT class, CAST(rank AS INTEGER) AS rank, token, count FROM k WHERE rank <= 10
"""


@register("top_tokens", _TOP_TOKENS_BY_LABEL_SQL)
def q_top_tokens(spark, sf_dir):
    return summary.top_tokens(reviews(spark, sf_dir), "score", n=10)


# ------------------------------------------------------- schema and input checks


@register("row_count", "SELECT count(*) AS n_rows FROM documents")
def q_row_count(spark, sf_dir):
    return columns.row_count(reviews(spark, sf_dir))


@register("standardize", f"SELECT doc_id, {S.std_text()} AS text, "
                         "CAST(lang = 'en' AS INTEGER) AS score FROM documents")
def q_standardize(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", "text", "score")


@register("preview", f"SELECT doc_id, {S.std_text()} AS text, CAST(lang = 'en' AS INTEGER) AS score "
                     "FROM documents ORDER BY doc_id LIMIT 5")
def q_preview(spark, sf_dir):
    return columns.preview(reviews(spark, sf_dir).select("doc_id", "text", "score"))


@register("input_quality", f"""
WITH r AS (SELECT d.text AS text, l.quality AS score
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) AS n_rows,
       CAST(count_if(text IS NULL) AS BIGINT) AS null_text,
       CAST(count_if(text IS NOT NULL AND {S.is_blank('text')}) AS BIGINT) AS blank_text,
       CAST(count_if(score IS NULL) AS BIGINT) AS null_label,
       CAST(count_if(score IS NOT NULL AND score NOT IN (0, 1)) AS BIGINT) AS bad_label,
       CAST(count_if(score = 1) AS BIGINT) AS n_positive,
       CAST(count_if(score = 0) AS BIGINT) AS n_negative
FROM r""")
def q_input_quality(spark, sf_dir):
    """Text checks on the raw documents (before missing text becomes "nan"),
    label checks from ``labels``; only narrow flag rows meet in the join."""
    flags = columns.text_flags(table(spark, sf_dir, "documents"), "text", keep=["doc_id"])
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score"))
    return columns.quality_report(flags.join(labels, "doc_id", "left"))


@register("nonblank", "SELECT conv_id, turn, role FROM conversations "
                      f"WHERE text IS NOT NULL AND NOT {S.is_blank('text')}")
def q_nonblank(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return columns.nonblank(conv).select("conv_id", "turn", "role")


# ------------------------------------------------------------- text functions
def _doc_text(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", "text")


@register("text_lower", f"SELECT doc_id, {S.text_lower(S.std_text())} AS out FROM documents")
def q_text_lower(spark, sf_dir):
    return _doc_text(spark, sf_dir).select("doc_id", T.text_lower("text").alias("out"))


@register("strip_urls", f"SELECT page_id, {S.strip_urls('lower(html)')} AS out FROM pages")
def q_strip_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.strip_urls(F.lower("html")).alias("out"))


@register("strip_mentions", f"SELECT doc_id, {S.strip_mentions(S.text_lower(S.std_text()))} AS out "
                            "FROM documents")
def q_strip_mentions(spark, sf_dir):
    return _doc_text(spark, sf_dir).select(
        "doc_id", T.strip_mentions(T.text_lower("text")).alias("out"))


@register("letters_only", f"SELECT doc_id, {S.letters_only(S.text_lower(S.std_text()))} AS out "
                          "FROM documents")
def q_letters_only(spark, sf_dir):
    return _doc_text(spark, sf_dir).select(
        "doc_id", T.letters_only(T.text_lower("text")).alias("out"))


@register("clean_ml", f"SELECT doc_id, {S.clean_ml(S.std_text())} AS clean FROM documents "
                      f"UNION ALL SELECT -1 - page_id AS doc_id, {S.clean_ml('html')} AS clean FROM pages")
def q_clean_ml(spark, sf_dir):
    docs = _doc_text(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"),
                                                 F.col("html").alias("text"))
    return docs.unionByName(pages).select("doc_id", T.clean_ml("text").alias("clean"))


@register("clean_light", f"SELECT doc_id, {S.clean_light(S.std_text())} AS clean FROM documents "
                         f"UNION ALL SELECT -1 - page_id AS doc_id, {S.clean_light('html')} AS clean "
                         "FROM pages")
def q_clean_light(spark, sf_dir):
    docs = _doc_text(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"),
                                                 F.col("html").alias("text"))
    return docs.unionByName(pages).select("doc_id", T.clean_light("text").alias("clean"))


@register("tokens", f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {S.raw_tokens(S.std_text())} AS t FROM documents)""")
def q_tokens(spark, sf_dir):
    t = _doc_text(spark, sf_dir).select("doc_id", T.raw_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


@register("label_text", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Positif' ELSE 'Negatif' END "
                        "AS label_text FROM documents")
def q_label_text(spark, sf_dir):
    return reviews(spark, sf_dir).select("doc_id", T.label_text("score").alias("label_text"))


@register("vocabulary", f"SELECT DISTINCT unnest({S.raw_tokens(S.std_text())}) AS token FROM documents")
def q_vocabulary(spark, sf_dir):
    return summary.vocabulary(reviews(spark, sf_dir))


@register("token_counts", f"""
SELECT label AS class, token, count(*) AS count
FROM (SELECT label, unnest({S.raw_tokens('text')}) AS token FROM ({S.REVIEWS}))
GROUP BY label, token""")
def q_token_counts(spark, sf_dir):
    return summary.token_counts(reviews(spark, sf_dir), "score")


# Tokens removed from the word counts: the out-of-vocabulary marker's word and a few
# frequent words of the corpus.
HIDDEN_TOKENS = ["oov", "the", "of", "and", "to", "in", "a", "de", "la", "der", "die"]


@register("token_counts_filtered", f"""
SELECT label AS class, token, count(*) AS count
FROM (SELECT label, unnest({S.raw_tokens('text')}) AS token FROM ({S.REVIEWS}))
WHERE token NOT IN ({", ".join(S.q(t) for t in HIDDEN_TOKENS)})
GROUP BY label, token""")
def q_token_counts_filtered(spark, sf_dir):
    stop = spark.createDataFrame([(t,) for t in HIDDEN_TOKENS], "token string")
    return summary.drop_tokens(summary.token_counts(reviews(spark, sf_dir), "score"), stop)


# ------------------------------------------------- TF-IDF + Naive Bayes family


@register("split", "SELECT is_train, score, count(*) AS n_rows FROM "
                   f"(SELECT {S.is_train()} AS is_train, CAST(lang = 'en' AS INTEGER) AS score "
                   "FROM documents) GROUP BY is_train, score")
def q_split(spark, sf_dir):
    return (with_split(reviews(spark, sf_dir)).groupBy("is_train", "score")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("fit_tfidf", with_nb("SELECT term, df, round(idf, 6) AS idf FROM idf"))
def q_fit_tfidf(spark, sf_dir):
    ctx = nb_context(spark, sf_dir)
    return ctx.vocab.table.select("term", "df", round6("idf"))


#: A limit that bites at every scale, to check the cut and its ties.
FEW_TERMS = 5000


@register("fit_tfidf_limited", with_nb("SELECT term, df, round(idf, 6) AS idf FROM idf",
                                       max_features=FEW_TERMS))
def q_fit_tfidf_limited(spark, sf_dir):
    ctx = nb_context(spark, sf_dir)
    counts = ctx.tf_all.where(FIT_ROWS)
    model = tfidf_ops.fit_tfidf(counts, ctx.vocab.n_docs, max_features=FEW_TERMS)
    return model.table.select("term", "df", round6("idf"))


#: The partly labelled table: ``labels.quality`` on the documents that have one.
_QUALITY = {"label": "quality", "source": "documents LEFT JOIN labels USING (doc_id)"}


@register("fit_tfidf_quality", with_nb("SELECT term, df, round(idf, 6) AS idf FROM idf", **_QUALITY))
def q_fit_tfidf_quality(spark, sf_dir):
    return quality_context(spark, sf_dir).vocab.table.select("term", "df", round6("idf"))


@register("score_nb_quality", with_nb("SELECT doc_id, pred_nb, round(prob_nb, 6) AS prob_nb FROM scored",
                                      **_QUALITY))
def q_score_nb_quality(spark, sf_dir):
    return quality_context(spark, sf_dir).scored.select("doc_id", "pred_nb", round6("prob_nb"))


@register("tfidf", with_nb("""
, aw AS (SELECT tf.doc_id, tf.term, tf.tf * i.idf AS w FROM tf JOIN idf i USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS x FROM aw"""
                           .replace("\n, aw", ", aw", 1)))
def q_tfidf(spark, sf_dir):
    ctx = nb_context(spark, sf_dir)
    x = tfidf_ops.tfidf(ctx.tf_all, ctx.vocab)
    return x.select("doc_id", "term", round6("x"))


@register("fit_nb", with_nb("SELECT term, round(lp0, 6) AS lp0, round(lp1, 6) AS lp1 FROM model"))
def q_fit_nb(spark, sf_dir):
    ctx = nb_context(spark, sf_dir)
    return ctx.model.table.select("term", round6("lp0"), round6("lp1"))


@register("score_nb", with_nb("SELECT doc_id, pred_nb, round(prob_nb, 6) AS prob_nb FROM scored"))
def q_score_nb(spark, sf_dir):
    return nb_context(spark, sf_dir).scored.select("doc_id", "pred_nb", round6("prob_nb"))


@register("class_distribution", with_nb("""
SELECT pred_nb AS class, count(*) AS count,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent
FROM scored GROUP BY pred_nb"""))
def q_class_distribution(spark, sf_dir):
    return summary.class_distribution(nb_context(spark, sf_dir).scored, "pred_nb")


@register("class_filter", with_nb("SELECT doc_id FROM scored WHERE pred_nb = 1"))
def q_class_filter(spark, sf_dir):
    return columns.class_filter(nb_context(spark, sf_dir).scored, "pred_nb", 1).select("doc_id")


@register("confidence_pct", with_nb("""
SELECT doc_id, round(least(greatest(prob_nb, 0.0), 1.0), 6) AS confidence,
       CAST(round_even(prob_nb * 100, 0) AS INTEGER) AS percent,
       CASE WHEN pred_nb = 1 THEN 'Positif' ELSE 'Negatif' END AS label_text
FROM scored"""))
def q_confidence_pct(spark, sf_dir):
    s = nb_context(spark, sf_dir).scored
    return s.select("doc_id", F.round(T.clamp01("prob_nb"), 6).alias("confidence"),
                    T.confidence_pct("prob_nb").alias("percent"),
                    T.label_text("pred_nb").alias("label_text"))


@register("top_tokens_nb", with_nb(f"""
, t AS (SELECT s.pred_nb AS class, unnest({S.raw_tokens('r.text')}) AS token
        FROM r JOIN scored s USING (doc_id)),
c AS (SELECT class, token, count(*) AS count FROM t GROUP BY class, token),
k AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY count DESC, token) AS rank,
             token, count FROM c)
SELECT class, CAST(rank AS INTEGER) AS rank, token, count FROM k WHERE rank <= 10"""
                                   .replace("\n, t AS", ", t AS", 1)))
def q_top_tokens_nb(spark, sf_dir):
    return summary.top_tokens(scored_reviews(spark, sf_dir), "pred_nb", n=10)


_BEST_THR_SQL = """
, v AS (SELECT score, prob_nb FROM scored WHERE NOT is_train),
grid AS (SELECT CAST(k AS DOUBLE) / 100.0 AS threshold FROM range(1, 100) g(k)),
c AS (SELECT g.threshold,
             count_if(v.score = 1 AND v.prob_nb >= g.threshold) AS tp,
             count_if(v.score = 0 AND v.prob_nb >= g.threshold) AS fp,
             count_if(v.score = 1 AND v.prob_nb < g.threshold) AS fn
      FROM grid g, v GROUP BY g.threshold),
f AS (SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0
                             THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c),
best AS (SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1)"""


def _nb_best_threshold(spark, sf_dir):
    s = nb_context(spark, sf_dir).scored
    return evaluate.best_threshold(s.where(~F.col("is_train")), "score", "prob_nb")


@register("best_threshold", with_nb(_BEST_THR_SQL.replace("\n, v AS", ", v AS", 1)
                                    + "\nSELECT threshold, round(f1, 6) AS f1 FROM best"))
def q_best_threshold(spark, sf_dir):
    return _nb_best_threshold(spark, sf_dir).select("threshold", round6("f1"))


@register("apply_threshold", with_nb(_BEST_THR_SQL.replace("\n, v AS", ", v AS", 1) + """
SELECT doc_id, CAST(prob_nb >= threshold AS INTEGER) AS pred_thr FROM scored, best"""))
def q_apply_threshold(spark, sf_dir):
    thr = _nb_best_threshold(spark, sf_dir).first()["threshold"]
    s = nb_context(spark, sf_dir).scored
    return s.select("doc_id", ensemble.apply_threshold("prob_nb", thr).alias("pred_thr"))


@register("evaluate", with_nb("""
, c AS (SELECT CASE WHEN is_train THEN 'train' ELSE 'validation' END AS fold,
               CAST(count_if(score = 1 AND pred_nb = 1) AS BIGINT) AS tp,
               CAST(count_if(score = 0 AND pred_nb = 1) AS BIGINT) AS fp,
               CAST(count_if(score = 1 AND pred_nb = 0) AS BIGINT) AS fn,
               CAST(count_if(score = 0 AND pred_nb = 0) AS BIGINT) AS tn
        FROM scored WHERE score IS NOT NULL GROUP BY fold)
SELECT 'nb' AS model, fold, tp, fp, fn, tn,
       round(CASE WHEN tp + fp + fn + tn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) ELSE 0.0 END, 4) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 4) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1
FROM c""".replace("\n, c AS", ", c AS", 1)))
def q_evaluate(spark, sf_dir):
    """Every labelled row counts: those of the training fold and those that no fit has seen, each with figures of its own."""
    fold = F.when(F.col("is_train"), "train").otherwise("validation")
    s = nb_context(spark, sf_dir).scored.withColumn("fold", fold)
    return evaluate.evaluate(s, "score", {"nb": "pred_nb"}, by=["fold"])


# ------------------------------------------------- SVD + boosted trees family


@register("fit_svd")
def q_fit_svd(spark, sf_dir):
    ctx = trees_context(spark, sf_dir)
    sv = [(i, float(s)) for i, s in enumerate(ctx.svd.singular_values)]
    return spark.createDataFrame(sv, "component int, singular_value double")


@register("svd_project")
def q_svd_project(spark, sf_dir):
    return trees_context(spark, sf_dir).feats.select("doc_id", "svd")


@register("fit_gbt")
def q_fit_gbt(spark, sf_dir):
    """The fitted trees, a row for each node."""
    return trees_context(spark, sf_dir).gbt.table(spark)


@register("score_gbt")
def q_score_gbt(spark, sf_dir):
    return trees_context(spark, sf_dir).scored.select("doc_id", "pred_gbt", "prob_gbt")


# ----------------------------------------------------- sequence model family

MAXLEN = 150

WORD_INDEX_CTES = f"""
r AS (SELECT doc_id, {S.clean_light(S.std_text())} AS cl,
             {S.is_train()} AND lang IS NOT NULL AS is_train FROM documents),
w AS (SELECT unnest(string_split(cl, ' ')) AS word FROM r WHERE is_train),
c AS (SELECT word, count(*) AS count FROM w WHERE length(word) > 0 GROUP BY word),
idx AS (SELECT word, count, CAST(row_number() OVER (ORDER BY count DESC, word) + 1 AS INTEGER) AS id
        FROM c)"""


@register("fit_word_index", f"WITH {WORD_INDEX_CTES}\nSELECT word, count, id FROM idx")
def q_fit_word_index(spark, sf_dir):
    return whole_word_index(spark, sf_dir).table.select("word", "count", "id")


@register("encode_sequence", f"""WITH {WORD_INDEX_CTES},
ws AS (SELECT doc_id, string_split(cl, ' ') AS ws FROM r),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM ws),
j AS (SELECT p.doc_id, p.pos, coalesce(idx.id, 1) AS id FROM p LEFT JOIN idx USING (word)
      WHERE length(p.word) > 0),
g AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM j GROUP BY doc_id)
SELECT ws.doc_id, array_to_string(list_resize(coalesce(g.ids, []), {MAXLEN}, 0), ' ') AS ids
FROM ws LEFT JOIN g USING (doc_id)""")
def q_encode_sequence(spark, sf_dir):
    s = sequence_ops.encode_sequence(review_docs(spark, sf_dir), whole_word_index(spark, sf_dir), maxlen=MAXLEN)
    return s.select("doc_id", F.array_join("ids", " ").alias("ids"))


@register("fit_gru")
def q_fit_gru(spark, sf_dir):
    """The fitted weights: the vector of every word that training met, and a row for each row of the gates."""
    m = sequence_context(spark, sf_dir, MAXLEN).model
    core = [(k, i, [float(x) for x in np.atleast_1d(row)])
            for k in CORE_NAMES for i, row in enumerate(np.atleast_1d(m.core[k]))]
    core.append(("threshold", 0, [float(m.threshold)]))
    return m.rows.select(F.lit("E").alias("param"), F.col("id").alias("row"), F.col("e").alias("values")).unionByName(
        spark.createDataFrame(core, "param string, row bigint, values array<double>"))


@register("score_gru")
def q_score_gru(spark, sf_dir):
    return sequence_context(spark, sf_dir, MAXLEN).scored.select(
        "doc_id", "pred_gru", "prob_gru")


# --------------------------------------------------- all three models together
def _all_scores(spark, sf_dir):
    return all_scores(spark, sf_dir)


@register("score_all")
def q_score_all(spark, sf_dir):
    return _all_scores(spark, sf_dir)


@register("vote")
def q_vote(spark, sf_dir):
    return _all_scores(spark, sf_dir).select("doc_id", "pred_vote")


@register("class_distribution_vote")
def q_class_distribution_vote(spark, sf_dir):
    """Distribution for the "all models" choice: the 2-of-3 vote, picked the
    way the summaries pick a prediction column (``select_prediction``)."""
    scores = _all_scores(spark, sf_dir).select("doc_id", "pred_nb", "pred_gbt", "pred_gru")
    return summary.class_distribution(scores, columns.select_prediction(scores, "all"))


def with_text(spark, sf_dir, preds):
    """Predictions next to the review text. The text side is the checkpointed
    review table, already hash-partitioned by doc_id, so only the narrow
    prediction side moves."""
    text = review_docs(spark, sf_dir).select("doc_id", "text")
    return text.join(preds.hint("shuffle_hash"), "doc_id")


@register("top_tokens_vote")
def q_top_tokens_vote(spark, sf_dir):
    s = _all_scores(spark, sf_dir).select("doc_id", "pred_vote")
    return summary.top_tokens(with_text(spark, sf_dir, s), "pred_vote", n=10)


@register("evaluate_all")
def q_evaluate_all(spark, sf_dir):
    s = _all_scores(spark, sf_dir).where(~F.col("is_train"))
    return evaluate.evaluate(s, "score", {"nb": "pred_nb", "gbt": "pred_gbt", "gru": "pred_gru",
                                          "vote": "pred_vote"})


# --------------------------------------------------------------------- stream
def document_stream(spark, sf_dir):
    """The documents table replayed as a file stream."""
    file = "documents.parquet"
    src = f"{sf_dir.rstrip('/')}/{file}"
    docs = spark.read.parquet(src)
    # a stream reads folders: the table's own one, or where the table is one file, the folder around it
    first = docs.select("_metadata.file_name").first()
    one_file = first is not None and first["file_name"] == file
    return review_stream(spark, sf_dir if one_file else src, docs.schema, glob=file if one_file else None)


def stream_output(spark, sf_dir, name="stream", bundle=model_bundle):
    """The documents table replayed as a file stream and scored per micro-batch, once per session and ``name``."""
    models = bundle(spark, sf_dir)

    def run():
        out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
        score_stream(document_stream(spark, sf_dir), models, out, ckpt).awaitTermination()
        return spark.read.parquet(out)

    return once(spark, sf_dir, name, run)


@register("score_stream")
def q_score_stream(spark, sf_dir):
    return stream_output(spark, sf_dir).select("doc_id", "pred_nb", "prob_nb", "pred_gbt", "prob_gbt",
                                               "pred_gru", "prob_gru", "pred_vote")


# ------------------------------------------------ summaries for each model choice
def _by_method(spark, sf_dir, method):
    if method == "gbt":
        s = trees_context(spark, sf_dir).scored
    else:
        s = sequence_context(spark, sf_dir).scored
    return s.select("doc_id", f"pred_{method}")


for _m in ("gbt", "gru"):
    def _dist(spark, sf_dir, _m=_m):
        return summary.class_distribution(_by_method(spark, sf_dir, _m), f"pred_{_m}")

    def _top(spark, sf_dir, _m=_m):
        return summary.top_tokens(with_text(spark, sf_dir, _by_method(spark, sf_dir, _m)),
                                  f"pred_{_m}", n=10)

    register(f"class_distribution_{_m}")(_dist)
    register(f"top_tokens_{_m}")(_top)


# ------------------------------------------- scoring another table, CSV export
@register("score_conversations")
def q_score_conversations(spark, sf_dir):
    """The fitted models applied to a second text table, as a user scores a new
    upload: every conversation turn gets the six model columns and the vote."""
    return score_reviews(_turns(spark, sf_dir), model_bundle(spark, sf_dir)).select(
        *_split_key(), "pred_nb", "prob_nb", "pred_gbt", "prob_gbt", "pred_gru", "prob_gru",
        "pred_vote")


@register("export_nb", with_nb("""
SELECT doc_id, pred_nb, printf('%.4f', prob_nb) AS prob_nb FROM scored"""))
def q_export_nb(spark, sf_dir):
    """The scored table as the CSV export writes it (floats as ``%.4f``)."""
    return format_floats(nb_context(spark, sf_dir).scored.select("doc_id", "pred_nb", "prob_nb"))


def _turns(spark, sf_dir):
    """Conversation turns as reviews; the key spells out (conversation, turn)."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"),
                 F.coalesce(F.col("turn").cast("string"), F.lit(""))).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("nan")).alias("text"))


def _split_key():
    part = F.split("doc_id", ":")
    return [part[i].try_cast("bigint").alias(n) for i, n in enumerate(("conv_id", "turn"))]


@register("score_conversations_nb", with_nb(f"""
, ct AS (SELECT conv_id, turn, {S.clean_ml("coalesce(text, 'nan')")} AS clean FROM conversations),
ctoks AS (SELECT conv_id, turn, unnest(string_split(clean, ' ')) AS term FROM ct),
ctf AS (SELECT conv_id, turn, term, count(*) AS tf FROM ctoks WHERE length(term) >= 2
        GROUP BY conv_id, turn, term),
cs AS (SELECT ct.conv_id, ct.turn,
              sum((ctf.tf * m.idf) * (ctf.tf * m.idf)) AS s2,
              sum((ctf.tf * m.idf) * m.lp0) AS a0, sum((ctf.tf * m.idf) * m.lp1) AS a1
       FROM ct LEFT JOIN ctf ON ct.conv_id = ctf.conv_id AND ct.turn = ctf.turn
       LEFT JOIN model m ON ctf.term = m.term
       GROUP BY ct.conv_id, ct.turn),
cj AS (SELECT conv_id, turn,
              p0 + coalesce(a0, 0.0) * (CASE WHEN coalesce(s2, 0.0) > 0 THEN 1.0 / sqrt(s2) ELSE 0.0 END) AS j0,
              p1 + coalesce(a1, 0.0) * (CASE WHEN coalesce(s2, 0.0) > 0 THEN 1.0 / sqrt(s2) ELSE 0.0 END) AS j1
       FROM cs, prior)
SELECT conv_id, turn, CAST(j1 > j0 AS INTEGER) AS pred_nb, round(1.0 / (1.0 + exp(j0 - j1)), 6) AS prob_nb
FROM cj""".replace("\n, ct AS", ", ct AS", 1)))
def q_score_conversations_nb(spark, sf_dir):
    """The Naive Bayes fitted on the documents, applied to every conversation
    turn (the reference's "score a new file" path, oracle-checked)."""
    from ..operators import naive_bayes as nb_ops
    from ..operators.scoring import prepare
    ctx = nb_context(spark, sf_dir)
    tf = tfidf_ops.term_frequencies(prepare(_turns(spark, sf_dir)), "clean")
    scored = nb_ops.score_nb(tf, ctx.model)
    return scored.select(*_split_key(), "pred_nb", round6("prob_nb"))

"""Registered queries that drive the vote, the projection, the trees, the GRU and
the stream with weights SQL can repeat: three Naive Bayes models in place of the
three model kinds, a basis and GRU weights given by a formula, trees on a feature
that separates the labels. The operators are those of the fitted queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting, columns, ensemble, evaluate, naive_bayes, observed, summary
from ..operators import gru as gru_ops
from ..operators import sequence as sequence_ops
from ..operators import svd as svd_ops
from ..operators import trees as tree_ops
from ..operators.rowwise import score_any_rows
from ..operators.scoring import beside_inputs
from ..session import scratch_path
from ..sources.tables import table
from ..streaming.score_stream import score_rows_stream
from . import sql_text as S
from .catalog import MAXLEN, WORD_INDEX_CTES, document_stream, register, stream_output, with_text
from .corpus import labelled_reviews
from .models import FIT_ROWS, SMOOTHINGS, nb_bundle, nb_context, once, review_docs, round6, smoothing_votes, sparse_tfidf, whole_word_index
from .sql_models import nb_ctes, with_nb

# ------------------------------------- three Naive Bayes models, 2-of-3 vote

_MODELS = ", ".join(f"{name} AS (WITH {nb_ctes(alpha=alpha)}\nSELECT * FROM scored)"
                    for name, alpha in SMOOTHINGS.items())
_PICKED = ", ".join(f"{n}.pred_nb AS pred_{n}, {n}.prob_nb AS prob_{n}" for n in SMOOTHINGS)
_FIRST, *_REST = SMOOTHINGS
_VOTES_SQL = f"""WITH {_MODELS},
three AS (SELECT doc_id, {_FIRST}.score, {_FIRST}.is_train, {_PICKED}
          FROM {_FIRST} {' '.join(f'JOIN {n} USING (doc_id)' for n in _REST)}),
votes AS (SELECT *, CAST({' + '.join(f'pred_{n}' for n in SMOOTHINGS)} >= 2 AS INTEGER) AS pred_vote FROM three)"""


@register("vote_nb", f"""{_VOTES_SQL}
SELECT doc_id, {', '.join(f'pred_{n}, round(prob_{n}, 6) AS prob_{n}' for n in SMOOTHINGS)}, pred_vote FROM votes""")
def q_vote_nb(spark, sf_dir):
    rounded = [c for n in SMOOTHINGS for c in (f"pred_{n}", round6(f"prob_{n}"))]
    return smoothing_votes(spark, sf_dir).select("doc_id", *rounded, "pred_vote")


@register("class_distribution_vote_nb", f"""{_VOTES_SQL}
SELECT pred_vote AS class, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent
FROM votes GROUP BY pred_vote""")
def q_class_distribution_vote_nb(spark, sf_dir):
    return summary.class_distribution(smoothing_votes(spark, sf_dir), "pred_vote")


@register("top_tokens_vote_nb", f"""{_VOTES_SQL},
r AS (SELECT doc_id, {S.std_text()} AS text FROM documents),
t AS (SELECT v.pred_vote AS class, unnest({S.raw_tokens('r.text')}) AS token FROM r JOIN votes v USING (doc_id)),
c AS (SELECT class, token, count(*) AS count FROM t GROUP BY class, token),
k AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY count DESC, token) AS rank, token, count FROM c)
SELECT class, CAST(rank AS INTEGER) AS rank, token, count FROM k WHERE rank <= 10""")
def q_top_tokens_vote_nb(spark, sf_dir):
    votes = smoothing_votes(spark, sf_dir).select("doc_id", "pred_vote")
    return summary.top_tokens(with_text(spark, sf_dir, votes), "pred_vote", n=10)


_EACH = " UNION ALL ".join(f"SELECT '{n}' AS model, score, pred_{n} AS p FROM votes WHERE NOT is_train"
                           for n in [*SMOOTHINGS, "vote"])


@register("evaluate_vote_nb", f"""{_VOTES_SQL},
m AS ({_EACH}),
c AS (SELECT model, count_if(score = 1 AND p = 1) AS tp, count_if(score = 0 AND p = 1) AS fp,
             count_if(score = 1 AND p = 0) AS fn, count_if(score = 0 AND p = 0) AS tn
      FROM m WHERE score IS NOT NULL GROUP BY model)
SELECT model, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 4) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 4) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 4) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1
FROM c""")
def q_evaluate_vote_nb(spark, sf_dir):
    held = smoothing_votes(spark, sf_dir).where(~F.col("is_train"))
    return evaluate.evaluate(held, "score", {n: f"pred_{n}" for n in [*SMOOTHINGS, "vote"]})


@register("scored_table", f"""{_VOTES_SQL}
SELECT d.doc_id, {S.std_text('d.text')} AS text, d.lang, d.source, d.n_chars, CAST(d.lang = 'en' AS INTEGER) AS score,
       {', '.join(f'pred_{n}, round(prob_{n}, 6) AS prob_{n}' for n in SMOOTHINGS)}, pred_vote
FROM documents d JOIN votes USING (doc_id)""")
def q_scored_table(spark, sf_dir):
    """Every input column, the standard text and label, each model's prediction and probability, and the vote."""
    docs = table(spark, sf_dir, "documents")
    inputs = docs.withColumns({"text": F.coalesce(F.col("text").cast("string"), F.lit("nan")),
                               "score": (F.col("lang") == "en").cast("int")})
    return beside_inputs(inputs, q_vote_nb(spark, sf_dir))


# ----------------------------------------------------------- failed scores


@register("guard_scores", """
SELECT d.doc_id, coalesce(quality, 0)::INTEGER AS pred_nb, coalesce(quality, 0)::DOUBLE AS prob_nb,
       quality IS NOT NULL AS score_ok_nb
FROM documents d LEFT JOIN labels USING (doc_id)""")
def q_guard_scores(spark, sf_dir):
    """The quality label as a score that most documents fail to get."""
    got = labelled_reviews(spark, sf_dir).select("doc_id", F.col("score").cast("int").alias("pred_nb"),
                                                 F.col("score").cast("double").alias("prob_nb"))
    return ensemble.guard_scores(got, "nb").select("doc_id", "pred_nb", "prob_nb", "score_ok_nb")


# -------------------------------------------------- projection on a given basis

BASIS_SIZE = 3


@register("svd_project_formula", with_nb(f"""
, w AS (SELECT tf.doc_id, term, tf.tf * i.idf AS w FROM tf JOIN idf i USING (term)),
x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w),
ranked AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM vocab),
y AS (SELECT doc_id, {', '.join(f'sum(x * ((idx * {c + 3}) % 13 - 6) / 8.0) AS y{c}' for c in range(BASIS_SIZE))}
      FROM x JOIN ranked USING (term) GROUP BY doc_id)
SELECT r.doc_id, {', '.join(f'round(coalesce(y{c}, 0.0), 6) + 0.0 AS y{c}' for c in range(BASIS_SIZE))}
FROM r LEFT JOIN y USING (doc_id)""".replace("\n, w AS", ", w AS", 1)))
def q_svd_project_formula(spark, sf_dir):
    """TF-IDF rows times a basis whose entries follow from the term's rank."""
    index, rows, v = sparse_tfidf(nb_context(spark, sf_dir))
    model = svd_ops.given_basis(spark, index, v, lambda at: np.stack(
        [((at * (c + 3)) % 13 - 6) / 8.0 for c in range(BASIS_SIZE)], axis=1), BASIS_SIZE)
    out = svd_ops.svd_project(rows, model)
    return out.select("doc_id", *((F.round(F.col("svd")[c], 6) + F.lit(0.0)).alias(f"y{c}") for c in range(BASIS_SIZE)))


# ------------------------------------------------ trees on a separating feature

ROUNDS = 20


@register("gbt_separable", f"""
WITH RECURSIVE f AS (SELECT 1 AS trees, 1.0::DOUBLE AS margin UNION ALL
                     SELECT trees + 1, margin + 0.1::DOUBLE * 4.0::DOUBLE / (1.0::DOUBLE + exp(2.0::DOUBLE * margin)) FROM f WHERE trees < {ROUNDS}),
p AS (SELECT 1.0 / (1.0 + exp(-2.0 * margin)) AS p FROM f WHERE trees = {ROUNDS})
SELECT doc_id, CAST(lang = 'en' AS INTEGER) AS pred_gbt,
       round(CASE WHEN lang = 'en' THEN p ELSE 1.0 - p END, 6) AS prob_gbt
FROM documents, p WHERE lang IS NOT NULL""")
def q_gbt_separable(spark, sf_dir):
    """With the label as the only feature every tree is one split, so the margin after each round is known."""
    docs = review_docs(spark, sf_dir).where("score is not null")
    feats = docs.select("doc_id", "score", "is_train", F.array(F.col("score").cast("double")).alias("svd"))
    model = tree_ops.fit_gbt(feats.where(FIT_ROWS), max_iter=ROUNDS, step_size=0.1)
    return tree_ops.score_gbt(feats, model).select("doc_id", "pred_gbt", round6("prob_gbt"))


# ------------------------------------------------ one leaf-wise tree of three leaves

TREE_FEATURES = {"n_chars % 10": lambda: F.col("n_chars") % 10, "n_chars % 7": lambda: F.col("n_chars") % 7,
                 "least(n_chars // 2000, 3)": lambda: F.least(F.floor(F.col("n_chars") / 2000), F.lit(3)), "doc_id % 6": lambda: F.col("doc_id") % 6}


def _best_split(rows: str, leaf: str) -> str:
    """SQL of the best (feature, cut) of each leaf of ``rows``: every cut's gain, ties to the lower feature and cut."""
    left, right = "FILTER (WHERE v <= cut)", "FILTER (WHERE v > cut)"
    return f"""SELECT {leaf} AS leaf, f, cut, n, gain FROM (
  SELECT {leaf}, f, cut, count(*) AS n, count(*) {left} AS nl, count(*) {right} AS nr,
    pow(sum(g) {left}, 2) / sum(h) {left} + pow(sum(g) {right}, 2) / sum(h) {right} - pow(sum(g), 2) / sum(h) AS gain
  FROM {rows} JOIN cuts USING (f) GROUP BY {leaf}, f, cut)
WHERE nl >= 20 AND nr >= 20 QUALIFY row_number() OVER (PARTITION BY {leaf} ORDER BY round(gain, 9) DESC, f, cut) = 1"""


@register("leafwise_tree", f"""
WITH t AS (SELECT doc_id, n_chars, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS y FROM documents WHERE lang IS NOT NULL AND doc_id % 5 <> 0),
s AS (SELECT *, (SELECT avg(y) FROM t) AS p FROM t),
d AS (SELECT doc_id, (p - y)::DOUBLE AS g, (p * (1 - p))::DOUBLE AS h, {', '.join(f'({e})::DOUBLE AS f{i}' for i, e in enumerate(TREE_FEATURES))} FROM s),
u AS ({' UNION ALL '.join(f'SELECT doc_id, 0 AS leaf, g, h, {i} AS f, f{i} AS v FROM d' for i in range(len(TREE_FEATURES)))}),
cuts AS (SELECT f, cut FROM (SELECT DISTINCT f, v AS cut FROM u) QUALIFY cut < max(cut) OVER (PARTITION BY f)),
b0 AS ({_best_split('u', 'leaf')}),
side AS (SELECT doc_id, CASE WHEN u.v <= b0.cut THEN 1 ELSE 2 END AS side FROM u JOIN b0 USING (f)),
u1 AS (SELECT u.* REPLACE (side AS leaf) FROM u JOIN side USING (doc_id)),
b1 AS ({_best_split('u1', 'leaf')}),
b2 AS (SELECT * FROM b1 ORDER BY round(gain, 9) DESC, leaf LIMIT 1),
last AS (SELECT doc_id, CASE WHEN u1.v <= b2.cut THEN 3 ELSE 4 END AS leaf FROM u1 JOIN b2 ON u1.leaf = b2.leaf AND u1.f = b2.f),
place AS (SELECT d.doc_id, g, h, coalesce(last.leaf, side.side) AS leaf FROM d JOIN side USING (doc_id) LEFT JOIN last USING (doc_id)),
inner_nodes AS (SELECT leaf AS node, f, cut, gain, n FROM b0 UNION ALL SELECT leaf, f, cut, gain, n FROM b2)
SELECT node, f AS feature, cut AS threshold, round(gain, 6) AS gain, n AS rows, NULL::DOUBLE AS value FROM inner_nodes
UNION ALL SELECT leaf, -1, NULL, 0.0::DOUBLE, count(*), round(-0.1::DOUBLE * sum(g) / sum(h), 6) FROM place GROUP BY leaf""")
def q_leafwise_tree(spark, sf_dir):
    """The first boosted tree over columns of few values, best-first to three leaves."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND doc_id % 5 <> 0")
    rows = docs.select((F.col("lang") == "en").cast("int").alias("score"), F.array(*(e().cast("double") for e in TREE_FEATURES.values())).alias("x"))
    nodes = boosting.fit_leafwise(rows, "x", trees=1, num_leaves=3).table(spark)
    leaf = F.col("left") < 0
    return nodes.select("node", "feature", F.when(~leaf, F.col("threshold")).alias("threshold"), round6("gain"), "rows",
                        F.when(leaf, F.round("value", 6)).alias("value"))


# -------------------------------------------------------- GRU of one unit

GATES = {"z": (0.9, 0.3, 0.1), "r": (-0.7, 0.5, 0.2), "h": (1.3, -0.8, 0.05)}
OUT = (2.0, -0.1)


def _gate(name: str) -> str:
    w, u, b = GATES[name]
    return f"(1.0 / (1.0 + exp(-({w} * x + {u} * h + {b}))))"


_W, _U, _B = GATES["h"]
_STEP = f"({_gate('z')} * h + (1.0 - {_gate('z')}) * tanh({_W} * x + {_gate('r')} * h * {_U} + {_B}))"


@register("gru_one_unit", f"""WITH {WORD_INDEX_CTES},
ws AS (SELECT doc_id, string_split(cl, ' ') AS ws FROM r),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM ws),
j AS (SELECT p.doc_id, p.pos, coalesce(idx.id, 1) AS id FROM p LEFT JOIN idx USING (word) WHERE length(p.word) > 0),
g AS (SELECT doc_id, list((((id * 7) % 11 - 5) / 10.0)::DOUBLE ORDER BY pos) AS xs FROM j GROUP BY doc_id),
s AS (SELECT ws.doc_id, list_reduce(list_prepend(0.0::DOUBLE, coalesce(xs[:{MAXLEN}], [])), lambda h, x: {_STEP}) AS h
      FROM ws LEFT JOIN g USING (doc_id)),
o AS (SELECT doc_id, 1.0 / (1.0 + exp(-({OUT[0]} * h + {OUT[1]}))) AS prob FROM s)
SELECT doc_id, CAST(prob >= 0.5 AS INTEGER) AS pred_gru, round(prob, 6) AS prob_gru FROM o""")
def q_gru_one_unit(spark, sf_dir):
    """The forward pass over the whole word index with one unit and given weights."""
    index = whole_word_index(spark, sf_dir)
    ids = sequence_ops.encode_sequence(review_docs(spark, sf_dir), index, maxlen=MAXLEN)
    core = {}
    for g, (w, u, b) in GATES.items():
        core |= {f"W{g}": np.array([[w]]), f"U{g}": np.array([[u]]), f"b{g}": np.array([b])}
    core |= {"wo": np.array([OUT[0]]), "bo": np.array([OUT[1]])}
    rows = spark.range(1, index.num_words).select("id", F.array(((F.col("id") * 7) % 11 - 5) / F.lit(10.0)).alias("e"))
    model = gru_ops.GRUModel({n: core[n] for n in gru_ops.CORE_NAMES}, rows, MAXLEN, 0.5)
    return gru_ops.score_gru(ids, model).select("doc_id", "pred_gru", round6("prob_gru"))


# ------------------------------------------------------------------ stream


@register("score_stream_nb", with_nb("SELECT doc_id, pred_nb, round(prob_nb, 6) AS prob_nb FROM scored"))
def q_score_stream_nb(spark, sf_dir) -> DataFrame:
    """The Naive Bayes columns of the scored stream."""
    return stream_output(spark, sf_dir, "stream-nb", nb_bundle).select("doc_id", "pred_nb", round6("prob_nb"))


_SHOWN = """SELECT doc_id, lang, pred_nb, round(prob_nb, 6) AS prob_nb, CASE WHEN pred_nb = 1 THEN 'Positif' ELSE 'Negatif' END AS label_nb,
       CAST(round_even(prob_nb * 100, 0) AS INTEGER) AS percent_nb, true AS score_ok_nb FROM scored JOIN documents USING (doc_id)"""


def _shown(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "lang", "pred_nb", round6("prob_nb"), "label_nb", "percent_nb", "score_ok_nb")


@register("score_rows_nb", with_nb(_SHOWN))
def q_score_rows_nb(spark, sf_dir) -> DataFrame:
    """Every document scored in the task that reads it, while the model fits there, with the label's text and the per cent
    shown for it."""
    return _shown(score_any_rows(table(spark, sf_dir, "documents"), nb_bundle(spark, sf_dir)))


@register("stream_rows_nb", with_nb(_SHOWN))
def q_stream_rows_nb(spark, sf_dir) -> DataFrame:
    """The same rows from a stream of the documents' files, which keeps their columns."""

    def run():
        out, state = scratch_path(spark, "stream-rows-out"), scratch_path(spark, "stream-rows-state")
        score_rows_stream(document_stream(spark, sf_dir), nb_bundle(spark, sf_dir), out, state).awaitTermination()
        return spark.read.parquet(out)

    return _shown(once(spark, sf_dir, "stream-rows", run))


# ------------------------------------------------------ counts of the pass itself


@register("observed_scoring", with_nb("""SELECT (SELECT count(*) FROM documents) AS rows, count_if(d.text IS NULL) AS null_text, count_if(coalesce("""
          + S.is_blank("d.text") + """, false)) AS blank_text, count_if(d.lang IS NULL) AS null_label, count_if(d.lang <> 'en') AS bad_label,
       CAST(sum(pred_nb) AS BIGINT) AS positive, 0::BIGINT AS failed FROM documents d JOIN scored USING (doc_id)"""))
def q_observed_scoring(spark, sf_dir) -> DataFrame:
    """The input report and the score counts of one scoring pass over the documents; a language that is not ``en`` plays
    the label that is neither 0 nor 1."""
    docs = table(spark, sf_dir, "documents").withColumn("label", F.when(F.col("lang") == "en", "1").when(F.col("lang").isNotNull(), "x"))
    metrics = [*observed.input_counts("text", "label"), *observed.score_counts("nb")[1:]]
    counts = observed.run_observed(score_any_rows(docs, nb_bundle(spark, sf_dir), "text"), "scoring", metrics).counts
    return spark.createDataFrame([counts], "rows bigint, null_text bigint, blank_text bigint, null_label bigint, bad_label bigint, positive bigint, failed bigint")


@register("timing_table")
def q_timing_table(spark, sf_dir) -> DataFrame:
    """Published and measured seconds of the three models over the documents, with the counts of the measured passes."""
    from ..operators import boosting, svd
    from .models import sequence_context, trees_context
    nbc, trc, sqc = nb_context(spark, sf_dir), trees_context(spark, sf_dir), sequence_context(spark, sf_dir)
    plans = {"Naive Bayes": ("nb", nbc, naive_bayes.score_nb(nbc.tf_all, nbc.model)),
             "LightGBM": ("gbt", trc, boosting.score_leafwise(svd.svd_project(trc.rows, trc.svd), trc.gbt)),
             "GRU": ("gru", sqc, gru_ops.score_gru(sqc.seqs, sqc.model))}
    stages = {name: observed.run_observed(ensemble.guard_scores(df, m), f"inference-{m}", observed.score_counts(m)) for name, (m, _, df) in plans.items()}
    return observed.timing_table(spark, {name: ctx.extra["fit_s"] for name, (_, ctx, _) in plans.items()}, stages)

"""Model operators against brute-force NumPy / Python computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import evaluate as EV
from reviewlens.operators import gru as G
from reviewlens.operators import naive_bayes as NB
from reviewlens.operators import scoring
from reviewlens.operators import sequence as SEQ
from reviewlens.operators import svd as SVD
from reviewlens.operators import tfidf as TF
from reviewlens.operators.ensemble import apply_threshold, guard_scores, vote

CORPUS = [
    (0, "good great fine good", 1),
    (1, "bad awful bad", 0),
    (2, "great product good seller", 1),
    (3, "awful slow bad service", 0),
    (4, "fine good", 1),
    (5, "x", 0),               # no term of two letters: prior only
]
TEST = [(10, "good bad unknownword", None), (11, "", None), (12, "great great", None)]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, clean string, score int")


def brute_nb(train, test, alpha=1.0):
    """TF-IDF (smooth idf, l2) + multinomial NB written directly in NumPy."""
    tok = lambda s: [w for w in s.split(" ") if len(w) >= 2]
    vocab = sorted({w for _, s, _ in train for w in tok(s)})
    ix = {w: i for i, w in enumerate(vocab)}
    n = len(train)

    def counts(rows):
        m = np.zeros((len(rows), len(vocab)))
        for r, (_, s, _) in enumerate(rows):
            for w in tok(s):
                if w in ix:
                    m[r, ix[w]] += 1
        return m
    df = (counts(train) > 0).sum(axis=0)
    idf = np.log((1 + n) / (1 + df)) + 1

    def tfidf(rows):
        x = counts(rows) * idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    xt = tfidf(train)
    y = np.array([r[2] for r in train])
    fc = np.stack([xt[y == c].sum(axis=0) for c in (0, 1)])
    flp = np.log((fc + alpha) / (fc.sum(axis=1, keepdims=True) + alpha * len(vocab)))
    prior = np.log(np.array([(y == c).sum() / n for c in (0, 1)]))
    jll = tfidf(test) @ flp.T + prior
    p1 = np.exp(jll[:, 1] - np.logaddexp(jll[:, 0], jll[:, 1]))
    return dict(zip(vocab, idf)), jll.argmax(axis=1), p1


def test_tfidf_and_nb_match_brute_force(spark):
    train = _docs(spark, CORPUS)
    train_tf = TF.term_frequencies(train, keep=["score"])
    counts = NB.class_counts(train)
    vocab = TF.fit_tfidf(train_tf, sum(counts.values()))
    model = NB.fit_nb(train_tf, vocab, counts)
    test_rows = CORPUS + TEST
    scored = NB.score_nb(TF.term_frequencies(_docs(spark, test_rows)), model).toPandas()
    scored = scored.set_index("doc_id").loc[[r[0] for r in test_rows]]
    idf, pred, p1 = brute_nb(CORPUS, test_rows)
    got_idf = {r.term: r.idf for r in vocab.table.collect()}
    assert got_idf.keys() == idf.keys()
    assert all(abs(got_idf[k] - idf[k]) < 1e-12 for k in idf)
    np.testing.assert_allclose(scored["prob_nb"].to_numpy(), p1, atol=1e-12)
    assert scored["pred_nb"].tolist() == pred.tolist()


def test_tfidf_rows_have_unit_norm(spark):
    d = _docs(spark, CORPUS)
    tf = TF.term_frequencies(d)
    vocab = TF.fit_tfidf(tf, len(CORPUS))
    norms = TF.tfidf(tf, vocab).groupBy("doc_id").agg(F.sum(F.col("x") ** 2).alias("n2")).collect()
    assert all(abs(r.n2 - 1) < 1e-12 for r in norms)


def test_max_features_keeps_most_frequent(spark):
    d = _docs(spark, CORPUS)
    vocab = TF.fit_tfidf(TF.term_frequencies(d), len(CORPUS), max_features=3)
    # corpus counts: good 4, bad 3, awful 2, great 2 -> ties by term
    assert sorted(r.term for r in vocab.table.collect()) == ["awful", "bad", "good"]


def test_randomized_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    n, v, k = 300, 60, 5
    u, _ = np.linalg.qr(rng.standard_normal((n, v)))
    w, _ = np.linalg.qr(rng.standard_normal((v, v)))
    s = 10.0 * 0.6 ** np.arange(v)
    x = (u * s) @ w.T
    x[np.abs(x) < 0.05] = 0.0
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(a) for a in r[r != 0]])
            for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, idx array<int>, val array<double>")
    model = SVD.fit_svd(df, None, v, k=k)
    exact = np.linalg.svd(x, compute_uv=False)[:k]
    np.testing.assert_allclose(model.singular_values, exact, rtol=1e-6)
    proj = SVD.svd_project(df, model).toPandas().sort_values("doc_id")
    got = np.stack(proj["svd"].to_numpy())
    np.testing.assert_allclose(np.abs(got), np.abs(x @ model.components.T), atol=1e-9)
    # the basis spans the top right singular vectors
    _, _, vt = np.linalg.svd(x)
    np.testing.assert_allclose(np.abs(model.components @ vt[:k].T), np.eye(k), atol=1e-6)


def test_gru_gradient_matches_finite_differences():
    p = G.init_params(12, embed=4, hidden=3, seed=1)
    ids = np.array([[3, 5, 2, 0, 0], [1, 7, 7, 9, 4], [0, 0, 0, 0, 0]])
    y = np.array([1.0, 0.0, 1.0])
    _, g = G.loss_and_grads(p, ids, y)
    rng = np.random.default_rng(3)
    eps = 1e-6
    for name in G.PARAM_NAMES:
        for _ in range(3):
            idx = tuple(rng.integers(0, s) for s in p[name].shape)
            if name == "E":
                idx = (int(rng.choice([1, 2, 3, 4, 5, 7, 9])), idx[1])
            old = p[name][idx]
            p[name][idx] = old + eps
            lp, _ = G.loss_and_grads(p, ids, y)
            p[name][idx] = old - eps
            lm, _ = G.loss_and_grads(p, ids, y)
            p[name][idx] = old
            num = (lp - lm) / (2 * eps)
            assert abs(num - g[name][idx]) < 1e-5 * max(1.0, abs(num)), (name, idx)


def test_gru_padding_is_masked():
    p = G.init_params(10, embed=4, hidden=3, seed=2)
    a = G.forward(p, np.array([[3, 4, 0, 0, 0, 0]]))
    b = G.forward(p, np.array([[3, 4]]))
    np.testing.assert_allclose(a, b)


def test_gru_learns_and_scores_distributed(spark):
    rows = [(i, [2 + (i % 2)] * 3 + [0] * 3, i % 2) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, score int")
    model = G.fit_gru(df, num_words=6, maxlen=6, epochs=8, embed=4, hidden=4, lr=0.05, partitions=2)
    out = G.score_gru(df, model, keep=["score"]).toPandas()
    assert (out["pred_gru"] == out["score"]).all()
    local = G.forward(model.params, np.array([r[1] for r in rows]))
    got = out.set_index("doc_id").loc[[r[0] for r in rows], "prob_gru"].to_numpy()
    np.testing.assert_allclose(got, local, atol=1e-12)


def test_word_index_and_sequences(spark):
    docs = spark.createDataFrame(
        [(0, "b a b c", 1), (1, "a b", 0), (2, "", 0), (3, "d a a e f g h", 1)],
        "doc_id long, clean_light string, score int")
    idx = SEQ.fit_word_index(docs, num_words=5)   # keeps 3 words: a(5) b(3) then c/d.. by name
    table = {r.word: r.id for r in idx.table.collect()}
    assert table == {"a": 2, "b": 3, "c": 4}
    seqs = {r.doc_id: r.ids for r in SEQ.encode_sequence(docs, idx, maxlen=4).collect()}
    assert seqs[0] == [3, 2, 3, 4]          # equal to maxlen
    assert seqs[1] == [2, 3, 0, 0]          # shorter: padded after
    assert seqs[2] == [0, 0, 0, 0]          # empty text
    assert seqs[3] == [1, 2, 2, 1]          # longer: first maxlen, unknown -> 1
    dropped = {r.doc_id: r.ids for r in SEQ.encode_sequence(docs, idx, maxlen=4, oov="drop").collect()}
    assert dropped[3] == [2, 2, 0, 0]


def brute_best_threshold(y, p):
    best = None
    for k in range(1, 100):
        t = k / 100.0
        tp = sum(1 for a, b in zip(y, p) if a == 1 and b >= t)
        fp = sum(1 for a, b in zip(y, p) if a == 0 and b >= t)
        fn = sum(1 for a, b in zip(y, p) if a == 1 and b < t)
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        if best is None or f1 > best[1]:
            best = (t, f1)
    return best


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_best_threshold_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 200).tolist()
    p = np.round(rng.random(200), 2).tolist() if seed == 2 else rng.random(200).tolist()
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    got = EV.best_threshold(df, "y", "p").first()
    t, f1 = brute_best_threshold(y, p)
    assert got.threshold == t and abs(got.f1 - f1) < 1e-12


def test_evaluate_zero_division_and_values(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 1, 0), (1, 0, 0), (0, 0, 0), (None, 1, 0)],
                               "y int, a int, b int")
    r = {x.model: x for x in EV.evaluate(df, "y", {"a": "a", "b": "b"}).collect()}
    assert (r["a"].tp, r["a"].fp, r["a"].fn, r["a"].tn) == (1, 1, 1, 1)
    assert (r["a"].accuracy, r["a"].precision, r["a"].recall, r["a"].f1) == (0.5, 0.5, 0.5, 0.5)
    assert (r["b"].precision, r["b"].recall, r["b"].f1) == (0.0, 0.0, 0.0)


def test_published_f1_is_consistent():
    from reviewlens.sources.experiments import PUBLISHED_METRICS
    for _, _, p, r, f1 in PUBLISHED_METRICS:
        assert abs(2 * p * r / (p + r) - f1) < 6e-4


def test_vote_threshold_and_guard(spark):
    import itertools
    rows = [tuple(x) for x in itertools.product([0, 1], repeat=3)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = [r[0] for r in df.select(vote(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [int(sum(r) >= 2) for r in rows]
    th = spark.createDataFrame([(0.5,), (0.4999,)], "p double")
    assert [r[0] for r in th.select(apply_threshold("p", 0.5)).collect()] == [1, 0]
    g = spark.createDataFrame([(1, 0.9), (None, None)], "pred_nb int, prob_nb double")
    out = guard_scores(g, "nb").collect()
    assert [(r.pred_nb, r.prob_nb, r.score_ok_nb) for r in out] == [(1, 0.9, True), (0, 0.0, False)]


def test_global_rank_is_exact_across_partitions(spark):
    from reviewlens.operators.ranking import global_rank
    rows = [(f"w{i:03d}", (i * 37) % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "word string, count long").repartition(7)
    got = global_rank(df, [F.desc("count"), F.asc("word")], k=50).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:50]
    assert [(r.word, r["count"], r["rank"]) for r in got] == [(w, c, i) for i, (w, c) in enumerate(want)]


def test_svd_chunking_does_not_change_results(spark):
    rng = np.random.default_rng(5)
    x = rng.random((40, 12)) * (rng.random((40, 12)) < 0.4)
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(a) for a in r[r != 0]])
            for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, idx array<int>, val array<double>")
    m = rng.standard_normal((12, 3))
    whole = SVD.gram_times(df, m)
    chunks = list(SVD._chunks(df.toPandas(), max_nnz=7))
    assert sum(len(c) for c in chunks) == 40
    assert all(sum(len(a) for a in c["idx"]) <= 7 or len(c) == 1 for c in chunks)
    np.testing.assert_allclose(whole, x.T @ (x @ m), atol=1e-10)
    by_chunk = np.zeros_like(m)
    for c in chunks:
        idx, val, ptr = SVD._flatten(c)
        by_chunk += SVD.rows_t_times(idx, val, ptr, SVD.rows_times(idx, val, ptr, m), 12)
    np.testing.assert_allclose(by_chunk, whole, atol=1e-10)


def test_svd_holds_blocks_whatever_the_number_of_terms(spark, monkeypatch):
    n_terms = 400_000    # beyond what the driver used to accept
    rng = np.random.default_rng(8)
    at = np.sort(rng.choice(n_terms, 40, replace=False))
    x = (rng.standard_normal((60, 40)) * 2.0 ** -np.arange(40)) * (rng.random((60, 40)) < 0.7)
    rows = [(i, [int(at[j]) for j in np.flatnonzero(r)], [float(a) for a in r[r != 0]]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows + [(60, [], [])], "doc_id long, idx array<int>, val array<double>").repartition(5)
    monkeypatch.setattr(SVD, "BLOCK_BYTES", 4 << 20)
    assert SVD.index_terms(spark.createDataFrame([("a",)], "term string"), n_terms).count() == 1
    model = SVD.fit_svd(df, None, n_terms, k=4, oversample=6)
    np.testing.assert_allclose(model.singular_values, np.linalg.svd(x, compute_uv=False)[:4], rtol=1e-6)
    comps = model.components
    np.testing.assert_allclose(comps @ comps.T, np.eye(4), atol=1e-9)
    assert (comps[np.arange(4), np.abs(comps).argmax(axis=1)] > 0).all()
    want = np.vstack([x @ comps[:, at].T, np.zeros((1, 4))])
    for most in (SVD.BROADCAST_BYTES, 0):    # broadcast, and by blocks
        got = SVD.svd_project(df, model, broadcast_bytes=most).toPandas().sort_values("doc_id")
        np.testing.assert_allclose(np.stack(got["svd"].to_numpy()), want, atol=1e-9)


def test_svd_of_few_documents(spark):
    x = np.array([[1.0, 2.0, 0, 0, 0, 0], [0, 0, 3.0, 0, 0, 0]])
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(a) for a in r[r != 0]]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, idx array<int>, val array<double>")
    model = SVD.fit_svd(df, None, 6, k=4)
    np.testing.assert_allclose(model.singular_values, [3, 5 ** 0.5, 0, 0], atol=1e-6)
    none = SVD.fit_svd(df.limit(0), None, 6, k=2)
    assert none.singular_values.tolist() == [0, 0] and not none.components.any()


def test_naive_bayes_streams_without_the_other_models(spark):
    from reviewlens.plans import catalog, checked, models
    monkey = pytest.MonkeyPatch()
    with monkey.context() as m:
        def fails(*_):
            raise AssertionError("no other model is needed")
        m.setattr(models, "trees_context", fails)
        m.setattr(models, "sequence_context", fails)
        m.setattr(models, "_CACHE", {})
        sf = "/root/testdata/sf0.001"
        assert checked.q_score_stream_nb(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_gru_fit_does_not_depend_on_input_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(1, 6, 4)], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, score int")
    fits = [G.fit_gru(d, num_words=6, maxlen=4, epochs=2, embed=3, hidden=3, partitions=3).params
            for d in (df.coalesce(1), df.repartition(11))]
    for name in fits[0]:
        np.testing.assert_allclose(fits[0][name], fits[1][name], atol=1e-9)


def test_labels_other_than_0_and_1_are_an_error(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (3, None)], "doc_id long, score int")
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        NB.class_counts(df)
    assert NB.class_counts(df.where("doc_id <> 2")) == {0: 0, 1: 1}


def test_scores_beside_inputs(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (2, "b", "y")], "doc_id long, text string, `Shop.Name` string")
    scores = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "doc_id long, pred_nb int, prob_nb double")
    got = scoring.beside_inputs(df, scores)
    assert got.columns == ["doc_id", "text", "Shop.Name", "pred_nb", "prob_nb"]
    assert sorted((r.doc_id, r["Shop.Name"], r.pred_nb) for r in got.collect()) == [(1, "x", 1), (2, "y", 0), (2, "y", 0)]
    assert scoring.beside_inputs(df.limit(0), scores).count() == 0
    with pytest.raises(ValueError, match="PRED_NB"):
        scoring.beside_inputs(df.withColumnRenamed("text", "pred_nb"), scores.withColumnRenamed("pred_nb", "PRED_NB"))


def test_svd_of_three_hundred_components_matches_numpy(spark):
    """The default size on the small table, whose rank is below it: the rest are zeros."""
    from reviewlens.plans import models
    sf = "/root/testdata/sf0.001"
    index, rows, v = models.sparse_tfidf(models.nb_context(spark, sf))
    train = rows.where(models.FIT_ROWS)
    found = SVD.fit_svd(train, index, v, k=300)
    held = train.select("idx", "val").collect()
    x = np.zeros((len(held), v))
    for i, r in enumerate(held):
        x[i, r.idx] = r.val
    exact = np.zeros(300)
    exact[:min(x.shape)] = np.linalg.svd(x, compute_uv=False)[:300]
    np.testing.assert_allclose(found.singular_values, exact, rtol=1e-6, atol=1e-6)
    assert SVD.tile_tasks(rows, 10 ** 9) <= SVD.LEAST_TILES + rows.count()

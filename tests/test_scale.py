"""Steps that hold on tables whose vocabulary is beyond the broadcast bounds: term counts stored by document, norms without
sorted documents, bounded lookups."""

import os
import sys

import duckdb
import numpy as np
import pytest
from conftest import ROOT, SF_SMALL
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(ROOT, "tools"))
from oracle_check import digest  # noqa: E402
from reviewlens.operators import lineage, naive_bayes, sequence, svd, tfidf  # noqa: E402
from reviewlens.plans import catalog, checked, models  # noqa: E402, F401

ROWS = [(1, 1, "good good bad of"), (1, 1, "bad day"), (1, 0, "good"), (2, 0, "a b"), (2, 0, None), (3, None, "day day day"),
        (None, 1, "bad good"), (None, 1, "day"), (4, 1, ""), (5, 0, "awful of of day")]


@pytest.fixture()
def docs(spark):
    """Keys that repeat, with equal and other labels, or are null; texts that are null, empty or of short words alone."""
    return spark.createDataFrame(ROWS, "doc_id long, score int, clean string")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_frequencies_are_the_term_frequencies(docs):
    stored = tfidf.stored_frequencies(docs.repartition(4, "doc_id"), keep=["score"])
    want = tfidf.term_frequencies(docs, keep=["score"])
    assert stored.dtypes == want.dtypes
    assert sorted(map(str, stored.collect())) == sorted(map(str, want.collect()))
    # one row of a document is stored, spread out with neither an exchange nor an aggregate
    assert "Exchange" not in plan_of(stored) and "Aggregate" not in plan_of(stored) and "Generate" in plan_of(stored)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_tfidf_neither_sorts_nor_loses_a_key(docs, how):
    tf = tfidf.stored_frequencies(docs.repartition(4, "doc_id"), keep=["score"])
    vocab = tfidf.fit_tfidf(tf.where("doc_id <> 5"), 6)
    got = tfidf.tfidf(tf, vocab, keep=["score"], how=how)
    assert "Window" not in plan_of(got) and "Sort" not in plan_of(got)
    idf = {r.term: r.idf for r in vocab.table.collect()}
    rows = [r for r in tf.collect() if how == "left" or r.term in idf]
    square = {}
    for r in rows:
        square[r.doc_id] = square.get(r.doc_id, 0.0) + (r.tf * idf.get(r.term, 0.0)) ** 2
    x = {(r.doc_id, r.score, r.term): r.x for r in got.collect()}
    assert len(x) == len(rows) and None in {k[0] for k in x}
    for r in rows:
        have = x[r.doc_id, r.score, r.term]
        assert have is None if r.term not in idf else abs(have - r.tf * idf[r.term] / square[r.doc_id] ** 0.5) < 1e-12


def test_models_of_other_smoothings_share_the_mass(docs):
    tf = tfidf.stored_frequencies(docs.where("doc_id is not null").repartition(4, "doc_id"), keep=["score"]).where("score is not null")
    vocab, counts = tfidf.fit_tfidf(tf, 6), {0: 3, 1: 3}
    mass = naive_bayes.feature_mass(tf, vocab)
    for alpha in (0.1, 1.0):
        with_mass, alone = (naive_bayes.fit_nb(tf, vocab, counts, alpha=alpha, mass=m) for m in (mass, None))
        assert sorted(map(str, with_mass.table.collect())) == sorted(map(str, alone.table.collect()))
        assert with_mass.table.count() == vocab.n_terms


def test_words_beyond_the_sequence_are_not_looked_up(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "b c"), (2, ""), (3, "x a")], "doc_id long, clean_light string")
    index = sequence.fit_word_index(docs.where("doc_id < 3"))
    seen = []

    def counted(left, *args):
        seen.append(left.count())
        return lineage.lookup(left, *args)

    monkeypatch.setattr(sequence, "lookup", counted)
    got = {r.doc_id: list(r.ids) for r in sequence.encode_sequence(docs, index, maxlen=3).collect()}
    ids = {r.word: r.id for r in index.table.collect()}
    pairs = sorted([(0, ids["a"]), (0, ids["b"]), (1, ids["b"]), (1, ids["c"])])
    assert got == {1: [i for _, i in pairs][:3], 2: [0, 0, 0], 3: [1, ids["a"], 0]}
    assert seen == [3 + 2 + 1 + 2]


def test_a_lookup_broadcasts_no_more_than_its_bounds(spark, monkeypatch):
    table = lineage.write_table(spark.range(3000).select(F.concat(F.lit("w"), "id").alias("word"), F.col("id").alias("n")), "lookup-bounds")
    left = table.select("word", "n").withColumnRenamed("n", "at")
    monkeypatch.setattr(lineage, "LOOKUP_ROWS", 100)
    got = lineage.lookup(left, table, "word", 3000, F.col("n"))
    assert lineage.fits_broadcast(table, 3000) and 0 < lineage.stored_hot(table, F.col("n")).count() <= 100
    assert "Exchange hashpartitioning(word" in plan_of(got)
    assert got.where("at = n").count() == 3000


@pytest.mark.parametrize("name", ["vote_nb", "svd_project_formula"])
def test_queries_score_beyond_the_bounds(spark, monkeypatch, name):
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 1_000)
    monkeypatch.setattr(models, "_CACHE", {})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    df = catalog.QUERIES[name](spark, SF_SMALL)
    want = con.sql(catalog.ORACLE[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(want.columns, want.fetchall())[0]


def test_svd_sends_no_term_of_a_single_entry(spark):
    """Such terms are dealt with where their document is: the iterate has a row for each document instead of one for each of them."""
    rng = np.random.default_rng(4)
    n, shared, own = 60, 5, 30
    x = np.zeros((n, shared + n * own))
    x[:, :shared] = rng.random((n, shared)) * (rng.random((n, shared)) < 0.8)
    for i in range(n - 1):    # the last document has none
        x[i, shared + i * own:shared + (i + 1) * own] = rng.random(own) / (1 + i)
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(a) for a in r[r != 0]]) for i, r in enumerate(x)] + [(None, [0], [1.0]), (3, [], [])]
    x = np.vstack([x, np.eye(1, x.shape[1]), np.zeros((1, x.shape[1]))])
    df = spark.createDataFrame(rows, "doc_id long, idx array<int>, val array<double>")
    m = rng.standard_normal((x.shape[1], 3))
    matrix = svd.Matrix.of(df, *m.shape)
    assert matrix.gram_times(3, start=lambda terms: m[terms]).count() == shared + n - 1
    np.testing.assert_allclose(svd.gram_times(df, m), x.T @ (x @ m), atol=1e-10)
    model = svd.fit_svd(svd.in_parts(df, 3, "doc_id"), None, x.shape[1], k=4)
    np.testing.assert_allclose(model.singular_values, np.linalg.svd(x, compute_uv=False)[:4], rtol=1e-4)
    basis = model.components.T
    np.testing.assert_allclose(basis.T @ basis, np.eye(4), atol=1e-9)
    for parts, most in ((df, 0), (svd.in_parts(df, 3, "doc_id"), 0), (df, 1 << 30)):
        got = {r["doc_id"]: r["svd"] for r in svd.svd_project(parts, model, broadcast_bytes=most).where("doc_id <> 3 OR doc_id IS NULL").collect()}
        assert len(got) == n
        for i, r in enumerate(rows[:-1]):
            if r[0] != 3:
                np.testing.assert_allclose(got[r[0]], x[i] @ basis, atol=1e-9)


@pytest.mark.parametrize("keep", [["score"], []])
def test_sparse_rows_of_a_part_look_its_terms_up_there(spark, docs, keep):
    """The rows by parts are those of the join; a part's terms are looked up once, its documents move as they are stored."""
    packed = tfidf.packed_frequencies(docs.repartition(4, "doc_id"), keep=["score"])
    tf = tfidf.spread(packed, keep=["score"])
    vocab = tfidf.fit_tfidf(tf.where("doc_id <> 5"), 6)
    index = svd.index_terms(vocab.table, vocab.n_terms)
    want = svd.sparse_rows(tfidf.tfidf(tf, vocab, keep=["score"], how="left"), index, vocab.n_terms, keep=keep)
    shown = lambda df: sorted(str((r["doc_id"], *(r[c] for c in keep), r["idx"], [round(x, 12) for x in r["val"]])) for r in df.collect())
    for stored in (True, False):
        got = svd.sparse_parts(packed, vocab, index, 3, keep=keep, stored=stored)
        assert (svd.PART in got.columns) == stored and shown(got) == shown(want)
    none = svd.sparse_parts(packed.limit(0), vocab, index, 3, keep=keep)
    assert none.count() == 0


def test_a_large_iterate_travels_in_arrays_and_single_precision(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.random((50, 40)) * (rng.random((50, 40)) < 0.4)
    df = spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(r)], [float(a) for a in r[r != 0]]) for i, r in enumerate(x)],
                               "doc_id long, idx array<int>, val array<double>")
    parts = svd.in_parts(df, 3, "doc_id")
    alone = svd.fit_svd(parts, None, 40, k=4).singular_values
    monkeypatch.setattr(svd, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(svd, "BUCKET_BYTES", 1000)
    kinds, sent = [], svd.Iterate.messages
    monkeypatch.setattr(svd.Iterate, "messages", lambda it: kinds.append((it.kind, it.packed.count(), sent(it).count())) or sent(it))
    found = svd.fit_svd(parts, None, 40, k=4)
    np.testing.assert_allclose(found.singular_values, alone, rtol=1e-9)
    np.testing.assert_allclose(found.components @ found.components.T, np.eye(4), atol=1e-9)
    # the result comes from the last pass, in double; a message holds a part's rows of a bucket of terms
    assert [k for k, _, _ in kinds] == [svd.SINGLE] * 4 + [svd.DOUBLE]
    assert all(n <= 10 and m <= 3 * n for _, n, m in kinds)


def test_text_models_fit_no_naive_bayes(spark, monkeypatch, tmp_path):
    """The GRU's queries and the trees on the label read the prepared texts alone."""
    rows = [(i, f"{'good' if i % 2 else 'bad'} day {i % 5}", "en" if i % 2 else "fr" if i % 4 else None, "web", 9) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(models, "_CACHE", {})
    monkeypatch.setattr(models, "build_nb", None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("gru_one_unit", "gbt_separable", "fit_word_index", "encode_sequence"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalog.ORACLE[name])
        assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(want.columns, want.fetchall())[0]
    for name in ("fit_gru", "score_gru", "class_distribution_gru", "top_tokens_gru"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count()


def test_a_gram_matrix_runs_its_shuffles_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch.select(["z"])

    z = np.arange(6.0)
    rows = spark.createDataFrame([(i, bytearray((z + i).tobytes())) for i in range(8)], "i long, z binary").mapInArrow(
        lambda batches: ((runs.add(b.num_rows), b)[1] for b in batches), "i long, z binary").repartition(3, "i").mapInArrow(task, "z binary")
    runs.value = 0
    m = np.stack([z + i for i in range(8)])
    np.testing.assert_allclose(svd.gram(rows, 6, n_parts=3), m.T @ m)
    assert runs.value == 16


def test_sums_of_a_lookup_read_the_rows_once(spark, monkeypatch):
    left = spark.range(9000).select("id", (F.col("id") % 5).alias("tf"), F.when(F.col("id") % 3 == 0, F.lit("the")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("w"), (F.col("id") % 2999).cast("string"))).alias("word"), F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("doc"))
    # rows that come twice, and a group whose words the table does not have
    left = left.unionByName(left.where("id < 200")).unionByName(spark.sql("SELECT 1L AS id, 2L AS tf, 'none' AS word, 77L AS doc"))
    table = left.where("word is not null").groupBy("word").agg(F.count("*").cast("double").alias("n")).where("word not in ('w7', 'none')")
    table = lineage.write_table(table, "lookup-sums-test")
    sums = {"s": F.col("tf") * F.col("n"), "q": F.col("tf") * F.col("tf") * F.col("n")}
    want = left.join(table, "word", "left").groupBy("doc").agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect()
    assert (77, None, None) in {tuple(r) for r in want}
    for most in (50, 100_000):
        monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", most)
        got = lineage.lookup_sums(left, table, "word", table.count(), F.col("n"), ["doc"], ["tf"], sums)
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
        kept = lineage.checkpoint_partitioned(left.repartition(4, "doc"))
        plan = plan_of(lineage.lookup_sums(kept, table, "word", table.count(), F.col("n"), ["doc"], ["tf"], sums))
        assert plan.count("Scan ExistingRDD") == 1


def test_models_of_one_pass_score_as_each_alone(docs, monkeypatch):
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 2)
    tf = tfidf.stored_frequencies(docs.repartition(4, "doc_id"), keep=["score"])
    train = tf.where("score is not null and doc_id is not null")
    vocab, counts = tfidf.fit_tfidf(train, 6), {0: 3, 1: 3}
    table, fitted = naive_bayes.fit_nb_each(train, vocab, counts, {"a": 0.1, "b": 1.0})
    both = naive_bayes.score_nb_each(tf, table, fitted, keep=["score"])
    near = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    for name, alpha in {"a": 0.1, "b": 1.0}.items():
        alone = naive_bayes.score_nb(tf, naive_bayes.fit_nb(train, vocab, counts, alpha=alpha), keep=["score"])
        assert near(both.select("doc_id", "score", f"pred_{name}", f"prob_{name}").collect()) == near(alone.collect())


def test_votes_read_the_term_counts_once(spark, monkeypatch):
    """The three smoothings are scored by one pass over the stored counts."""
    monkeypatch.setattr(models, "_CACHE", {})
    passes, one = [], naive_bayes.lookup_sums
    monkeypatch.setattr(naive_bayes, "lookup_sums", lambda *a: passes.append(a[5]) or one(*a))
    models.nb_context(spark, SF_SMALL)
    before = len(passes)
    models.smoothing_votes(spark, SF_SMALL)
    assert len(passes) - before == 1


def test_batches_of_a_stream_store_their_counts(spark, monkeypatch):
    """Scores of Naive Bayes alone come from stored counts, which no branch makes anew."""
    from reviewlens.operators import scoring
    rows = spark.createDataFrame([(i, f"good w{i} the") for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(models, "_CACHE", {})
    monkeypatch.setattr(lineage, "MAX_BROADCAST_ROWS", 1_000)
    plan = plan_of(scoring.score_prepared(scoring.prepare(rows), models.nb_bundle(spark, SF_SMALL)))
    assert plan.count("Scan ExistingRDD") == 1 and "regexp_replace" not in plan


def test_inputs_beside_scores_are_not_sorted(spark):
    from reviewlens.operators.scoring import beside_inputs
    rows = spark.range(100).selectExpr("id AS doc_id", "repeat('x', 10) AS text")
    plan = plan_of(beside_inputs(rows, rows.selectExpr("doc_id", "1 AS pred")))
    assert "Sort" not in plan and "ShuffledHashJoin" in plan


def test_cleaning_skips_no_url_and_no_mention(spark):
    from reviewlens.functions import text as T
    texts = ["HTTP://A.b c", "WWW.x.y z", "wwW. k", "a@b_C d", "#tag e", "://f", "http:/ g", "www h", "İ@I j", "@http://q w", "#www.k l", "", None, "plain Text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = T.text_lower("t")
    want_ml, want_light = T.letters_only(T.strip_mentions(T.strip_urls(low))), T.letters_only(T.strip_urls(low))
    for r in df.select(T.clean_ml("t").alias("a"), want_ml.alias("b"), T.clean_light("t").alias("c"), want_light.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)


def test_evaluate_counts_every_labelled_row(spark, monkeypatch, tmp_path):
    """Both folds, the held-out one by itself; only rows without a label stay out."""
    rows = [(i, f"{'good' if i % 2 else 'bad'} day {i % 7}", "en" if i % 2 else "fr" if i % 4 else None, "web", 9) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(models, "_CACHE", {})
    df = catalog.QUERIES["evaluate"](spark, str(tmp_path))
    got = {r["fold"]: r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in df.collect()}
    labelled = [r[0] for r in rows if r[2] is not None]
    assert got == {"validation": sum(i % 5 == 0 for i in labelled), "train": sum(i % 5 > 0 for i in labelled)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(catalog.ORACLE["evaluate"])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(want.columns, want.fetchall())[0]


def test_sequences_are_stored_before_they_are_scored(spark, monkeypatch):
    """The shards of a large embedding read a document's words three times, which are looked up once."""
    from types import SimpleNamespace as Of

    from reviewlens.operators import scoring
    docs = spark.createDataFrame([(1, "good day", "a good day"), (2, "bad", "a bad one"), (3, "", "")], "doc_id long, clean string, clean_light string")
    for module, name in ((scoring.nb_ops, "score_nb"), (scoring.svd_ops, "sparse_parts"), (scoring.svd_ops, "svd_project"), (scoring.boosting, "score_leafwise")):
        monkeypatch.setattr(module, name, lambda *a, **k: docs)
    met = []

    def scored(seqs, *a, **k):
        met.append(seqs)
        raise LookupError

    monkeypatch.setattr(scoring.gru_ops, "score_gru", scored)
    models = scoring.ModelBundle(None, None, None, Of(side=svd.Side(4, 2, 1)), Of(), sequence.fit_word_index(docs), Of(maxlen=4))
    with pytest.raises(LookupError):
        scoring.score_prepared(docs, models)
    plan = plan_of(met[0])
    assert "Scan ExistingRDD" in plan and "Generate" not in plan and "Exchange" not in plan
    assert {r.doc_id: len(r.ids) for r in met[0].collect()} == {1: 4, 2: 4, 3: 4}

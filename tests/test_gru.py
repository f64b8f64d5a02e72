"""The row-sparse GRU: against a dense fit over whole matrices, by shards and by broadcast, and on odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import gru as G


@pytest.fixture(scope="module")
def rows(spark):
    """Sequences over 60 words, of which a few are frequent; some words occur in one row only."""
    rng = np.random.default_rng(5)
    made = []
    for i in range(300):
        n = int(rng.integers(0, 9))
        ids = [int(min(59, 1 + rng.zipf(1.6))) for _ in range(n)] + [0] * (8 - n)
        made.append((i, ids, int(3 in ids or i % 7 == 0)))
    return spark.createDataFrame(made, "doc_id long, ids array<int>, score int")


def dense_fit(df, shards, num_words, maxlen, epochs, embed, hidden, batch, lr, seed):
    """Model averaging over whole V x embed matrices: every shard has all rows of the matrix and both moments."""
    keyed = df.withColumn("k", F.xxhash64("doc_id")).withColumn("s", F.pmod("k", F.lit(shards))).orderBy("s", "k").collect()
    p = G.init_params(num_words, embed, hidden, seed)
    best, best_loss = p, np.inf
    for epoch in range(epochs):
        sums = {k: np.zeros_like(v) for k, v in p.items()}
        met, total, loss = np.zeros(num_words), 0, 0.0
        for shard in range(shards):
            mine = [r for r in keyed if r.s == shard]
            if not mine:
                continue
            q = {k: v.copy() for k, v in p.items()}
            m, v = ({k: np.zeros_like(x) for k, x in q.items()} for _ in range(2))
            steps, rng = np.zeros(num_words), np.random.default_rng([seed, epoch, shard])
            x, y = np.array([r["ids"] for r in mine]), np.array([r.score for r in mine], float)
            order = rng.permutation(len(y))
            for t, s in enumerate(range(0, len(y), batch), 1):
                sel = order[s:s + batch]
                step_loss, g = G.loss_and_grads(q, x[sel], y[sel])
                loss += step_loss
                held = np.zeros(num_words, bool)
                held[x[sel].ravel()] = True
                held[0] = False
                steps += held
                for k in q:
                    gk = g[k] / len(sel)
                    new_m, new_v = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                    if k == "E":
                        at = held[:, None]
                        m[k], v[k] = np.where(at, new_m, m[k]), np.where(at, new_v, v[k])
                        n = np.maximum(steps, 1)[:, None]
                        q[k] = np.where(at, q[k] - lr * (m[k] / (1 - 0.9 ** n)) / (np.sqrt(v[k] / (1 - 0.999 ** n)) + 1e-8), q[k])
                    else:
                        m[k], v[k] = new_m, new_v
                        q[k] = q[k] - lr * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
            seen = steps > 0
            met += seen * len(y)
            total += len(y)
            for k in q:
                sums[k] += q[k] * len(y) * (seen[:, None] if k == "E" else 1)
        if loss / total < best_loss:
            best, best_loss = p, loss / total
        else:
            return best
        p = {k: np.where(met[:, None] > 0, s / np.maximum(met, 1)[:, None], p["E"]) if k == "E" else s / total for k, s in sums.items()}
    return p


@pytest.mark.parametrize("shards", [1, 4])
def test_sparse_fit_equals_the_dense_fit(rows, shards):
    model = G.fit_gru(rows, 60, 8, epochs=3, embed=5, hidden=4, batch=16, partitions=shards, seed=7)
    want = dense_fit(rows, shards, 60, 8, 3, 5, 4, 16, 0.01, 7)
    for name, got in model.params.items():
        if name == "E":
            got, want[name] = got[1:], want[name][1:]  # padding has no vector
        np.testing.assert_allclose(got, want[name], atol=1e-9, err_msg=name)


def test_a_task_gets_a_vector_once_for_all_its_shards(rows, monkeypatch):
    fed, feed = [], G.shard_feed
    monkeypatch.setattr(G, "shard_feed", lambda *a: fed.append(a) or feed(*a))
    monkeypatch.setattr(G, "BUCKET_BYTES", 500)
    model = G.fit_gru(rows, 60, 8, epochs=2, embed=5, hidden=4, batch=16, partitions=40, seed=7)
    _, words, _, shards, tasks = fed[1]
    assert tasks < shards == 40
    got = [(r[G.TASK], x) for r in words.collect() for x in np.frombuffer(r[G.WORDS], np.int64)]
    assert len(got) == len(set(got)) and {x for _, x in got} == {x for r in rows.collect() for x in r["ids"]} - {0}
    want = dense_fit(rows, 40, 60, 8, 2, 5, 4, 16, 0.01, 7)
    for name, have in model.params.items():
        np.testing.assert_allclose(have[name == "E":], want[name][name == "E":], atol=1e-9, err_msg=name)


def test_only_words_of_the_rows_get_a_vector(rows):
    model = G.fit_gru(rows, 10 ** 9, 8, epochs=1, embed=3, hidden=3)
    met = {x for r in rows.collect() for x in r["ids"]} - {0}
    assert {r["id"] for r in model.rows.collect()} == met


def test_shards_grow_with_the_rows(rows, monkeypatch):
    seen = []
    feed = G.shard_feed
    monkeypatch.setattr(G, "shard_feed", lambda *a: seen.append(a[3]) or feed(*a))
    monkeypatch.setattr(G, "ROWS_PER_SHARD", 50)
    G.fit_gru(rows, 60, 8, epochs=1, embed=2, hidden=2)
    G.fit_gru(rows.unionAll(rows), 60, 8, epochs=1, embed=2, hidden=2)
    assert seen == [6, 12]


def test_a_task_holds_its_shards_words_only(rows):
    """Words reach a shard once, before its sequences, and no shard gets another's."""
    data = rows.select(F.col("ids").alias(G.IDS), F.xxhash64("doc_id").alias(G.ORDER), (F.col("doc_id") % 5).cast("int").alias(G.SHARD))
    feed = G.shard_feed(data, G.shard_words(data), None, 5)
    got = feed.withColumn("at", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    for shard in range(5):
        mine = [r for r in got if r[G.SHARD] == shard]
        kinds = [r[G.KIND] for r in mine]
        assert len({r["at"] for r in mine}) == 1 and kinds == sorted(kinds)
        words = [r[G.ORDER] for r in mine if r[G.KIND] == 0]
        assert words == sorted({x for r in mine if r[G.KIND] == 1 for x in r[G.IDS]} - {0})


def test_broadcast_and_shards_give_the_same_scores(rows, monkeypatch):
    model = G.fit_gru(rows.where("doc_id < 200"), 60, 8, epochs=2, embed=4, hidden=4)
    wanted = G.forward(model.params, np.array([r["ids"] for r in rows.orderBy("doc_id").collect()]))
    small = [r.prob_gru for r in G.predict_proba(rows, model, keep=["score"]).orderBy("doc_id").collect()]
    monkeypatch.setattr(G, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(G, "ROWS_PER_SHARD", 37)
    model._sent.clear()
    large = G.predict_proba(rows, model, keep=["score"]).orderBy("doc_id").collect()
    np.testing.assert_allclose(small, wanted, atol=1e-12)
    np.testing.assert_allclose([r.prob_gru for r in large], wanted, atol=1e-12)
    assert large[0].asDict().keys() == {"doc_id", "score", "prob_gru"}


def test_gru_odd_input(spark, rows):
    none = G.fit_gru(rows.limit(0), 60, 8, epochs=2, embed=3, hidden=3)
    assert none.rows.count() == 0
    got = [r.prob_gru for r in G.predict_proba(rows, none).collect()]
    assert len(got) == 300 and all(0 < p < 1 for p in got)
    assert G.predict_proba(rows.limit(0), none).count() == 0
    blank = spark.createDataFrame([(1, [0] * 8, 1), (2, [0] * 8, 0)], "doc_id long, ids array<int>, score int")
    assert G.fit_gru(blank, 60, 8, epochs=2, embed=3, hidden=3).rows.count() == 0
    named = spark.createDataFrame([("a:1", [1] * 8), (None, [2] * 8)], "key string, ids array<int>")
    assert G.predict_proba(named, none, key="key").count() == 2


def stepwise(p, ids):
    """The cell of the module's head, a row and a word at a time."""
    sig = lambda a: 1.0 / (1.0 + np.exp(-a))
    out = []
    for row in ids:
        h = np.zeros(len(p["Uz"]))
        for i in row[row != 0]:
            x = p["E"][i]
            z, r = (sig(x @ p["W" + g] + h @ p["U" + g] + p["b" + g]) for g in "zr")
            h = z * h + (1 - z) * np.tanh(x @ p["Wh"] + (r * h) @ p["Uh"] + p["bh"])
        out.append(sig(h @ p["wo"] + p["bo"][0]))
    return np.array(out)


def test_steps_hold_words_only():
    """Padding after the last word costs no step; padding between words and rows without a word keep their meaning."""
    rng = np.random.default_rng(7)
    p = G.init_params(30, embed=5, hidden=4, seed=3)
    p["E"] *= 40
    ids = rng.integers(1, 30, (G.BLOCK_ROWS + 9, 12))
    ids[np.arange(12) >= rng.integers(0, 13, len(ids))[:, None]] = 0
    assert len(G._Steps(ids).ids) == (ids != 0).sum()
    ids[3], ids[5] = 0, [4, 0, 0, 7, 2, 0, 9, 0, 0, 0, 0, 0]
    np.testing.assert_allclose(G.forward(p, ids), stepwise(p, ids), atol=1e-12)
    np.testing.assert_allclose(G.forward(p, ids[5:6]), G.forward(p, np.array([[4, 7, 2, 9]])), atol=1e-12)
    y = rng.integers(0, 2, len(ids)).astype(float)
    whole, each = G.loss_and_grads(p, ids, y), [G.loss_and_grads(p, ids[i:i + 1], y[i:i + 1]) for i in range(len(ids))]
    assert abs(whole[0] - sum(loss for loss, _ in each)) < 1e-9
    for name in G.PARAM_NAMES:
        np.testing.assert_allclose(whole[1][name], sum(g[name] for _, g in each), atol=1e-10)
    assert G.forward(p, ids[:0]).shape == (0,)

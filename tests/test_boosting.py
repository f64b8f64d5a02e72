"""Leaf-wise boosting: tree by tree against a booster that recounts every leaf, and on odd input."""

import numpy as np
import pytest

from reviewlens.operators import boosting as B


def brute_booster(x, y, cuts, trees, num_leaves, rate, least_rows, least_hessian, l2):
    """One leaf split at a time, every histogram recounted from the rows."""
    bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1)
    share = y.mean()
    raw, out = np.full(len(y), np.log(share / (1 - share))), []

    def best(rows, g, h):
        found = (0.0, None)
        for f, c in enumerate(cuts):
            for b in range(len(c)):
                go = bins[rows, f] <= b
                a, z = rows[go], rows[~go]
                if min(len(a), len(z)) < least_rows or min(h[a].sum(), h[z].sum()) < least_hessian:
                    continue
                gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[z].sum() ** 2 / (h[z].sum() + l2) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                if gain > found[0] + 1e-9:
                    found = (gain, (f, b))
        return found

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        leaves = [np.arange(len(y))]
        known = [best(leaves[0], g, h)]
        splits = []
        while len(leaves) < num_leaves:
            at = max(range(len(leaves)), key=lambda i: known[i][0])
            if known[at][1] is None:
                break
            (f, b), rows = known[at][1], leaves[at]
            go = bins[rows, f] <= b
            splits.append((f, cuts[f][b], len(rows), int(go.sum())))
            leaves[at], known[at] = rows[go], best(rows[go], g, h)
            leaves.append(rows[~go])
            known.append(best(rows[~go], g, h))
        if not splits:
            break
        for rows in leaves:
            raw[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
        out.append(splits)
    return out, raw


def splits_of(tree):
    """Splits in the order they were made: the left child's number tells it."""
    inner = sorted(np.flatnonzero(tree.left >= 0), key=lambda i: tree.left[i])
    return [(int(tree.feature[i]), float(tree.threshold[i]), int(tree.rows[i]), int(tree.rows[tree.left[i]])) for i in inner]


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "doc_id long, svd array<double>, score int")


@pytest.mark.parametrize("seed,num_leaves,l2", [(0, 8, 0.0), (1, 15, 1.0), (2, 3, 0.0)])
def test_equals_a_booster_that_recounts(spark, seed, num_leaves, l2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((400, 4)), 1 + seed)
    y = ((x[:, 0] * x[:, 1] > 0.1) ^ (rng.random(400) < 0.1)).astype(int)
    df = table(spark, x, y).repartition(5)
    cuts = B.quantile_cuts(df, "svd", 4, 32)
    assert all(len(c) < 32 and (np.diff(c) > 0).all() for c in cuts)
    model = B.fit_leafwise(df, trees=12, num_leaves=num_leaves, least_rows=10, l2=l2, max_bin=32)
    want, raw = brute_booster(x, y, cuts, 12, num_leaves, 0.1, 10, 1e-3, l2)
    assert [splits_of(t) for t in model.trees] == want
    got = {r.doc_id: r for r in B.score_leafwise(df, model, keep=["score"]).collect()}
    np.testing.assert_allclose([got[i].prob_gbt for i in range(400)], 1 / (1 + np.exp(-raw)), atol=1e-9)
    assert all(got[i].pred_gbt == int(got[i].prob_gbt > 0.5) for i in range(400))


def test_passes_are_fewer_than_splits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 3))
    df = table(spark, x, (np.sin(3 * x[:, 0]) + x[:, 1] > 0).astype(int))
    calls, real = [], B.histograms
    monkeypatch.setattr(B, "histograms", lambda *a: calls.append(len(a[3])) or real(*a))
    model = B.fit_leafwise(df, trees=1, num_leaves=16, least_rows=5)
    assert (model.trees[0].left < 0).sum() == 16 and len(calls) <= 10 < 16


def test_model_table_round_trip(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 3))
    df = table(spark, x, (x[:, 2] > 0).astype(int))
    model = B.fit_leafwise(df, trees=3, num_leaves=4, least_rows=5)
    again = B.model_from(model.base, model.table(spark))
    a, b = (sorted((r.doc_id, r.prob_gbt) for r in B.score_leafwise(df, m).collect()) for m in (model, again))
    assert a == b


def test_odd_input(spark):
    df = spark.createDataFrame([(i, [float(i), float("nan") if i % 3 else 1.0], i % 2 if i < 90 else None) for i in range(100)], "doc_id long, svd array<double>, score int")
    model = B.fit_leafwise(df, trees=2, least_rows=5, num_leaves=4)
    assert B.score_leafwise(df, model).count() == 100
    missing = spark.createDataFrame([(1, None), (2, [None, 2.0])], "doc_id long, svd array<double>")
    assert all(0 < r.prob_gbt < 1 for r in B.score_leafwise(missing, model).collect())
    one_label = B.fit_leafwise(df.where("score = 1"))
    assert not one_label.trees and B.score_leafwise(df, one_label).first().pred_gbt == 1
    none = B.fit_leafwise(df.limit(0))
    assert not none.trees and {r.prob_gbt for r in B.score_leafwise(df, none).collect()} == {0.5}
    assert B.score_leafwise(df.limit(0), model).count() == 0
    flat = B.fit_leafwise(spark.createDataFrame([(i, [1.0], i % 2) for i in range(60)], "doc_id long, svd array<double>, score int"))
    assert not flat.trees

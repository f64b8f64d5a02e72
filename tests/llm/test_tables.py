"""Vectors, mixing, rollups and the pipeline: against brute force and odd rows."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL as SF
from llm_fixtures import nothing, odd  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlens.llm import bpe, catalog, mixing, neighbours, rollup, secrets, simhash, toxicity, vafile
from reviewlens.llm.common import crc_mod
from reviewlens.llm.components import components

VECTORS = "vec_id bigint, embedding array<double>, n_links int, component_id int"


def brute_links(rows, threshold):
    """rows: (id, vector or None)."""
    def fit(i, v):
        return i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, root = {k: 0 for k in range(len(rows))}, {k: rows[k][0] for k in range(len(rows))}
    linked = []
    for a in range(len(rows)):
        for b in range(a):
            (i, x), (j, y) = rows[a], rows[b]
            if fit(i, x) and fit(j, y) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold or (x == y).all():
                    links[a] += 1
                    links[b] += 1
                    linked.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return sorted(((rows[k][0], links[k], root[k]) for k in links), key=str)


def near_copies(rng, n, dims, groups):
    base = rng.normal(size=(groups, dims))
    out = []
    for i in range(n):
        v = base[rng.integers(groups)] if rng.random() < 0.6 else rng.normal(size=dims)
        out.append((i, [float(x) for x in v + rng.normal(size=dims) * rng.choice([0, 0.05, 0.15, 0.3])]))
    return out


@pytest.mark.parametrize("dims,tile", [(64, 4096), (64, 16), (5, 32), (20, 4096), (1, 4096)])
def test_neighbours_against_brute_force(spark, dims, tile):
    rows = near_copies(np.random.default_rng(dims), 260, dims, 6)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS)
    got = neighbours.near_duplicates(df, 0.95, tile=tile).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [1.0, None]), (5, [1.0, inf]), (6, [1.0, 1.0]), (7, [1.0, 1.0]),
            (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1e200, 1e200]), (10, [-1.0, -1.0]), (11, [1.0, 1.0, 1.0]), (12, [1e-200, 1e-200]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS)
    got = neighbours.near_duplicates(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert all(by[i][0].n_links == 0 and by[i][0].component_id == i and by[i][0].kept for i in (0, 1, 2, 3, 4, 5, 10, 11))
    assert [r.n_links for r in by[7]] == [5, 5] and {by[i][0].component_id for i in (6, 7, 8, 9, 12)} == {6}
    assert by[None][0].n_links == 0 and by[None][0].component_id is None and not by[None][0].kept
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_op3_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in catalog.op3_embedding_neardup(spark, SF).collect()), key=str)
    assert got == brute_links(rows, 0.95)


@pytest.mark.parametrize("dims", [3, 8, 64])
def test_pigeonhole_misses_no_pair(dims):
    rng = np.random.default_rng(dims)
    x = neighbours._unit(rng.normal(size=(400, dims)))
    y = neighbours._unit(x + rng.normal(size=x.shape) * 0.3 / np.sqrt(dims))
    close = np.einsum("ij,ij->i", x, y) >= 0.95
    assert close.sum() > 20
    rx, ry = x @ neighbours.rotation(dims), y @ neighbours.rotation(dims)
    met = np.zeros(len(x), bool)
    for block, budget in zip(neighbours.blocks(dims), neighbours.budgets(dims, 0.95)):
        a, b = neighbours.cells(rx[:, block], budget), neighbours.cells(ry[:, block], budget)
        cells_x, cells_y = set(zip(a[0], a[1], a[2])), set(zip(b[0], b[1], b[2]))
        near = ((rx[:, block] - ry[:, block]) ** 2).sum(axis=1) <= budget
        for i in np.flatnonzero(near & close):
            together = [c for (k, c, own) in cells_x if k == i and ((i, c, True) in cells_y or (own and (i, c, False) in cells_y))]
            assert len(together) == 1  # exactly one cell compares them
            met[i] = True
    assert met[close].all()


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 300)] + [(5, 5), (900, 7), (7, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in (7, 900, *range(200, 300))) and 5 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---------------------------------------------------------------- exact search

def brute_top(rows, k, mod=20):
    whole = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in whole:
        if q % mod == 0:
            best = sorted((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_op10_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert sorted(tuple(r) for r in catalog.op10_topk(spark, SF).collect()) == brute_top(rows, 20)


def test_topk_ties_files_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, float("nan"), 0.0, 0.0]), (1002, [1.0, None, 0.0, 0.0]), (1003, []), (None, [1.0, 1.0, 1.0, 1.0]), (1020, [1.0, 2.0])]
    monkeypatch.setattr(vafile, "FILE_ROWS", 40)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 6)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS)
    got = vafile.top_k(df, F.col("vec_id") % 20 == 0, 7)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 7)
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0], 0, 0), (1, [2.0], 0, 0), (2, [2.0], 0, 0)], VECTORS)
    assert sorted(tuple(r) for r in vafile.top_k(few, F.col("vec_id") == 0, 20).collect()) == [(0, 1, 1, 64 * 128), (0, 2, 2, 64 * 128)]


def test_file_scan_reads_few_exact_vectors():
    rng = np.random.default_rng(6)
    x = rng.integers(-60, 60, (5000, 16))
    cell, low, width = vafile.quantise(x)
    assert (np.abs(low + (cell + 0.5) * width - x) <= width / 2 + 1e-9).all()
    for q, rows, scores in vafile.search_file(x[:5], np.arange(5), x, np.arange(5000), 10):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(5000) if i != q)[:10]
        assert [(-s, i) for s, i in zip(scores, rows)] == want


# ---------------------------------------------------------------- mixing

def test_rates_meet_targets(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    table = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(400)], "doc_id bigint, n_tokens bigint, p0 double, p1 double, p2 double")
    targets = n.sum() * np.array([0.7, 0.2, 0.1])
    steps, totals = mixing.fit_rates(table, targets)
    assert np.abs(totals - targets).sum() <= 1e-3 * targets.sum()
    rates = np.array([r.rate for r in table.withColumn("rate", mixing.rate_of(steps, 0.0, 16.0)).orderBy("doc_id").collect()])
    assert (rates >= 0).all() and np.allclose((rates * n) @ p, totals)
    # brute force: projected gradient in numpy
    weight, r = np.linalg.inv((p * n[:, None]).T @ p), np.ones(400)
    for _ in range(2000):
        r = np.clip(r - p @ (weight @ ((r * n) @ p - targets)), 0, 16)
    assert np.allclose(r, rates, atol=1e-2)


def test_op7_expected_tokens(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalog.op7_mixing(spark, sf).collect()
    docs = pq.read_table(f"{sf}/documents.parquet").num_rows
    assert len(rows) == docs and all(r.rate >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    for domain, share in catalog.QUALITY_TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens * r.posterior[domain] for r in rows) / total - share) < 0.01
    truth = {r["doc_id"]: ("toxic" if r["toxic"] else "poor" if not r["quality"] else "clean") for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert sum(r.domain == truth[r.doc_id] for r in rows if r.doc_id in truth) >= 0.9 * len(truth)


def test_mixing_runs_without_python(spark):
    plan = catalog.op7_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, "a"), (5, "b"), (5, "a"), (6, "b"), (None, "a"), (7, None), (99, "c")], "doc_id bigint, domain string")
    domains, mixed = mixing.mix(odd, labels, {"a": 0.5, "b": 0.5})
    rows = mixing.report(domains, mixed).collect()
    assert domains == ["a", "b"] and len(rows) == odd.count() and all(r.rate >= 0 and abs(sum(r.posterior.values()) - 1) < 1e-9 for r in rows)
    domains, mixed = mixing.mix(odd, labels.limit(0))
    assert domains == ["all"] and mixed.count() == odd.count()
    _, mixed = mixing.mix(nothing, labels)
    assert mixed.count() == 0
    copies = mixing.repeat(odd, labels)
    assert copies.columns == odd.columns and copies.count() >= odd.count()
    assert {r.doc_id for r in copies.collect()} == {r.doc_id for r in odd.collect()}


# ---------------------------------------------------------------- rollup

CHANGES = "doc_id bigint, version string, op string, source string, lang string, tokens bigint, seq bigint"


def test_rollup_deltas(spark, tmp_path):
    kept = rollup.TokenRollup(spark, str(tmp_path / "r"))
    send = lambda batch, rows: kept.apply(batch, spark.createDataFrame(rows, CHANGES))
    total = lambda: {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in kept.totals().collect()}
    assert total() == {}
    first = [(1, "v1", "insert", "a", "en", 10, 1), (2, "v1", "insert", "a", "en", 5, 1), (2, "v2", "insert", "a", "en", 7, 1),
             (3, "v1", "insert", None, None, None, 1), (3, "v1", "insert", None, None, 4, 2), (4, "v1", "delete", "a", "en", 3, 1), (None, "v1", "insert", "a", "en", 1, 1)]
    assert send("b1", first)
    assert total() == {("a", "en", "v1"): (3, 16), ("a", "en", "v2"): (1, 7), (None, None, "v1"): (1, 4)}
    assert not send("b1", first) and total()[("a", "en", "v1")] == (3, 16)
    assert send("b2", [(1, "v1", "revise", "b", "fr", 12, 1), (2, "v2", "delete", "x", "x", 0, 1), (9, "v1", "revise", "a", "en", 9, 1), (2, "v1", "insert", "a", "en", 99, 1)])
    assert total() == {("a", "en", "v1"): (2, 6), ("b", "fr", "v1"): (1, 12), (None, None, "v1"): (1, 4)}
    assert send("b3", []) and total()[("b", "fr", "v1")] == (1, 12)
    assert send("b4", [(2, "v2", "insert", "a", "en", 8, 1)]) and total()[("a", "en", "v2")] == (1, 8)


def test_rollup_overwrites_what_a_dead_attempt_left(spark, tmp_path):
    kept = rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(1, "v", "insert", "a", "en", 10, 1)], CHANGES)
    spark.createDataFrame([(8, "v", "a", "en", 1, 100)], rollup.LEDGER).write.parquet(f"{kept.path}/ledger/b1")
    spark.createDataFrame([("a", "en", "v", 1, 100)], rollup.TOTALS).write.parquet(f"{kept.path}/totals/b1")
    (tmp_path / "r" / "totals" / "b1" / "_SUCCESS").unlink()
    assert kept.committed() == [] and kept.totals().count() == 0
    assert kept.apply("b1", rows) and [tuple(r) for r in kept.totals().collect()] == [("a", "en", "v", 1, 10)]


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sets = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        sets.append((docs, out))
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    scores = {r.doc_id: r.predicted for r in catalog.op8_toxicity(spark, sf).collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(sets[0][1]) == sorted(i for i, p in scores.items() if not p)
    found = simhash.near_duplicates(sets[1][0]).collect()
    assert ids(sets[1][1]) == sorted(r.doc_id for r in found if r.doc_id == r.component_id) and len(found) > len(ids(sets[1][1]))
    assert ids(sets[2][1]) == ids(sets[2][0])
    assert all(r.base == [] for r in secrets.scan(sets[2][1]).collect() if "[SECRET]" in r.text)
    assert set(ids(sets[3][1])) == set(ids(sets[3][0])) and sets[3][1].count() > sets[3][0].count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    encoder = bpe.Encoder(bpe.load(catalog.WORD_BPE))
    want = sorted((r.doc_id, hashlib.sha256(encoder(r.text)).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in last) == want


def test_pipeline_stages_take_odd_rows(spark, odd, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns and docs.count()
        docs = docs.checkpoint()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    assert toxicity.not_toxic(odd, labels, crc_mod("doc_id", 5) == 0).count() == odd.count()

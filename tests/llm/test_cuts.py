"""Fill-in-middle, filter audit, FM-index and decontamination: against brute force, SQL and odd rows."""

import hashlib
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL as SF
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import documents, nothing, odd  # noqa: F401
from pyspark.sql import functions as F

from reviewlens.llm import audit, catalog, decontamination, fim
from reviewlens.llm.fmindex import FMIndex, WaveletMatrix, suffix_order

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def with_sql(name, df, **tables):
    """Rows of the query's SQL over small tables, as sorted tuples in the columns of ``df``."""
    con = duckdb.connect()
    for t, frame in tables.items():
        con.register(t, frame.toArrow())
    return sorted(map(repr, con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE[name]})").fetchall()))


# ---------------------------------------------------------------- fill in the middle

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é中🎉\t\n\x0b\x1c\x85 ", max_size=300))
def test_skip_list_finds_every_rank(text):
    units = UNIT.findall(text)
    lanes = fim.SkipList(text.encode())
    assert lanes.units == len(units)
    for rank in range(len(units) + 1):
        before = "".join(units[:rank])
        assert lanes.find(rank) == (len(before), len(before.encode()))


def test_skip_list_lanes_carry_widths():
    lanes = fim.SkipList(b" ".join([b"word"] * 5000)).lanes
    assert [lane.shape[1] for lane in lanes] == [5000, 313, 20, 2]
    assert all((lane.sum(axis=1) == lanes[0].sum(axis=1)).all() for lane in lanes)


def brute_fim(doc_id, text):
    text, units = text or "", UNIT.findall(text or "")
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), form, len(p), len(m), sha(out), sha(text))


def test_op11_whole_table(spark, documents):
    rows = [tuple(r) for r in catalog.op11_fim(spark, SF).collect()]
    assert sorted(rows) == sorted(brute_fim(d["doc_id"], d["text"]) for d in documents)
    assert {r[2] for r in rows} == {"plain", "spm", "psm"}


def test_fim_odd_rows(spark, odd, nothing):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["a <P> b", "<S", "x <", "<M>", " ", "tail  \n"] * 10)], "doc_id bigint, text string")
    for df in (odd, more):
        want = [brute_fim(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(repr, (tuple(r) for r in fim.digests(fim.transform(df)).collect()))) == sorted(map(repr, want))
    assert fim.digests(fim.transform(nothing)).count() == 0
    assert fim.transform(odd).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_fim_rates(spark, documents):
    df = spark.createDataFrame([(i, "one two three") for i in range(400)], "doc_id bigint, text string")
    forms = lambda **k: {r.form for r in fim.transform(df, **k).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, spm_rate=100) == {"spm"} and forms(rate=100, spm_rate=0) == {"psm"}
    first, second = ([r.output for r in fim.transform(df, seed=s, rate=100).orderBy("doc_id").collect()] for s in (1, 2))
    assert first != second


# ---------------------------------------------------------------- filter audit

def brute_audit(docs, labels):
    """Documents filtered one by one in every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if i is not None and i > least[text]:
            fails.add("E")
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                everyone = [r for r in rows if r[0] == part]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f in r[1] for r in everyone) - len(gone), sum(r[1] == {f} for r in everyone), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = kept
    for (part, order, step), counts in out.items():
        counts.append(sum(c[1] for (p, o, s), c in out.items() if p == part and o[s - 1] == order[step - 1]))
    return sorted((*k, *v) for k, v in out.items())


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", *audit.COUNTS, "shapley").collect())


def test_audit_against_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = ["", None, "A B", "word " * 300, "$", " ".join(f"w{i}" for i in range(250)), "UPPER " * 5, "a #b", " ".join(f"W{i}%" for i in range(300))]
    docs = [(int(i) if i < 70 else None, texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)]) for i in rng.integers(0, 80, 120)]
    labels = [(int(i), int(q), int(t)) for i, q, t in zip(rng.integers(0, 80, 60), rng.integers(0, 2, 60), rng.integers(0, 2, 60))] + [(None, 1, 1), (3, None, None)]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id bigint, text string, lang string, part string, mask int, n int")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(df, known)
    assert audit_rows(got) == brute_audit(docs, labels)
    assert with_sql("op12_filter_audit", got, documents=df.select("doc_id", "text", "lang"), labels=known) == sorted(map(repr, (tuple(r) for r in got.collect())))


def test_op12_whole_table(spark, documents):
    import pyarrow.parquet as pq

    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()]
    assert audit_rows(catalog.op12_filter_audit(spark, SF)) == brute_audit([(d["doc_id"], d["text"], d["lang"]) for d in documents], labels)


def test_audit_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = audit.audit(odd, labels)
    assert audit_rows(got) == brute_audit([(r.doc_id, r.text, r.lang) for r in odd.collect()], [(4, 1, 0)])
    assert audit.audit(nothing, labels).count() == 0
    assert audit_rows(audit.audit(odd, labels.limit(0))) == brute_audit([(r.doc_id, r.text, r.lang) for r in odd.collect()], [])


def test_audit_counts_before_it_shuffles(spark):
    """A hot text leaves each task as one row of a digest, and no Python runs."""
    plan = audit.fold(audit.cells(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")), "ABCDE")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown and "Cartesian" not in shown and "NestedLoop" not in shown


# ---------------------------------------------------------------- FM-index

def runs_of(rng, largest, most):
    runs = [rng.integers(1, largest + 1, rng.integers(1, most)) for _ in range(rng.integers(1, 30))]
    return np.concatenate([np.r_[r, 0] for r in runs * int(rng.integers(1, 3))]).astype(np.int64)


def test_suffix_order_is_the_sorted_order():
    rng = np.random.default_rng(1)
    for _ in range(100):
        text = runs_of(rng, 3, 20)
        keys = [tuple([(1, s) for s in text[i:i + int(np.argmax(text[i:] == 0))]] + [(0, i + int(np.argmax(text[i:] == 0)))]) for i in range(len(text))]
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=keys.__getitem__)
    assert suffix_order(np.zeros(0, np.int64)).tolist() == []


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    for largest in (1, 2, 5, 64, 1000):
        seq = np.r_[rng.integers(0, largest + 1, 700), np.arange(largest + 1)]
        tree = WaveletMatrix(seq, largest)
        at, symbol = rng.integers(0, len(seq) + 1, 300), rng.integers(0, largest + 1, 300)
        assert tree.rank(symbol, at).tolist() == [int((seq[:a] == s).sum()) for a, s in zip(at, symbol)]
        got, rank = tree.access(np.arange(len(seq)))
        assert got.tolist() == seq.tolist() and rank.tolist() == [int((seq[:i] == s).sum()) for i, s in enumerate(seq)]


@pytest.mark.parametrize("sample", [1, 3, 16])
def test_fm_index_finds_every_place(sample):
    rng = np.random.default_rng(sample)
    for _ in range(60):
        text = runs_of(rng, 3, 14)
        index, n = FMIndex(text, 5, sample), int(rng.integers(1, 6))
        phrases = np.unique(rng.integers(1, 6, (20, n)), axis=0)
        for phrase, low, high in zip(phrases, *index.ranges(phrases)):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == phrase).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


# ---------------------------------------------------------------- decontamination

def lowered_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_find(docs, items, width):
    phrases = {}
    for i, text in items:
        w = lowered_words(text)
        n = min(width, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[at:at + n]), set()).add(i)
    lengths, out = {len(p) for p in phrases}, []
    for i, text in docs:
        w, hit, held = lowered_words(text), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if tuple(w[at:at + n]) in phrases:
                    hit.update(range(at, at + n))
                    held |= phrases[tuple(w[at:at + n])]
        ids = ",".join(sorted(str(x) for x in held if x is not None))
        out.append((i, len(w), len(hit), len(held - {None}), sha(ids), bool(hit)))
    return sorted(map(repr, out))


def reported(found):
    return sorted(map(repr, (tuple(r) for r in decontamination.report(found).collect())))


@pytest.fixture(scope="module")
def small(spark):
    """Documents that hold whole, cut, overlapping and repeated passages, short items and equal items."""
    rng = np.random.default_rng(5)
    words = np.array(["the", "of", "Ünique", "a1", "zeta", "x", "中文", "word"])
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(1, 14, 30))] + [(100, "Rare-pair, here!"), (9, "rare pair here"), (9, "another row of nine"), (None, "null item words"), (7, None), (8, "..")]
    docs = [(i, say(int(n))) for i, n in enumerate(rng.integers(0, 120, 60))]
    docs += [(200 + i, f"start {items[i % 30][1].upper()} mid {items[(i + 3) % 30][1]}. end") for i in range(40)]
    docs += [(300, "RARE pair\nhere and null ITEM words"), (None, "rare pair here"), (301, None), (301, ""), (302, "zz " * 50_000 + items[3][1] + " yy" * 50_000), docs[3]]
    return (spark.createDataFrame([(*d, 1, "s", "b") for d in docs], "doc_id bigint, text string, n_words int, spans string, body string"),
            spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string"), docs, items)


@pytest.mark.parametrize("width,block_words,shard", [(10, 500_000, 1 << 20), (4, 20, 300), (1, 500_000, 50)])
def test_decontamination_against_brute_force(small, monkeypatch, width, block_words, shard):
    df, benchmark, docs, items = small
    monkeypatch.setattr(decontamination, "SHARD_SYMBOLS", shard)
    found = decontamination.find(df, benchmark, width, block_words=block_words)
    assert reported(found) == brute_find(docs, items, width)
    for r in found.collect():
        ends = [x for s in r.spans for x in (s["first"], s["last"])]
        assert ends == sorted(ends) and all(0 <= x <= r.n_words for x in ends) and list(r["items"]) == sorted(r["items"])
    if width == 10:
        short = df.where("doc_id is null or doc_id <> 302")  # the SQL copies a text's words for each window
        got = decontamination.find(short, benchmark, width)
        assert with_sql("op13_decontamination", decontamination.report(got), documents=short.select("doc_id", "text"), benchmark=benchmark.select("item_id", "text")) == reported(got)


def test_decontamination_cuts_pieces_between_words(monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 7)
    texts = [b"Alpha beta,GAMMA", None, b"", b"x" * 50 + b" beta \x01 alpha", "é alpha".encode()]
    symbols, counts = decontamination.word_symbols(texts, {b"alpha": 1, b"beta": 2})
    assert symbols.tolist() == [1, 2, 0, 0, 2, 1, 0, 1] and counts.tolist() == [3, 0, 0, 3, 2]


def test_spans_are_merged():
    owner, first, last = (np.array(x) for x in ([1, 0, 0, 0, 1, 3], [5, 0, 2, 9, 0, 4], [9, 3, 4, 12, 20, 5]))
    assert [x.tolist() for x in decontamination.merged_spans(owner, first, last)] == [[0, 0, 1, 3], [0, 9, 0, 4], [4, 12, 20, 5]]


def test_passages_are_cut_out(spark, small):
    df, benchmark, docs, items = small
    rows = [(r.doc_id, r.text) for r in decontamination.removed(df, benchmark, 10, item="item_id").collect()]
    assert len(rows) == len(docs)
    clean = {d for d in docs if "'contaminated': False" in repr(d)}
    assert (300, " and ") in rows and clean <= set(rows)
    assert decontamination.without("A b, c! d", [{"first": 1, "last": 3}]) == "A ! d"


def test_op13_whole_table(spark, documents):
    import pyarrow.parquet as pq

    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = sorted(map(repr, (tuple(r) for r in catalog.op13_decontamination(spark, SF).collect())))
    assert got == brute_find([(d["doc_id"], d["text"]) for d in documents], items, 10)


def test_decontamination_odd_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one two three"), (None, None)], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert reported(decontamination.find(odd, items)) == brute_find(rows, [(1, "one two three")], 10)
    assert reported(decontamination.find(odd, items.limit(0))) == brute_find(rows, [], 10)
    assert decontamination.find(nothing, items).count() == 0
    kept = decontamination.find(odd, items, keep=("ids", "score"))
    assert kept.columns == ["doc_id", "ids", "score", "n_words", "spans", "items"] and kept.count() == len(rows)

"""Cleaning and tokenisation: golden values and agreement with a scan over
the characters."""

import re
import string
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.functions import text as T

GOLDEN = [
    # raw, clean_ml, clean_light
    ("RT @Bob hi #Tag http://x.y/z?q=1 end", "rt hi end", "rt bob hi tag end"),
    ("https://", "https", "https"),
    ("mail a@b.com", "mail a com", "mail a b com"),
    ("ＡＢ", "ab", "ab"),
    ("ﬁn", "fin", "fin"),
    ("café", "caf", "caf"),
    ("   ", "", ""),
    ("@", "", ""),
    ("see www.example.com/x　now", "see now", "see now"),
    ("a\x1cb", "a b", "a b"),
    ("http://x y", "y", "y"),
]


def scan(text, mentions=True):
    """The words a cleaned text should have, found by walking over its characters."""
    chars = unicodedata.normalize("NFKC", text).lower()
    name = set(string.ascii_letters + string.digits + "_")
    found, word, at = [], "", 0
    while at < len(chars):
        rest, to = chars[at:], at
        for start in ("http://", "https://", "www."):
            if rest.startswith(start):
                end = at + len(start)
                while end < len(chars) and not chars[end].isspace():
                    end += 1
                if end > at + len(start):
                    to = max(to, end)
        if to == at and mentions and chars[at] in "@#":
            end = at + 1
            while end < len(chars) and chars[end] in name and not _link_at(chars, end):
                end += 1
            to = end if end > at + 1 else at
        if to == at and chars[at] in string.ascii_lowercase:
            word, at = word + chars[at], at + 1
            continue
        if word:
            found.append(word)
        word, at = "", max(to, at + 1)
    return " ".join(found + [word] if word else found)


def _link_at(chars, at):
    """Links are cut before mentions, so a mention ends where one begins."""
    for start in ("http://", "https://", "www."):
        after = at + len(start)
        if chars.startswith(start, at) and after < len(chars) and not chars[after].isspace():
            return True
    return False


def _apply(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *[c("s") for c in cols]).orderBy("i").collect()]


def test_golden_cleaning(spark):
    got = _apply(spark, [g[0] for g in GOLDEN], T.clean_ml, T.clean_light)
    for (raw, ml, light), (g_ml, g_light) in zip(GOLDEN, got):
        assert (g_ml, g_light) == (ml, light), raw


def test_scan_agrees_on_golden():
    for raw, ml, light in GOLDEN:
        assert scan(raw) == ml and scan(raw, mentions=False) == light


ALPHABET = st.sampled_from(list("abcXYZ @#_:/.wht-1é 　 \x1c\x85\t\nＡﬁ😀İ") +
                           ["http://", "https://", "www.", "RT "])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=20))
def test_cleaning_matches_scan(spark, values):
    got = _apply(spark, values, T.clean_ml, T.clean_light)
    for v, (ml, light) in zip(values, got):
        assert ml == scan(v), v
        assert light == scan(v, mentions=False), v
        assert re.fullmatch(r"[a-z ]*", ml) and "  " not in ml


def test_raw_tokens_match_python_word_pattern(spark):
    values = ["Hello, WORLD! don't_stop 3.14 naïve café ½ x", "Ünïcödé straße 42nd", ""]
    got = _apply(spark, values, T.raw_tokens)
    for v, (toks,) in zip(values, got):
        assert toks == re.findall(r"(?u)\b\w+\b", v.lower())


def test_nfkc_only_ships_non_ascii(spark):
    got = _apply(spark, ["plain", "Ａ", None], T.nfkc)
    assert [g[0] for g in got] == ["plain", "A", None]


def test_display_helpers(spark):
    df = spark.createDataFrame([(1, 0.125, "7"), (0, 0.135, "x"), (1, 1.7, None),
                                (0, 0.5, "7.9"), (1, 0.25, "1e2"), (1, 0.75, "NaN")],
                               "y int, p double, c string")
    rows = df.select(T.label_text("y").alias("l"), T.clamp01("p").alias("cl"),
                     T.confidence_pct("p").alias("pct"), T.to_count("c").alias("n")).collect()
    assert [r.l for r in rows] == ["Positif", "Negatif", "Positif", "Negatif", "Positif", "Positif"]
    assert [r.cl for r in rows] == [0.125, 0.135, 1.0, 0.5, 0.25, 0.75]
    assert [r.pct for r in rows] == [int(round(0.125 * 100)), int(round(0.135 * 100)),
                                     int(round(1.7 * 100)), 50, 25, 75]
    assert [r.n for r in rows] == [7, 0, 0, 7, 100, 0]


@pytest.mark.parametrize("s", ["ab cd", "", "x"])
def test_words_and_terms(spark, s):
    (w, t), = _apply(spark, [s], T.words, T.tfidf_terms)
    assert w == [x for x in s.split(" ") if x]
    assert t == [x for x in s.split(" ") if len(x) >= 2]

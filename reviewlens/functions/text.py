"""Text cleaning and tokenisation as Spark column expressions.

Everything here stays inside whole-stage codegen except ``nfkc``, an Arrow
UDF that only receives the rows holding non-ASCII characters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: must equal the reference's cleaning rules -------------------
# Python's ``\s`` (str.isspace) as an explicit class, because Java's ``\s`` is
# ASCII only: TAB-CR, U+001C-U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
URL_PATTERN = rf"(https?://[^{PY_WHITESPACE}]+|www\.[^{PY_WHITESPACE}]+)"
# ``@name`` / ``#tag``; the reference's third alternative, ``\bRT\b``, runs on
# lower-cased text and can never match, so it is left out.
MENTION_PATTERN = r"@[A-Za-z0-9_]+|#[A-Za-z0-9_]+"
NON_LETTER_PATTERN = r"[^a-z]+"
# Word pattern for the word-count report: Python's ``(?u)\b\w+\b``.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
# -------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _changed_nfkc(v):
    if v is None:
        return None
    n = unicodedata.normalize("NFKC", v)
    return n if n != v else None


@F.pandas_udf(T.StringType())
def _nfkc_batch(s: pd.Series) -> pd.Series:
    return s.map(_changed_nfkc)


def is_ascii(c) -> Column:
    c = _col(c)
    return F.length(c) == F.octet_length(c)


def nfkc_delta(c) -> Column:
    """NFKC of ``c`` where it differs from ``c``, else null. ASCII text is
    already NFKC, so only the other rows are shipped to Python (a null
    argument costs nothing in the Arrow batch); storing the delta instead of a
    second copy of the text keeps materialised tables at one copy."""
    c = _col(c)
    return _nfkc_batch(F.when(~is_ascii(c), c))


def nfkc(c) -> Column:
    """Unicode NFKC."""
    c = _col(c)
    return F.coalesce(nfkc_delta(c), c)


def text_lower(c) -> Column:
    return F.lower(_col(c))


def strip_urls(c) -> Column:
    return F.regexp_replace(_col(c), URL_PATTERN, " ")


def strip_mentions(c) -> Column:
    return F.regexp_replace(_col(c), MENTION_PATTERN, " ")


def letters_only(c) -> Column:
    """Everything but a-z becomes one space; runs collapse; ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), NON_LETTER_PATTERN, " "))


def _has_url(c: Column) -> Column:
    """Whether a URL may be found; no letter's lower case is one of these signs."""
    return c.contains("://") | text_lower(c).contains("www.")


def clean_ml(c, normalize: bool = True) -> Column:
    """Cleaning for the bag-of-words models: NFKC, lower, URLs, mentions, letters. Texts with no sign of a URL or a
    mention skip those patterns, which would look at every character."""
    c = _col(c)
    base = nfkc(c) if normalize else c
    low = text_lower(base)
    signs = base.contains("@") | base.contains("#") | _has_url(base)
    return letters_only(F.when(signs, strip_mentions(strip_urls(low))).otherwise(low))


def clean_light(c, normalize: bool = True) -> Column:
    """Cleaning for the sequence model: as ``clean_ml`` but mentions keep their word."""
    c = _col(c)
    base = nfkc(c) if normalize else c
    low = text_lower(base)
    return letters_only(F.when(_has_url(base), strip_urls(low)).otherwise(low))


def words(c) -> Column:
    """Space-separated words of a cleaned text, empty strings dropped."""
    return F.filter(F.split(_col(c), " "), lambda w: F.length(w) > 0)


def tfidf_terms(c) -> Column:
    """Terms the TF-IDF vectoriser sees on cleaned text: words of two letters or more."""
    return F.filter(F.split(_col(c), " "), lambda w: F.length(w) >= 2)


def raw_tokens(c) -> Column:
    """Word-count tokens on the raw text: lower-case, maximal runs of word chars."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_PATTERN), 0)


def is_blank(c) -> Column:
    """Nothing but Unicode white space (null for a null)."""
    return ~F.rlike(_col(c), F.lit(f"[^{PY_WHITESPACE}]"))


def label_text(c) -> Column:
    return F.when(_col(c) == 1, F.lit("Positif")).otherwise(F.lit("Negatif"))


def clamp01(c) -> Column:
    return F.least(F.greatest(_col(c).cast("double"), F.lit(0.0)), F.lit(1.0))


def confidence_pct(c) -> Column:
    """Whole percent, rounded half to even like Python's ``round``."""
    return F.bround(_col(c).cast("double") * 100, 0).cast("int")


def to_count(c) -> Column:
    """Force numeric (decimals are cut, exponents read); anything unparsable becomes 0."""
    number = f"try_cast({_sql(c)} as double)"
    return F.coalesce(F.expr(f"try_cast(if(isnan({number}), null, {number}) as int)"), F.lit(0))


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("to_count takes a column name")

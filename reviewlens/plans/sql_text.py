"""SQL spellings of the text rules, for the DuckDB oracle queries.

They mirror ``reviewlens.functions.text`` (NFKC is left out: it is the
identity on the driver's documents, and DuckDB has no NFKC function).
"""

from __future__ import annotations

# The patterns are fixed values, stated once beside the Spark expressions; RE2 reads them as they are.
from ..functions.text import MENTION_PATTERN, NON_LETTER_PATTERN, PY_WHITESPACE, URL_PATTERN, WORD_PATTERN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_lower(c: str) -> str:
    return f"lower({c})"


def strip_urls(c: str) -> str:
    return f"regexp_replace({c}, {q(URL_PATTERN)}, ' ', 'g')"


def strip_mentions(c: str) -> str:
    return f"regexp_replace({c}, {q(MENTION_PATTERN)}, ' ', 'g')"


def letters_only(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(NON_LETTER_PATTERN)}, ' ', 'g'))"


def clean_ml(c: str) -> str:
    return letters_only(strip_mentions(strip_urls(text_lower(c))))


def clean_light(c: str) -> str:
    return letters_only(strip_urls(text_lower(c)))


def raw_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {q(WORD_PATTERN)})"


def is_blank(c: str) -> str:
    return f"(NOT regexp_matches({c}, {q(f'[^{PY_WHITESPACE}]')}))"


def std_text(c: str = "text") -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"


REVIEWS = (f"SELECT doc_id, lang, CAST(lang = 'en' AS INTEGER) AS label, {std_text()} AS text, "
           f"CAST(lang = 'en' AS INTEGER) AS score FROM documents")


def is_train(key: str = "doc_id", folds: int = 5) -> str:
    return f"((({key} % {folds}) + {folds}) % {folds}) <> 0"

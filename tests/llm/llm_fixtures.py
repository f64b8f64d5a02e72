"""Fixtures of these tests: the small documents table, and rows with odd values."""

import pytest
from conftest import SF_SMALL as SF


@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


#: Texts with nulls, blanks, non-ASCII characters, repeats and one very long text.
ODD_TEXTS = [
    None, "", " ", "\n\t", "a", "Straße ΑΣ ﬁ é é 中文 🎉", "one two", "one two three", "one two three", "ONE two three",
    "password=hunter22 and token: abc", "x" * 3000, "word " * 40_000, "no\x1cspace", "  leading  and   runs \n of space ",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows: a null id, a repeated row, and columns whose names the operators use."""
    rows = [(i, t, "en" if i % 2 else None, "s", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[7], (None, "one two three", None, None, None)]
    rows = [(*r, 7, 1.5, "x") for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int, score double, _gone string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)

"""Quoted CSV by byte ranges: the same rows as the one-task multi-line read, whatever the ranges."""

import numpy as np
import pytest

from reviewlens.sources.csv_ranges import HEADER, range_states, read_csv_ranges, records, _lines
from reviewlens.sources.reviews import CSV_OPTIONS


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\n') else value


def write(path, header, rows, end="\n", bom=False):
    text = end.join([",".join(map(quoted, r)) for r in [header, *rows]]) + end
    path.write_bytes(("﻿" if bom else "").encode() + text.encode())


@pytest.fixture()
def small_ranges(spark):
    """Ranges of some hundred bytes."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(str, ([r[c] for c in sorted(df.columns)] for r in df.collect())))


def odd_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    cells = ["plain", "a, b", 'says "hi"', "two\nlines", '"\n"', "x" * 90, "three\n\nlines, more", "é 中文", "0"]
    return [[str(i), *rng.choice(cells, 2)] for i in range(n)]


@pytest.mark.parametrize("size,end", [(64, "\n"), (150, "\n"), (1000, "\n"), (150, "\r\n"), (10 ** 9, "\n")])
def test_equals_the_multi_line_read(spark, small_ranges, tmp_path, size, end):
    path = tmp_path / "a.csv"
    write(path, ["id", "text", "score"], odd_rows(200), end, bom=size == 150)
    want = rows_of(spark.read.options(**CSV_OPTIONS).csv(str(path)))
    small_ranges(size)
    got = read_csv_ranges(spark, str(path), CSV_OPTIONS)
    assert got.columns == ["id", "text", "score"] and rows_of(got) == want and len(want) == 200


def test_the_file_is_split(spark, small_ranges, tmp_path):
    path = tmp_path / "a.csv"
    write(path, ["id", "text", "score"], odd_rows(300))
    small_ranges(500)
    lines = _lines(spark, str(path), None)
    states = range_states(lines).collect()
    assert len(states) > 10 and {s.open for s in states} == {True, False}
    assert lines.rdd.getNumPartitions() > 4
    assert records(spark, str(path)).where(f"kind = '{HEADER}'").count() == 1


def test_a_cell_over_many_ranges(spark, small_ranges, tmp_path):
    path = tmp_path / "a.csv"
    long = "\n".join(f"line {i}, with a comma" for i in range(200))
    write(path, ["id", "text"], [["1", long], ["2", "short"], ["3", long + '"'], ["4", "end"]])
    small_ranges(100)
    got = {r.id: r.text for r in read_csv_ranges(spark, str(path), CSV_OPTIONS).collect()}
    assert got == {"1": long, "2": "short", "3": long + '"', "4": "end"}


def test_headers_are_matched_by_name(spark, small_ranges, tmp_path):
    write(tmp_path / "a.csv", ["text", "score"], [["a\nb", "1"], ["c", "0"]])
    write(tmp_path / "b.csv", ["score", "shop, name", "text"], [["1", "s", "d,\n"]])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "note.txt").write_text('"')
    small_ranges(40)
    got = read_csv_ranges(spark, str(tmp_path), CSV_OPTIONS, "*.csv")
    assert got.columns == ["text", "score", "shop, name"]
    assert rows_of(got) == rows_of(spark.createDataFrame([("a\nb", "1", None), ("c", "0", None), ("d,\n", "1", "s")], "text string, score string, `shop, name` string"))


def test_no_rows_and_no_header(spark, tmp_path):
    write(tmp_path / "a.csv", ["text", "score"], [])
    assert read_csv_ranges(spark, str(tmp_path / "a.csv"), CSV_OPTIONS).count() == 0
    (tmp_path / "b.csv").write_text("\n\n")
    with pytest.raises(ValueError):
        read_csv_ranges(spark, str(tmp_path / "b.csv"), CSV_OPTIONS)

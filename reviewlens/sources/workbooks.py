"""Bulk ingest of Excel workbooks (.xlsx): the first sheet of each file.

Files are listed and read by Spark (``binaryFile``); each workbook is unzipped
and its sheet XML parsed inside one task (stdlib ``zipfile`` + ``xml``), which
yields ``(path, row, names, cells)``. Each workbook's first row names its own
columns; columns are matched by name across workbooks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reviews import WORKBOOK_FILES, mark_missing

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("rel:Relationship", _NS):
        if rel.get("Id") == rid:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
    return "xl/worksheets/sheet1.xml"


def _cell_text(c, shared: list[str]) -> str | None:
    t = c.get("t")
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
    v = c.find("m:v", _NS)
    if v is None or v.text is None:
        return None
    if t == "s":
        return shared[int(v.text)]
    if t == "b":
        return "True" if v.text == "1" else "False"
    return v.text


def parse_workbook(content: bytes) -> list[list[str | None]]:
    """Rows of the first sheet as lists of strings (missing cells are None)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(x.text or "" for x in si.iter(f"{{{_NS['m']}}}t")))
        sheet = ET.fromstring(z.read(_first_sheet_path(z)))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells = {}
        for c in row.findall("m:c", _NS):
            cells[_col_index(c.get("r"))] = _cell_text(c, shared)
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


def column_names(header: list[str | None]) -> list[str]:
    """A workbook's column names: unnamed and repeated ones are numbered, as pandas does."""
    names: list[str] = []
    for i, name in enumerate(header):
        name = name if name is not None else f"Unnamed: {i}"
        again, number = name, 0
        while again in names:
            number += 1
            again = f"{name}.{number}"
        names.append(again)
    return names


_SCHEMA = "path string, row int, names array<string>, cells array<string>"


def _exploder(chunk: int = 10_000):
    """One task per group of files; rows leave in chunks of ``chunk``."""
    def explode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = parse_workbook(bytes(content))
                names = column_names(rows[0]) if rows else []
                width = max(map(len, rows), default=0)
                names = column_names([*names, *[None] * (width - len(names))])
                for at in range(0, len(rows), chunk):
                    yield pd.DataFrame([(path, at + i, names, cells) for i, cells in enumerate(rows[at:at + chunk])],
                                       columns=["path", "row", "names", "cells"])

    return explode


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    files = (spark.read.format("binaryFile").option("pathGlobFilter", WORKBOOK_FILES).load(path)
             if not path.lower().endswith(".xlsx") else
             spark.read.format("binaryFile").load(path))
    return files.select("path", "content").mapInPandas(_exploder(), _SCHEMA)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Every row of every workbook; the columns are the union of the workbooks' own."""
    rows = workbook_rows(spark, path)
    named = rows.where(F.col("row") == 0).select(F.posexplode("names").alias("at", "name"))
    # one row per column name: its least position over all workbooks gives the order
    names = [r["name"] for r in named.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    if not names:
        return spark.createDataFrame([], "path string")
    body = rows.where(F.col("row") > 0)
    cell = [F.get(F.col("cells"), (F.array_position("names", n) - 1).cast("int")) for n in names]
    # a name that a workbook lacks is at position 0, and get() of -1 is null
    return mark_missing(body.select(*[c.alias(n) for c, n in zip(cell, names)]))

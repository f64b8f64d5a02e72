"""Review files: CSV (and Excel workbooks through ``workbooks``).

Columns are read as strings (no ``inferSchema`` pass over the data); the label
is typed where it is used. pandas' default missing-value markers are mapped to
null after reading, since Spark's CSV reader knows a single ``nullValue``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_ranges import read_csv_ranges

# --- Fixed values: pandas' default missing-value markers ----------------------
NA_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
              "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
              "nan", "null"]
# -------------------------------------------------------------------------------


CSV_FILES, WORKBOOK_FILES = "*.[cC][sS][vV]", "*.[xX][lL][sS][xX]"


class UnreadableInput(ValueError):
    pass


#: How CSV is read, by batch and by stream. Line breaks inside quoted cells are kept, as pandas does: in batch by byte
#: ranges (``csv_ranges``), with a given schema and in streams by ``multiLine``, which makes a file one split.
CSV_OPTIONS = {"header": True, "escape": '"', "quote": '"', "multiLine": True, "mode": "FAILFAST",
               "encoding": "UTF-8"}


def read_csv_reviews(spark: SparkSession, path: str, schema=None, glob: str | None = "*.csv",
                     multi_line: bool = True) -> DataFrame:
    """CSV files with their columns matched by name; a column that a file lacks is null in its rows. Large files are
    read in ranges, also with line breaks inside quoted cells; ``multi_line=False`` is for files without any, which need
    no pass over the quotes. A given ``schema`` is applied by position."""
    options = CSV_OPTIONS | {"multiLine": multi_line} | ({"pathGlobFilter": glob} if glob else {})
    reader = spark.read.options(**options)
    if schema is not None:
        return mark_missing(reader.schema(schema).csv(path))
    if multi_line:
        return mark_missing(read_csv_ranges(spark, path, CSV_OPTIONS, glob))
    groups = _files_by_header(spark, path, glob)
    if len(groups) < 2:
        return mark_missing(reader.csv(path))
    parts = [mark_missing(reader.csv(files)) for files in groups]
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _files_by_header(spark: SparkSession, path: str, glob: str | None) -> list[list[str]]:
    """File paths grouped by header line (the driver gets names, as Spark's own listing does)."""
    lines = spark.read.options(**({"pathGlobFilter": glob} if glob else {})).text(path)
    starts = lines.select("value", F.col("_metadata.file_path").alias("file"),
                          F.col("_metadata.file_block_start").alias("start")).where("start = 0")

    def first_lines(batches):
        seen = set()
        for batch in batches:
            for i, file in enumerate(batch.column("file").to_pylist()):
                if file not in seen:  # a split keeps its lines in order
                    seen.add(file)
                    yield batch.slice(i, 1).select(["file", "value"])

    heads = starts.select("file", "value").mapInArrow(first_lines, "file string, value string")
    cleaned = F.regexp_replace("value", r"^\x{feff}|\s+$", "")
    grouped = heads.groupBy(cleaned.alias("header")).agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sorted(r["files"] for r in grouped.collect())


def mark_missing(df: DataFrame, markers: list[str] = NA_MARKERS) -> DataFrame:
    """pandas-style missing values: listed markers become null (string columns)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string":
            c = F.when(c.isin(markers), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_reviews(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Dispatch on the extension (case-insensitive): ``.csv`` or ``.xlsx``. Any
    other path is a folder (local, HDFS, object store: Spark lists it): all its
    ``.csv`` files and all its ``.xlsx`` workbooks, columns matched by name."""
    from .workbooks import read_workbooks
    low = path.lower()
    try:
        if low.endswith(".csv"):
            return read_csv_reviews(spark, path, glob=None, multi_line=multi_line)
        if low.endswith(".xlsx"):
            return read_workbooks(spark, path)
        found = []
        if _has_files(spark, path, CSV_FILES):
            found.append(read_csv_reviews(spark, path, glob=CSV_FILES, multi_line=multi_line))
        if _has_files(spark, path, WORKBOOK_FILES):
            found.append(read_workbooks(spark, path))
    except Exception as e:  # surface one typed error, as the reference stops with a message
        raise UnreadableInput(f"cannot read {path}: {e}") from e
    if not found:
        raise UnreadableInput(f"cannot read {path}: no .csv or .xlsx review files")
    return functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), found)


def _has_files(spark: SparkSession, path: str, glob: str) -> bool:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return bool(files.select("path").head(1))

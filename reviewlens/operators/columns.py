"""Column resolution, standard columns, previews and input-quality checks.

Name resolution is metadata work on the driver (``df.schema.names``); every
row-level step is a lazy column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

# --- Fixed values: accepted column names, in priority order ---------------------
TEXT_CANDIDATES = ["text", "content", "review", "comment", "ulasan", "isi"]
SCORE_CANDIDATES = ["score", "label", "rating", "nilai"]
# -------------------------------------------------------------------------------

PREDICTION_COLUMNS = ["pred_nb", "pred_gbt", "pred_gru"]


class MissingTextColumn(ValueError):
    pass


@dataclass(frozen=True)
class ResolvedColumns:
    text: str
    score: str | None


def resolve_columns(names: list[str]) -> ResolvedColumns:
    """Pick the text and (optional) label column by candidate priority.

    Matching ignores case; when several columns share a lower-cased name, the
    last one wins (a dict built in column order keeps the last).
    """
    lower = {}
    for n in names:
        lower[n.lower()] = n
    text = next((lower[c] for c in TEXT_CANDIDATES if c in lower), None)
    if text is None:
        raise MissingTextColumn(
            "no text column; expected one of: " + ", ".join(TEXT_CANDIDATES))
    score = next((lower[c] for c in SCORE_CANDIDATES if c in lower), None)
    return ResolvedColumns(text, score)


def standardize(df: DataFrame, missing: str = "nan") -> DataFrame:
    """Keep every input column and add ``text`` (string) and ``score``.

    A missing text becomes the word ``nan`` by default, as the reference's
    ``astype(str)`` does; ``missing='empty'`` gives an empty string instead.
    An existing ``text``/``score`` column is replaced in place. A session that
    ignores case cannot hold ``Text`` beside ``text``: there such an input is an
    error rather than a lost column.
    """
    cols = resolve_columns(df.columns)
    if df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() != "true":
        added = {"text"} | ({"score"} if cols.score is not None else set())
        lost = [n for n in df.columns if n.lower() in added and n not in added]
        if lost:
            raise ValueError(f"columns {lost} differ from the standard ones by case only; "
                             "set spark.sql.caseSensitive to true")
    fill = F.lit("nan") if missing == "nan" else F.lit("")
    text = F.coalesce(F.col(f"`{cols.text}`").cast("string"), fill)
    out = {"text": text}
    if cols.score is not None:
        out["score"] = F.col(f"`{cols.score}`")
    return df.withColumns(out)


def with_doc_id(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row key for tables that have none (uploaded files). The generated ids
    are made stable by one reliable checkpoint, so every later use, retries
    included, sees the same key."""
    from .lineage import checkpoint_dir
    if key in df.columns:
        return df
    checkpoint_dir(df.sparkSession)
    return df.withColumn(key, F.monotonically_increasing_id()).checkpoint(eager=True)


def preview(df: DataFrame, key: str = "doc_id", n: int = 5) -> DataFrame:
    """First ``n`` rows by key (Spark has no row order of its own)."""
    return df.orderBy(key).limit(n)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def text_flags(df: DataFrame, text: str = "text", keep: list[str] | tuple = ()) -> DataFrame:
    """Narrow per-row text checks, so a later join never carries the text."""
    t = F.col(text)
    return df.select(*keep, t.isNull().alias("text_null"),
                     (t.isNotNull() & is_blank(t)).alias("text_blank"))


def quality_report(flags: DataFrame, label: str = "score") -> DataFrame:
    """One aggregate over ``text_flags`` rows with a label column."""
    y = F.col(label)
    return flags.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("text_null").alias("null_text"),
        F.count_if("text_blank").alias("blank_text"),
        F.count_if(y.isNull()).alias("null_label"),
        F.count_if(y.isNotNull() & ~y.isin(0, 1)).alias("bad_label"),
        F.count_if(y == 1).alias("n_positive"),
        F.count_if(y == 0).alias("n_negative"),
    )


def input_quality(df: DataFrame, text: str = "text", label: str = "score") -> DataFrame:
    """One-pass report against the stated input contract."""
    return quality_report(text_flags(df, text, keep=[label]), label)


def class_filter(df: DataFrame, pred: str, cls: int) -> DataFrame:
    return df.where(F.col(pred) == cls)


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def select_prediction(df: DataFrame, method: str = "all") -> Column:
    """The prediction driving the summaries.

    ``nb`` / ``gbt`` / ``gru`` pick a model; ``all`` is the 2-of-3 vote when all
    three exist, else the first present of nb, gbt, gru, else all zeros.
    """
    names = set(df.columns)
    if method in ("nb", "gbt", "gru"):
        return F.col(f"pred_{method}").cast("int")
    if set(PREDICTION_COLUMNS) <= names:
        from .ensemble import vote
        return vote(*[F.col(c) for c in PREDICTION_COLUMNS])
    for c in PREDICTION_COLUMNS:
        if c in names:
            return F.col(c).cast("int")
    return F.lit(0)

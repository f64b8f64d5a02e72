"""Export of the scored table as CSV, written by the executors in parallel.

Float columns are written with four decimals. ``format_string('%.4f')`` rounds
the shortest decimal form half up; Python's ``%.4f`` rounds the exact binary
value, so near-ties such as 0.03125 differ. ``exact_format=True`` formats with
Python in an Arrow UDF and matches it byte for byte.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# reference export names for our model columns
EXPORT_NAMES = {"pred_gbt": "pred_lgbm", "prob_gbt": "prob_lgbm"}


@F.pandas_udf(T.StringType())
def _py_format4(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if pd.isna(v) else "%.4f" % v)


def format_floats(df: DataFrame, exact_format: bool = False) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = _py_format4(c.cast("double")) if exact_format else F.format_string("%.4f", c.cast("double"))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_results(df: DataFrame, path: str, exact_format: bool = False,
                  reference_names: bool = True, mode: str = "overwrite") -> None:
    out = df
    if reference_names:
        out = out.withColumnsRenamed({k: v for k, v in EXPORT_NAMES.items() if k in df.columns})
    (format_floats(out, exact_format).write.mode(mode)
     .option("header", True).option("sep", ",").option("escape", '"').option("quote", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "").option("nullValue", "")
     .csv(path))

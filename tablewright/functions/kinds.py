"""Column kinds: numeric, date, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import parse_datetime
from tablewright.functions.missing import quoted

DATE_SHARE = 0.8

_DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def schema_kind(dtype: T.DataType) -> str:
    """``num``, ``date``, ``text`` or ``nested`` from the declared type alone."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "num"
    if isinstance(dtype, _DATES):
        return "date"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    return "text"


def fields_of(df: DataFrame, *kinds: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if schema_kind(f.dataType) in kinds]


def names_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in fields_of(df, *kinds)]


def require_flat(df: DataFrame) -> None:
    nested = names_of(df, "nested")
    if nested:
        raise TypeError(f"nested columns are not part of the table model: {nested}")


def date_like_text(df: DataFrame) -> list[str]:
    """Text columns of whose non-missing values over 80 % read as dates: one aggregate over all rows."""
    names = names_of(df, "text")
    if not names:
        return []
    shares = [F.avg(F.when(quoted(c).isNotNull(), parse_datetime(quoted(c)).isNotNull().cast("int"))) for c in names]
    row = df.agg(*[share.alias(f"s{i}") for i, share in enumerate(shares)]).first()
    return [c for i, c in enumerate(names) if (row[i] or 0.0) > DATE_SHARE]


def analyze_columns(df: DataFrame) -> dict[str, list[str]]:
    """Split the columns into ``num_cols``, ``cat_cols`` and ``date_cols``."""
    require_flat(df)
    as_dates = set(date_like_text(df))
    groups: dict[str, list[str]] = {"num_cols": [], "cat_cols": [], "date_cols": []}
    for f in df.schema.fields:
        kind = schema_kind(f.dataType)
        if kind == "num":
            groups["num_cols"].append(f.name)
        elif kind == "date" or f.name in as_dates:
            groups["date_cols"].append(f.name)
        else:
            groups["cat_cols"].append(f.name)
    return groups

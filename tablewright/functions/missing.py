"""One notion of "missing": SQL NULL and floating NaN are the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def value_of(field: T.StructField) -> Column:
    """The column with NaN turned into NULL."""
    c = quoted(field.name)
    return F.when(~F.isnan(c), c) if is_float(field.dataType) else c


def is_missing(field: T.StructField) -> Column:
    c = quoted(field.name)
    return (c.isNull() | F.isnan(c)) if is_float(field.dataType) else c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column; other columns pass through."""
    if not any(is_float(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[value_of(f).alias(f.name) for f in df.schema.fields])


# The same as SQL text. Wide tables need some expressions per column, and text
# reaches the JVM in one call where an expression object takes many.


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_value(field: T.StructField) -> str:
    c = sql_name(field.name)
    return f"nullif({c}, cast('NaN' as {field.dataType.simpleString()}))" if is_float(field.dataType) else c


def sql_missing(field: T.StructField) -> str:
    c = sql_name(field.name)
    return f"({c} IS NULL OR isnan({c}))" if is_float(field.dataType) else f"({c} IS NULL)"

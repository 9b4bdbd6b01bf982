"""Text to number, with unreadable text becoming missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.missing import quoted, value_of


def to_numeric(field: T.StructField) -> Column:
    """Numeric view of a column; numbers stay as they are, text is read leniently."""
    c = quoted(field.name)
    if isinstance(field.dataType, T.NumericType):
        return value_of(field)
    if isinstance(field.dataType, T.BooleanType):
        return c.cast("int")
    # The last character must be a digit, a dot or part of "inf": Java would
    # also read a trailing type letter as in "1d".
    readable = c.cast("string").rlike(r"(?i)([0-9.]|inf|infinity)\s*$")
    return F.when(readable, c.cast("string").try_cast("double"))

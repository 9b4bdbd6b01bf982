"""Lenient date reading and calendar parts, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The written date shapes that are read. A date part is always
# required, so a bare time of day or a word such as "now" is never a date.
ISO_SHAPE = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{1,2}.*)?)?)?$"
MONTH_FIRST_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{1,2}.*)?$"
YEAR_SLASH_SHAPE = r"^\d{4}/\d{1,2}/\d{1,2}( \d{1,2}:\d{1,2}.*)?$"
COMPACT_SHAPE = r"^\d{8}$"


def parse_datetime(c: Column) -> Column:
    """Text to ``timestamp_ntz``; NULL where it does not read as a date."""
    t = F.trim(c.cast("string"))
    iso = (
        F.when(t.rlike(ISO_SHAPE), t)
        .when(t.rlike(MONTH_FIRST_SHAPE), F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"))
        .when(t.rlike(YEAR_SLASH_SHAPE), F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"))
        .when(t.rlike(COMPACT_SHAPE), F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    )
    return iso.try_cast("timestamp_ntz")


def looks_like_datetime(c: Column) -> Column:
    return parse_datetime(c).isNotNull()


def calendar_parts(c: Column, name: str) -> list[Column]:
    """Year, month, day, weekday (Monday = 0) and the two month-edge flags.

    A missing date leaves the parts missing while both flags are 0.
    """
    day = c.cast("date")
    return [
        F.year(day).alias(f"{name}__year"),
        F.month(day).alias(f"{name}__month"),
        F.dayofmonth(day).alias(f"{name}__day"),
        F.weekday(day).alias(f"{name}__dow"),
        F.coalesce((F.dayofmonth(day) == 1).cast("double"), F.lit(0.0)).alias(f"{name}__is_month_start"),
        F.coalesce((day == F.last_day(day)).cast("double"), F.lit(0.0)).alias(f"{name}__is_month_end"),
    ]

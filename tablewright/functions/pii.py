"""Masking of e-mail addresses, phone numbers and ID numbers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import names_of
from tablewright.functions.missing import quoted

# The three patterns and the mask.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{3,4}"
ID_NUMBER = r"\b\d{15,18}[0-9Xx]?\b"
MASK = "***"

# Digits, blanks and word edges of every script count, not only the ASCII ones.
_UNICODE = "(?U)"


def mask_text(c: Column) -> Column:
    """The three patterns in turn; a cheap test first spares text without a candidate."""
    mailed = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, MASK)).otherwise(c)
    digits = F.regexp_replace(F.regexp_replace(mailed, _UNICODE + PHONE, MASK), _UNICODE + ID_NUMBER, MASK)
    return F.when(c.rlike(_UNICODE + r"\d{3}"), digits).otherwise(mailed)


def mask_pii(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mask whole text columns; missing values stay missing."""
    wanted = set(names_of(df, "text") if cols is None else cols)
    return df.select(*[mask_text(quoted(c)).alias(c) if c in wanted else quoted(c) for c in df.columns])

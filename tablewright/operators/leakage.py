"""Columns that give the target away, by name or by correlation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import names_of, schema_kind
from tablewright.functions.missing import is_missing, quoted, sql_value, value_of
from tablewright.operators.joins import lookup_join, materialize
from tablewright.operators.ordering import global_index
from tablewright.operators.profile import per_column
from tablewright.operators.sampling import ClassCounts, class_counts
from tablewright.session import local_frame

# Words that make a column name suspicious.
SUSPICIOUS_WORDS = ("label", "target", "outcome", "answer")
CORRELATION_LIMIT = 0.98

_Y = "__y"


def leakage_by_name(cols: Sequence[str], target: str, whole_word: bool = False) -> list[str]:
    """Columns whose name contains the target's name or a suspicious word.

    The default is a plain substring test; ``whole_word`` asks for the word to
    stand alone between underscores or other non-letters.
    """
    words = [re.escape(w) for w in (target, *SUSPICIOUS_WORDS)]
    body = "|".join(words)
    pattern = rf"(?:^|[^a-z0-9])(?:{body})(?:$|[^a-z0-9])" if whole_word else body
    return [c for c in cols if c != target and re.search(pattern, c, re.IGNORECASE)]


def target_codes(
    df: DataFrame, target: str, order_by: Sequence[str] = (), counts: ClassCounts | None = None
) -> DataFrame:
    """Number the target values from 0 by first appearance, or by value without an order."""
    known = df.where(~is_missing(df.schema[target]))
    if order_by:
        first = F.min(F.struct(*[quoted(c) for c in order_by]))
        values = materialize(known.groupBy(quoted(target)).agg(first.alias("__first")))
        return global_index(values.df, ["__first", target], "code", values.rows).select(quoted(target), "code")
    counts = counts or class_counts(known, target)
    return global_index(counts.df.select(quoted(target)), [target], "code", counts.classes)


def pearson(x: str, y: str) -> str:
    """Correlation over rows where both are present; NULL when either is constant."""
    spread = f"stddev_pop(if({y} IS NULL, NULL, {x})) * stddev_pop(if({x} IS NULL, NULL, {y}))"
    return f"round(covar_pop({x}, {y}) / nullif({spread}, 0), 6)"


def numeric_target(
    df: DataFrame, target: str, task: str, order_by: Sequence[str] = (), counts: ClassCounts | None = None
) -> DataFrame | None:
    """``df`` with the target as a number in ``__y``; None when that cannot be done."""
    if schema_kind(df.schema[target].dataType) == "num":
        return df.withColumn(_Y, value_of(df.schema[target]).cast("double"))
    if task != "classification":
        return None
    codes = materialize(target_codes(df, target, order_by, counts).withColumnRenamed("code", _Y))
    return lookup_join(df, codes, [target]).withColumn(_Y, F.col(_Y).cast("double"))


def corr_with_target(
    df: DataFrame, target: str, task: str, order_by: Sequence[str] = (), counts: ClassCounts | None = None
) -> DataFrame:
    """(name, correlation) of every numeric column with the target, in one scan."""
    names = [c for c in names_of(df, "num") if c != target]
    data = numeric_target(df, target, task, order_by, counts)
    if data is None or not names:
        return local_frame(df.sparkSession, [], "name string, correlation double")
    fields = [df.schema[c] for c in names]
    return per_column(data, fields, lambda f: {"correlation": pearson(f"cast({sql_value(f)} as double)", _Y)})


@dataclass(frozen=True)
class Leaks:
    by_name: list[str]
    by_correlation: list[str]

    @property
    def names(self) -> list[str]:
        return sorted({*self.by_name, *self.by_correlation})


def leakage_by_corr(
    df: DataFrame,
    target: str,
    task: str,
    limit: float = CORRELATION_LIMIT,
    order_by: Sequence[str] = (),
    counts: ClassCounts | None = None,
) -> list[str]:
    found = corr_with_target(df, target, task, order_by, counts).where(F.abs("correlation") >= limit)
    hits = {r["name"] for r in found.collect()}  # one row per column at most
    return [c for c in df.columns if c in hits]


def fit_leakage(
    df: DataFrame,
    target: str,
    task: str,
    limit: float = CORRELATION_LIMIT,
    whole_word: bool = False,
    order_by: Sequence[str] = (),
    counts: ClassCounts | None = None,
) -> Leaks:
    return Leaks(
        leakage_by_name(df.columns, target, whole_word),
        leakage_by_corr(df, target, task, limit, order_by, counts),
    )


def leakage_guard(df: DataFrame, target: str, task: str, **options) -> DataFrame:
    return df.drop(*fit_leakage(df, target, task, **options).names)

"""The aggregates behind charts: histograms, boxes, time buckets, top categories."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import parse_datetime
from tablewright.functions.kinds import schema_kind
from tablewright.functions.missing import is_missing, quoted, value_of
from tablewright.functions.numbers import to_numeric
from tablewright.operators.ordering import exact_quantiles
from tablewright.operators.sampling import class_counts, drop_null_target
from tablewright.session import local_frame

IMBALANCED = 0.8

# The calendar units of the time chart.
TIME_UNITS = {"D": "day", "W": "week", "M": "month"}


def _edges(lo: float, hi: float, bins: int) -> list[float]:
    """The ends of the bins, each rounded once, so that a decimal value on an end begins its bin."""
    if not (math.isfinite(lo) and math.isfinite(hi)):
        return [lo + i * ((hi - lo) / bins) for i in range(bins + 1)]
    low, high = Fraction(repr(lo)), Fraction(repr(hi))
    return [float(low + (high - low) * i / bins) for i in range(bins + 1)]


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; empty bins included."""
    c = to_numeric(df.schema[col]).cast("double")
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    spark = df.sparkSession
    if lo is None:
        return local_frame(spark, [], "bin int, center double, count bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins

    edges = F.array(*[F.lit(e) for e in _edges(lo, hi, bins)])
    raw = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
    # The quotient can fall on the wrong side of an edge by one rounding step.
    down = (F.col("x") < edges[F.col("b")]).cast("int")
    up = ((F.col("x") >= edges[F.col("b") + 1]) & (F.col("b") < bins - 1)).cast("int")
    placed = df.select(c.alias("x")).where(F.col("x").isNotNull()).withColumn("b", raw)
    counts = placed.groupBy((F.col("b") - down + up).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    center = F.round(F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width), 6)
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin", center.alias("center"), F.coalesce("n", F.lit(0)).cast("bigint").alias("count")
    )


def box_stats(df: DataFrame, col: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends inside the fences, and the number of outliers."""
    q1, q2, q3 = exact_quantiles(df, [col], [0.25, 0.5, 0.75])[col]
    c = value_of(df.schema[col]).cast("double")
    if q1 is None:
        low = high = F.lit(None).cast("double")
    else:
        low, high = F.lit(q1 - whisker * (q3 - q1)), F.lit(q3 + whisker * (q3 - q1))
    inside = (c >= low) & (c <= high)
    return df.agg(
        F.lit(q1).cast("double").alias("q1"),
        F.lit(q2).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(inside, c)).alias("whisker_low"),
        F.max(F.when(inside, c)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def time_bucket_counts(df: DataFrame, col: str, freq: str = "D") -> DataFrame:
    """Rows per day, week (from Monday) or month; unreadable times are left out."""
    field = df.schema[col]
    ts = quoted(col) if schema_kind(field.dataType) == "date" else parse_datetime(quoted(col))
    bucket = F.date_trunc(TIME_UNITS[freq], ts.cast("timestamp_ntz")).cast("date")
    counted = df.select(bucket.alias("bucket")).where(F.col("bucket").isNotNull())
    return counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))


def top_k(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """Most frequent values as text, ties by value."""
    counts = df.where(~is_missing(df.schema[col])).groupBy(quoted(col).cast("string").alias("value"))
    return counts.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def target_distribution(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """The value counts of a target of at most ``k`` values, with its totals."""
    counts = class_counts(drop_null_target(df, target), target)
    shown = counts.df.select(
        quoted(target).cast("string").alias("value"),
        F.col("n").alias("count"),
        F.lit(counts.classes).cast("bigint").alias("unique_values"),
        F.lit(counts.rows).cast("bigint").alias("samples"),
    )
    return shown.where(F.lit(counts.classes <= k))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """Rows per class, the majority share, and whether it reaches 80 %."""
    counts = class_counts(df, y)
    ratio = counts.largest / counts.rows if counts.rows else 0.0
    return counts.df.select(
        quoted(y).cast("string").alias("label"),
        F.col("n").alias("count"),
        F.lit(round(ratio, 6)).alias("majority_ratio"),
        F.lit(ratio >= IMBALANCED).alias("is_imbalanced"),
    )


def recommend_task(df: DataFrame, target: str) -> DataFrame:
    """Regression for numeric targets with many distinct values, else classification."""
    field = df.schema[target]
    numeric = schema_kind(field.dataType) == "num"
    per_value = df.where(~is_missing(field)).groupBy(quoted(target)).agg(F.count(F.lit(1)).alias("n"))
    totals = per_value.agg(
        F.count(F.lit(1)).alias("unique_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples")
    )
    many = (F.col("unique_values") > 20) & (F.col("unique_values") > F.col("samples") * 0.05)
    task = F.when(F.lit(numeric) & many, "regression").otherwise("classification")
    reason = F.when(F.lit(not numeric), "not_numeric").when(many, "numeric_many_values").otherwise("numeric_few_values")
    return totals.select("unique_values", "samples", task.alias("task"), reason.alias("reason"))

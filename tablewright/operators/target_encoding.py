"""Categories as smoothed target means, out of fold for the rows the means come from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.missing import quoted, value_of
from tablewright.operators.joins import lookup_join, materialize
from tablewright.session import durable, local_copy


def _category(df: DataFrame, col: str) -> Column:
    """The category as text; a missing value is a category of its own, told from any text."""
    field = next(f for f in df.schema.fields if f.name == col)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"{col} holds {field.dataType.simpleString()}; categories are plain values")
    return F.coalesce(F.concat(F.lit("="), value_of(field).cast("string")), F.lit("none"))


def _counts(df: DataFrame, cols: Sequence[str], target: str, fold: Column, every: bool = False) -> DataFrame:
    """col (number), category, fold, n and total of the target, for all columns in one shuffle.

    With ``every`` a category and fold that only rows without target have is there too, with n 0.
    """
    y = quoted(target).cast("double")
    listed = F.array(*[F.struct(F.lit(i).alias("col"), _category(df, c).alias("category")) for i, c in enumerate(cols)])
    rows = df if every else df.where(y.isNotNull() & ~F.isnan(y))
    rows = rows.select(fold.alias("fold"), F.when(~F.isnan(y), y).alias("y"), F.explode(listed).alias("e"))
    return rows.groupBy("e.col", "e.category", "fold").agg(F.count("y").alias("n"), F.sum("y").alias("total"))


@dataclass(frozen=True)
class TargetMeans:
    """col, category, value (the smoothed mean) of the fitted columns, and the mean for what was not met."""

    cols: tuple[str, ...]
    table: DataFrame
    prior: float | None

    def transform(self, df: DataFrame, suffix: str = "_te") -> DataFrame:
        """Add the encoding of each column; categories that were not met get the prior."""
        out = df
        for i, c in enumerate(self.cols):
            mine = self.table.where(F.col("col") == i).select(F.col("category").alias("__c"), F.col("value").alias("__v"))
            out = lookup_join(out.withColumn("__c", _category(df, c)), materialize(mine), ["__c"])
            out = out.withColumn(c + suffix, F.coalesce("__v", F.lit(self.prior).cast("double"))).drop("__c", "__v")
        return out


def fit_target_means(df: DataFrame, cols: Sequence[str], target: str, smoothing: float = 20.0) -> TargetMeans:
    """Means of the target by category, drawn to the mean of all rows as by ``smoothing`` rows of it.

    Rows without target do not count. For new data only: on the rows fitted to, they leak the
    target (see ``encode_out_of_fold``).
    """
    counts = durable(_counts(df, cols, target, F.lit(0)))
    whole = counts.where("col = 0").agg(F.sum("total") / F.sum("n")).first()[0]
    value = (F.col("total") + F.lit(smoothing) * F.lit(whole)) / (F.col("n") + F.lit(float(smoothing)))
    return TargetMeans(tuple(cols), durable(counts.select("col", "category", value.alias("value"))), whole)


def encode_out_of_fold(
    df: DataFrame, cols: Sequence[str], target: str, fold: str, smoothing: float = 20.0, suffix: str = "_te"
) -> DataFrame:
    """Add for each column the smoothed target mean of its category over the rows of all other folds.

    A row's fold enters neither its category's sum nor the mean that this is drawn to, so no
    row sees its own target: both are the sums over all folds less the fold's own part, from
    one shuffle of per-fold sums. A category met in no other fold gets the other folds'
    mean; with no other fold at all the encoding is null. Rows without target are
    encoded and count nowhere. Null and NaN are one category; a null fold is a fold.
    """
    counts = durable(_counts(df, cols, target, quoted(fold), every=True))
    # Folds are few: one row each.
    first = counts.where("col = 0").groupBy("fold").agg(F.sum("n").alias("fold_n"), F.sum("total").alias("fold_total"))
    sums = first.agg(F.sum("fold_n").alias("all_n"), F.sum("fold_total").alias("all_total"))
    priors = local_copy(_priors(first, sums))
    over = Window.partitionBy("col", "category")
    every = counts.withColumns({"cat_n": F.sum("n").over(over), "cat_total": F.sum("total").over(over)})
    n = F.col("cat_n") - F.col("n")
    total = F.coalesce(F.col("cat_total"), F.lit(0.0)) - F.coalesce("total", F.lit(0.0))
    value = (total + F.lit(float(smoothing)) * F.col("__prior")) / F.nullif(n + F.lit(float(smoothing)), F.lit(0.0))
    value = F.when(n > 0, value).otherwise(F.col("__prior"))
    every = every.join(F.broadcast(priors), every["fold"].eqNullSafe(priors["__fold"]), "left")  # one row per fold
    every = durable(every.select("col", "category", "fold", value.alias("value")))
    # Each category and fold of a row has one line here, so a column takes one join.
    out = df.withColumn("__fold", quoted(fold))
    for i, c in enumerate(cols):
        mine = every.where(F.col("col") == i)
        mine = mine.select(F.col("category").alias("__c"), F.col("fold").alias("__fold"), F.col("value").alias("__v"))
        out = lookup_join(out.withColumn("__c", _category(df, c)), materialize(mine), ["__c", "__fold"])
        out = out.withColumnRenamed("__v", c + suffix).drop("__c")
    return out.drop("__fold")


def _priors(first: DataFrame, sums: DataFrame) -> DataFrame:
    """__fold and __prior: the target mean over all other folds."""
    joined = first.crossJoin(local_copy(sums))  # one row
    n = F.col("all_n") - F.col("fold_n")
    total = F.coalesce(F.col("all_total"), F.lit(0.0)) - F.coalesce("fold_total", F.lit(0.0))
    return joined.select(F.col("fold").alias("__fold"), (total / F.nullif(n, F.lit(0))).alias("__prior"))

"""High-cardinality categories as signed sums in a fixed number of buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.missing import quoted, value_of

BUCKETS = 1 << 18


def _hashed(df: DataFrame, col: str, buckets: int) -> Column:
    """name=value of a column as (bucket, value): text gives a sign, a number its value times the sign; null if missing."""
    field = next(f for f in df.schema.fields if f.name == col)
    number = isinstance(field.dataType, T.NumericType)
    value = value_of(field)
    token = F.lit(col) if number else F.concat(F.lit(col + "="), value.cast("string"))
    digest = F.md5(token)
    bucket = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % buckets).cast("int")
    # The bit of the sign is none of the bits of the bucket.
    sign = F.when(F.conv(F.substring(digest, 13, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    amount = sign * value.cast("double") if number else sign
    return F.when(value.isNotNull(), F.struct(bucket.alias("bucket"), amount.alias("value")))


def hash_features(df: DataFrame, cols: Sequence[str], buckets: int = BUCKETS, into: str = "hashed") -> DataFrame:
    """Add ``into``: the row's buckets in ascending order with the sum of what falls in each, zeros left out.

    Texts count as name=value, numbers as their name with the number as amount; the digest
    of that decides bucket and sign, so collisions cancel in expectation. Nothing is
    fitted, and a value that was never met has a bucket too. Null and NaN add
    nothing. ``buckets`` should be a power of two for even use.
    """
    if buckets < 1:
        raise ValueError("at least one bucket")
    cells = F.filter(F.array(*[_hashed(df, c, buckets) for c in cols]), lambda x: x.isNotNull())
    numbers = F.array_sort(F.array_distinct(F.transform("__cells", lambda x: x["bucket"])))

    def total(bucket: Column) -> Column:
        mine = F.filter("__cells", lambda x: x["bucket"] == bucket)
        return F.aggregate(mine, F.lit(0.0), lambda s, x: s + x["value"])

    sums = F.transform(numbers, lambda b: F.struct(b.alias("bucket"), total(b).alias("value")))
    out = df.withColumn("__cells", cells)
    return out.withColumn(into, F.filter(sums, lambda x: x["value"] != 0)).drop("__cells")


def bucket_sums(df: DataFrame, cols: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows (with something in it) and total over the table; added up in the tasks first."""
    cells = hash_features(df.select(*[quoted(c) for c in cols]), cols, buckets, "__hashed").select(F.inline("__hashed"))
    return cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))


def collisions(df: DataFrame, cols: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """For each column: values (distinct, missing left out), buckets they use, and shared (values that are not alone in theirs).

    Values of all columns share the buckets, so a value can meet one of another column.
    """
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"), _hashed(df, c, buckets).alias("h")) for c in cols]
    rows = df.select(F.inline(F.array(*cells))).where("h is not null")
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    # A number is one feature, whatever its value.
    value = F.when(F.col("column").isin(*numeric), F.lit(None)).otherwise(F.col("value")) if numeric else F.col("value")
    kinds = rows.select("column", value.alias("value"), F.col("h.bucket").alias("bucket")).distinct()
    crowd = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    per_column = kinds.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.count_distinct("bucket").alias("buckets"))
    shared = kinds.join(crowd.where("n > 1").select("bucket"), "bucket").groupBy("column").agg(F.count(F.lit(1)).alias("shared"))
    return per_column.join(shared, "column", "left").select("column", "values", "buckets", F.coalesce("shared", F.lit(0)).alias("shared"))

"""Joins against tables of checked size, and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.missing import quoted
from tablewright.session import durable, local_frame

BROADCAST_ROWS = 50_000
HOT_SHARE = 1 / 256
#: Rows of a hot key that share a salt, and the least number of salts of such a key.
SALT_ROWS = 200_000
LEAST_SALTS = 8

_SALT = "__salt"
_HOT = "__hot"


@dataclass(frozen=True)
class Materialized:
    """A table computed once: local rows when small, a checkpoint otherwise."""

    df: DataFrame
    rows: int
    small: bool
    local: pa.Table | None = None


def materialize(table: DataFrame, limit_rows: int | None = None) -> Materialized:
    """Compute ``table`` once and keep it in the form its size allows.

    At most ``limit_rows + 1`` rows ever reach the driver. A larger table is
    written to the reliable checkpoint folder instead.
    """
    limit_rows = BROADCAST_ROWS if limit_rows is None else limit_rows
    held = table.persist()
    try:
        rows = held.count()
        if rows <= limit_rows:
            local = held.toArrow()
            return Materialized(table.sparkSession.createDataFrame(local, schema=table.schema), rows, True, local)
        return Materialized(durable(held), rows, False)
    finally:
        held.unpersist()


def _filler(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.lit("1970-01-01").cast(dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    return F.lit("").cast(dtype)


def hot_keys(df: DataFrame, keys: list[str], share: float | None = None) -> DataFrame:
    """Keys that hold more than ``share`` of all rows, 1/share at most, with the salts their rows call for."""
    counts = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    return hot_of(counts, df.count(), keys, share)


def hot_of(counts: DataFrame, total: int, keys: list[str], share: float | None = None) -> DataFrame:
    """``hot_keys`` of ``total`` rows from the number of rows of each key, ``__n``."""
    share = HOT_SHARE if share is None else share
    salts = F.greatest(F.ceil(F.col("__n") / SALT_ROWS), F.lit(LEAST_SALTS)).cast("int").alias(_HOT)
    hot = counts.where(F.col("__n") > F.lit(total * share)).select(*[quoted(k) for k in keys], salts)
    schema = T.StructType([*[counts.schema[k] for k in keys], T.StructField(_HOT, T.IntegerType())])
    for f in schema.fields:
        f.nullable = True
    return local_frame(counts.sparkSession, hot.collect(), schema)


def _flag_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Give rows with a hot key its number of salts; ``hot`` has 1/share rows at most, so it is broadcast."""
    renamed = hot.select(*[quoted(k).alias(f"__h{i}") for i, k in enumerate(keys)], _HOT)
    cond = None
    for i, k in enumerate(keys):
        one = quoted(k).eqNullSafe(F.col(f"__h{i}"))
        cond = one if cond is None else cond & one
    joined = df.join(F.broadcast(renamed), cond, "left")
    return joined.drop(*[f"__h{i}" for i in range(len(keys))])


def by_heat(df: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """The rows of hot keys (None if no key is hot) and all other rows."""
    hot = hot_keys(df, keys)
    if hot.isEmpty():
        return None, df
    flagged = _flag_hot(df, hot, keys)
    return flagged.where(F.col(_HOT).isNotNull()).drop(_HOT), flagged.where(F.col(_HOT).isNull()).drop(_HOT)


def _scatter(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Spread the rows of hot keys over the salts by a hash of the row."""
    # The salt depends on the row alone, so a task that is run again after an
    # executor loss gives every row the same salt. Identical copies share one
    # salt; adaptive skew handling splits what is left of those.
    spread = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.col(_HOT)).cast("int")
    flagged = _flag_hot(df, hot, keys)
    return flagged.withColumn(_SALT, F.coalesce(spread, F.lit(0))).drop(_HOT)


def _replicate(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Give every salt a copy of the rows of hot keys."""
    salts = F.coalesce(F.sequence(F.lit(0), F.col(_HOT) - 1), F.array(F.lit(0)))
    return _flag_hot(df, hot, keys).withColumn(_SALT, F.explode(salts)).drop(_HOT)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which missing keys match each other; keys come out once."""
    parts = []
    for side, tag in ((left, "l"), (right, "r")):
        extra = []
        for i, k in enumerate(keys):
            dtype = side.schema[k].dataType
            extra += [
                F.coalesce(quoted(k), _filler(dtype)).alias(f"__k{i}"),
                quoted(k).isNull().alias(f"__n{i}"),
            ]
        rest = [c for c in side.columns if c not in keys]
        kept = [quoted(k).alias(f"__{tag}{i}") for i, k in enumerate(keys)]
        parts.append((side.select(*extra, *kept, *[quoted(c) for c in rest]), rest))
    on = [f"__{p}{i}" for i in range(len(keys)) for p in ("k", "n")]
    (l, l_rest), (r, r_rest) = parts
    joined = l.join(r, on, how)
    if how in ("left_semi", "left_anti"):
        out = [F.col(f"__l{i}").alias(k) for i, k in enumerate(keys)]
        return joined.select(*out, *[quoted(c) for c in l_rest])
    if how == "left":
        out = [F.col(f"__l{i}").alias(k) for i, k in enumerate(keys)]
    else:
        out = [F.coalesce(F.col(f"__l{i}"), F.col(f"__r{i}")).alias(k) for i, k in enumerate(keys)]
    return joined.select(*out, *[quoted(c) for c in l_rest + r_rest])


def lookup_join(
    df: DataFrame, table: Materialized, keys: list[str], how: str = "left", hot: Callable[[], DataFrame] | None = None
) -> DataFrame:
    """Join rows to a table that holds each key once.

    ``hot`` gives the hot keys of ``df`` where its rows per key are known already.

    A small table is broadcast (its size has been counted). A larger one is
    joined by shuffle with the hot keys of ``df`` salted, so that a key with a
    third of all rows is worked on by many tasks.
    """
    order = df.columns + [c for c in table.df.columns if c not in df.columns and how == "left"]
    if table.small:
        side, left = F.broadcast(table.df), df
        return null_safe_join(left, side, keys, how).select(*[quoted(c) for c in order])
    hot = hot() if hot else hot_keys(df, keys)
    left = _scatter(df, hot, keys)
    right = _replicate(table.df, hot, keys)
    return null_safe_join(left, right, [*keys, _SALT], how).select(*[quoted(c) for c in order])


def skewed_inner_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which either side may have hot keys.

    A key that is hot on both sides becomes a grid: left rows are dealt over its rows
    and copied along its columns, right rows the other way round.
    """
    hot_left, hot_right = hot_keys(left, keys), hot_keys(right, keys)
    l = _replicate(_scatter(left, hot_left, keys).withColumnRenamed(_SALT, "__s1"), hot_right, keys)
    r = _scatter(right, hot_right, keys).withColumnRenamed(_SALT, "__s2")
    r = _replicate(r, hot_left, keys).withColumnRenamed(_SALT, "__s1").withColumnRenamed("__s2", _SALT)
    joined = null_safe_join(l, r, [*keys, "__s1", _SALT], "inner")
    return joined.drop("__s1", _SALT)


def skewed_anti_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur on the right."""
    present = right.select(*[quoted(k) for k in keys]).distinct()
    hot = hot_keys(left, keys)
    l, r = _scatter(left, hot, keys), _replicate(present, hot, keys)
    return null_safe_join(l, r, [*keys, _SALT], "left_anti").select(*[quoted(c) for c in left.columns])

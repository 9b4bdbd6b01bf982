"""Stacking and joining any number of tables on their shared columns."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.missing import nan_to_null, quoted
from tablewright.operators.joins import null_safe_join, skewed_anti_join, skewed_inner_join

SOURCE = "_source_file"


def common_columns(tables: Mapping[str, DataFrame]) -> list[str]:
    """Columns of every table, in the order of the first; none for fewer than two tables."""
    if len(tables) < 2:
        return []
    first, *rest = tables.values()
    return [c for c in first.columns if all(c in t.columns for t in rest)]


def missing_columns(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Per table, the columns that some other table has and this one lacks."""
    union = {c for t in tables.values() for c in t.columns}
    return {name: sorted(union - set(t.columns)) for name, t in tables.items()}


def vertical_stack(tables: Mapping[str, DataFrame], add_source: bool = True) -> DataFrame:
    """Stack the shared columns of all tables, copies kept."""
    shared = common_columns(tables)
    if not shared:
        raise ValueError("the tables share no column")
    parts = []
    for name, t in tables.items():
        part = t.select(*[quoted(c) for c in shared])
        parts.append(part.withColumn(SOURCE, F.lit(name)) if add_source else part)
    return reduce(lambda a, b: a.unionByName(b), parts)


def prefix_columns(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}__{c}" for c in df.columns if c not in keys})


def dedupe_keys(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row of each key in the stated order; missing keys count as equal.

    A minimum over (order, row) instead of a ranking: each task keeps one row
    per key before the shuffle, so a hot key costs nothing extra.
    """
    df = nan_to_null(df)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ordered = [c for c in order_by if c not in keys]
    by = [quoted(c).alias(f"o{i}") for i, c in enumerate(ordered)]
    packed = F.struct(*by, *[quoted(c).alias(f"v{i}") for i, c in enumerate(rest)])
    first = df.groupBy(*[quoted(k) for k in keys]).agg(F.min(packed).alias("__row"))
    cols = {c: F.col(f"__row.v{i}").alias(c) for i, c in enumerate(rest)}
    return first.select(*[cols.get(c, quoted(c)) for c in df.columns])


def duplicate_key_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows after the first of each key."""
    per_key = nan_to_null(df).groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return per_key.agg(extra.cast("bigint").alias("duplicates"))


def horizontal_join(
    tables: Mapping[str, DataFrame],
    how: str = "outer",
    prefix: bool = True,
    dedupe: bool = True,
    order_by: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Join all tables on all their shared columns (``outer``, ``inner``, ``left``).

    Missing keys match each other. With ``dedupe`` every table has one row per
    key, so the whole n-way join is one grouping of the union of the tables:
    one shuffle, combined before it, and no join order to get wrong.
    """
    if how not in ("outer", "inner", "left"):
        raise ValueError(f"unknown join type: {how}")
    keys = sorted(common_columns(tables))
    if not keys:
        raise ValueError("the tables share no column to join on")
    named = _disambiguate(tables, keys, prefix)
    order_by = order_by or {}
    orders = {}
    for name, original in tables.items():
        rest = [c for c in original.columns if c not in keys]
        new = dict(zip(rest, [c for c in named[name].columns if c not in keys]))
        orders[name] = [new[c] for c in order_by.get(name, []) if c in new]
    if dedupe:
        return _one_shuffle_join(named, keys, how, orders)
    return reduce(lambda a, b: _join_two(a, b, keys, how), [nan_to_null(t) for t in named.values()])


def _disambiguate(tables, keys, prefix):
    stems = {name: os.path.splitext(os.path.basename(name))[0] for name in tables}
    if len(set(stems.values())) < len(stems):
        stems = {name: os.path.splitext(name)[0].replace("/", "_") for name in tables}
    if prefix and len(set(stems.values())) < len(stems):
        raise ValueError(f"tables {sorted(tables)} have no different prefixes")
    if prefix:
        return {
            n: prefix_columns(t, keys, stems[n]).select(
                *[quoted(k) for k in keys], *[quoted(f"{stems[n]}__{c}") for c in t.columns if c not in keys]
            )
            for n, t in tables.items()
        }
    seen: set[str] = set()
    out = {}
    for n, t in tables.items():
        rest = [c for c in t.columns if c not in keys]
        clash = sorted(seen & set(rest))
        if clash:
            raise ValueError(f"columns {clash} occur in several tables; use prefix=True")
        seen |= set(rest)
        out[n] = t.select(*[quoted(k) for k in keys], *[quoted(c) for c in rest])
    return out


def _one_shuffle_join(named, keys, how, orders):
    parts, first_of, present, out = [], [], [], []
    for i, (name, t) in enumerate(named.items()):
        t = nan_to_null(t)
        rest = [c for c in t.columns if c not in keys]
        by = [quoted(c).alias(f"o{j}") for j, c in enumerate(orders[name])]
        cols = [quoted(c).alias(f"v{j}") for j, c in enumerate(rest)]
        row = F.struct(F.lit(True).alias("here"), *by, *cols)
        parts.append(t.select(*[quoted(k) for k in keys], row.alias(f"__t{i}")))
        first_of.append(F.min(f"__t{i}").alias(f"__t{i}"))
        present.append(F.col(f"__t{i}").isNotNull())
        out += [F.col(f"__t{i}.v{j}").alias(c) for j, c in enumerate(rest)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    joined = union.groupBy(*[quoted(k) for k in keys]).agg(*first_of)
    if how == "inner":
        joined = joined.where(reduce(lambda a, b: a & b, present))
    elif how == "left":
        joined = joined.where(present[0])
    return joined.select(*[quoted(k) for k in keys], *out)


def _join_two(left, right, keys, how):
    """Two tables whose keys may repeat: the matches, plus what found no partner."""
    matched = skewed_inner_join(left, right, keys)
    if how == "inner":
        return matched
    result = matched.unionByName(skewed_anti_join(left, right, keys), allowMissingColumns=True)
    if how == "outer":
        result = result.unionByName(skewed_anti_join(right, left, keys), allowMissingColumns=True)
    return result

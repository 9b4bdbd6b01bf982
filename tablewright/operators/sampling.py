"""Row selection: heads, exact samples, frequent values, splits and folds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.missing import is_missing, quoted
from tablewright.operators.joins import lookup_join, materialize
from tablewright.operators.ordering import CUTS, global_index, hash_cutoffs, passed_cuts, row_hash
from tablewright.session import local_frame

SPLIT = "split"
FOLD = "fold"


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def apply_keep(df: DataFrame, keep: Sequence[str], target: str | None = None) -> DataFrame:
    """The advised columns, with the target behind them; unknown names are passed over."""
    names = [c for c in keep if c in df.columns and c != target]
    return df.select(*[quoted(c) for c in names + ([target] if target else [])])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(~is_missing(df.schema[target]))


def keep_frequent(df: DataFrame, col: str, min_count: int = 2) -> DataFrame:
    """Rows whose value of ``col`` occurs at least ``min_count`` times."""
    frequent = (
        df.where(~is_missing(df.schema[col])).groupBy(quoted(col)).agg(F.count(F.lit(1)).alias("__n"))
    ).where(F.col("__n") >= min_count)
    return lookup_join(df, materialize(frequent.select(quoted(col))), [col], "left_semi")


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n)


def eval_limit(test: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows of a test split, taken before anything is measured."""
    return head(test, n, order_by)


def sample_rows(df: DataFrame, n: int = 5000, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """All rows if there are at most ``n``, else exactly ``n`` without replacement.

    A sample is the rows with the smallest key hashes: a filter on the exact cut-off hash,
    so that rows stay where they are. Of copies of a key at the cut-off as many are taken
    as are missing, numbered where they lie. One rule for every size.
    """
    key = list(key or df.columns)
    total = df.count()
    if total <= n:
        return df
    if n <= 0:
        return df.limit(0)
    h = row_hash(key, seed)
    wanted = local_frame(df.sparkSession, [(0, n)], "slot int, k bigint")
    table, tied = _cut_table(hash_cutoffs(df, key, seed, wanted, largest=total), [])
    placed = passed_cuts(_one_row(df, table), [], h, "__passed", tied, 1)
    return placed.where(F.col("__passed") == 0).select(*[quoted(c) for c in df.columns])


# --------------------------------------------------------- split and folds


@dataclass(frozen=True)
class ClassCounts:
    df: DataFrame
    rows: int
    classes: int
    smallest: int
    largest: int


def class_counts(df: DataFrame, target: str) -> ClassCounts:
    counts = df.groupBy(quoted(target)).agg(F.count(F.lit(1)).alias("n"))
    held = materialize(counts)
    if held.local is not None:
        sizes = held.local.column("n").to_pylist()
        return ClassCounts(held.df, sum(sizes), len(sizes), min(sizes, default=0), max(sizes, default=0))
    row = held.df.agg(F.sum("n"), F.min("n"), F.max("n")).first()
    return ClassCounts(held.df, int(row[0] or 0), held.rows, int(row[1] or 0), int(row[2] or 0))


def can_stratify(counts: ClassCounts, test_size: float = 0.2) -> bool:
    """Every class has two rows, and the test part has room for every class."""
    return counts.smallest >= 2 and int(counts.rows * test_size) >= counts.classes


def stratified_allocation(counts: ClassCounts, target: str, test_size: float) -> DataFrame:
    """Test rows per class: proportional, with largest remainders rounded up.

    The train part is allocated first and the test part is the rest.
    """
    n_test = math.ceil(counts.rows * test_size)
    n_train = counts.rows - n_test
    exact = F.col("n") * F.lit(n_train) / F.lit(counts.rows)
    shares = counts.df.select(
        quoted(target), "n", F.floor(exact).alias("base"), (-(exact - F.floor(exact))).alias("rest")
    )
    missing = n_train - int(shares.agg(F.sum("base")).first()[0])
    placed = global_index(shares, ["rest", target], "place", counts.classes)
    train = F.col("base") + (F.col("place") < missing).cast("bigint")
    return placed.select(quoted(target), F.lit(0).alias("slot"), (F.col("n") - train).alias("k"))


def train_test_split(
    df: DataFrame,
    target: str,
    test_size: float = 0.2,
    seed: int = 42,
    key: Sequence[str] | None = None,
    stratify: bool = True,
    counts: ClassCounts | None = None,
) -> DataFrame:
    """Add ``split`` (``train`` / ``test``) with exact sizes.

    Finding the cut-off hashes takes counting jobs; the split itself compares
    each row's hash with the cut-off of its class and moves no rows.
    """
    key = list(key or df.columns)
    h = row_hash(key, seed)
    if not stratify:
        total = counts.rows if counts else df.count()
        return _plain_split(df, h, key, seed, total, math.ceil(total * test_size))
    counts = counts or class_counts(df, target)
    if not can_stratify(counts, test_size):
        return _plain_split(df, h, key, seed, counts.rows, math.ceil(counts.rows * test_size))
    wanted = stratified_allocation(counts, target, test_size)
    cuts = hash_cutoffs(df, key, seed, wanted, [target], counts.largest, counts.classes)
    table, tied = _cut_table(cuts, [target])
    placed = passed_cuts(lookup_join(df, table, [target]), [target], h, "__passed", tied, 1)
    side = F.when(F.col("__passed") == 0, "test").otherwise("train")
    return placed.withColumn(SPLIT, side).select(*df.columns, SPLIT)


def _cut_table(cuts: DataFrame, groups: Sequence[str]):
    """The cut-offs of each group as one array, and whether one of them falls among rows of one hash."""
    packed = F.sort_array(F.collect_list(F.struct("cut", "take", "at"))).alias(CUTS)
    table = materialize(cuts.groupBy(*[quoted(g) for g in groups]).agg(packed))
    tied = table.df.where(F.exists(F.col(CUTS), lambda c: c["take"] < c["at"])).isEmpty()
    return table, not tied


def _one_row(df: DataFrame, table) -> DataFrame:
    """Give every row the only row of a table of cut-offs, which has k - 1 entries at most."""
    row = table.df.first()
    listed = [] if row is None else row[CUTS]
    one = [F.struct(*[F.lit(c[n]).cast("bigint").alias(n) for n in ("cut", "take", "at")]) for c in listed]
    empty = F.array().cast("array<struct<cut:bigint,take:bigint,at:bigint>>")
    return df.withColumn(CUTS, F.array(*one) if one else empty)


def _plain_split(df, h, key, seed, total, n_test):
    wanted = local_frame(df.sparkSession, [(0, n_test)], "slot int, k bigint")
    table, tied = _cut_table(hash_cutoffs(df, key, seed, wanted, largest=total), [])
    placed = passed_cuts(_one_row(df, table), [], h, "__passed", tied, 1)
    side = F.when((F.col("__passed") == 0) & (F.size(CUTS) > 0), "test").otherwise("train")
    return placed.withColumn(SPLIT, side).select(*df.columns, SPLIT)


def assign_folds(
    df: DataFrame,
    k: int = 5,
    target: str | None = None,
    seed: int = 42,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``fold`` (0..k-1); per class, fold sizes differ by one at most.

    The first fold of a class depends on the class, so that the odd rows of many
    small classes do not pile up in one fold.
    """
    key = list(key or df.columns)
    groups = [target] if target else []
    h = row_hash(key, seed + 1)
    if target:
        counts = class_counts(df, target)
        table, largest, spots = counts.df, counts.largest, counts.classes * k
    else:
        largest, spots = df.count(), k
        table = local_frame(df.sparkSession, [(largest,)], "n bigint")
    slots = F.explode(F.sequence(F.lit(1), F.lit(k - 1)))
    wanted = table.select(*[quoted(g) for g in groups], "n", slots.alias("slot"))
    wanted = wanted.select(*[quoted(g) for g in groups], "slot", F.expr(f"(slot * n) div {k}").alias("k"))
    cuts = hash_cutoffs(df, key, seed + 1, wanted, groups, largest, spots)
    table, tied = _cut_table(cuts, groups)
    # k-1 cut-offs per class: a row's fold is the number of cut-offs before it,
    # plus the empty slots of classes with fewer than k rows.
    placed = lookup_join(df, table, [target]) if target else _one_row(df, table)
    placed = passed_cuts(placed, groups, h, "__passed", tied, k - 1)
    fold = F.coalesce(F.col("__passed") + (F.lit(k - 1) - F.size(CUTS)), F.lit(k - 1))
    if target:
        fold = F.pmod(fold + F.pmod(F.xxhash64(quoted(target)), F.lit(k)), F.lit(k))
    return placed.withColumn(FOLD, fold.cast("int")).select(*df.columns, FOLD)

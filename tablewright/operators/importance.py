"""How much a model's measure suffers when one column is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.missing import quoted
from tablewright.operators.ordering import global_index, row_hash
from tablewright.session import durable, local_frame


def permute_column(df: DataFrame, col: str, key: Sequence[str], seed: int = 0) -> DataFrame:
    """The table with the values of ``col`` dealt to other rows: a permutation of all rows, the same for one seed and key.

    Row i in the order of the key gets the value of the row that is i-th in the order of a
    seeded hash. Both orders are kept by ranges over the tasks, and joined by position, so the
    column is never in one place. ``key`` should tell rows apart; of rows with equal keys the
    order is any. Nulls move as values do.
    """
    rows = durable(df)
    n = rows.count()
    order = [quoted(k) for k in key]
    keyed = rows.withColumn("__hash", row_hash(key, seed))
    to = global_index(keyed.drop(col), key, "__at", n)
    # Equal hashes go by the key, so that every position is one row's.
    values = keyed.select("__hash", *[k.alias(f"__k{i}") for i, k in enumerate(order)], quoted(col).alias("__value"))
    values = global_index(values, ["__hash", *[f"__k{i}" for i in range(len(order))]], "__at", n)
    dealt = to.join(values.select("__at", "__value"), "__at")
    return dealt.select(*[F.col("__value").alias(c) if c == col else quoted(c) for c in df.columns])


def permutation_importance(
    df: DataFrame,
    cols: Sequence[str],
    measure: Callable[[DataFrame], float],
    key: Sequence[str],
    repeats: int = 3,
    seed: int = 0,
) -> DataFrame:
    """column, importance (how far the measure falls, on average over ``repeats``), spread and baseline; the largest first.

    ``measure`` predicts and scores a table, larger being better (a loss gets a minus). A
    column that does not vary scores 0, exactly; so does one that the model does not use.
    An empty table is an error of the measure's, not of this function.
    """
    held = durable(df)
    baseline = float(measure(held))
    rows = []
    for c in cols:
        if key == [c]:
            raise ValueError(f"{c} is the key that tells rows apart")
        falls = [baseline - float(measure(permute_column(held, c, [k for k in key if k != c], seed + r))) for r in range(repeats)]
        mean = sum(falls) / len(falls)
        spread = (sum((f - mean) ** 2 for f in falls) / len(falls)) ** 0.5
        rows.append((c, mean, spread, baseline))
    rows.sort(key=lambda r: (-r[1], r[0]))
    return local_frame(df.sparkSession, rows, "column string, importance double, spread double, baseline double")

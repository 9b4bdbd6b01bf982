"""Second moments of many columns in one pass: correlations, principal components, lasso.

Each task multiplies blocks of rows (values and presence masks) and returns one number per
pair of columns; columns x columns is all that is ever summed. Values are taken around the
columns' means, so that large values keep their digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.missing import quoted, value_of
from tablewright.operators.cluster import complete_rows
from tablewright.operators.joins import hot_of, lookup_join, materialize
from tablewright.operators.ordering import running_before
from tablewright.session import durable, local_frame, small_in_memory

#: The driver holds a few matrices of columns x columns.
MOST_COLUMNS = 2000
_BLOCK = 4096
_PAIR = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


@dataclass(frozen=True)
class Moments:
    """Means of the columns; and over the rows where both columns are there, counts and sums around those means.

    n[i, j] rows, s[i, j] sum of column i, q[i, j] sum of its squares, p[i, j] sum of products.
    """

    means: np.ndarray
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    p: np.ndarray


def _numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    fields = {f.name: f for f in df.schema.fields}
    return df.select(*[value_of(fields[c]).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])


def moments(df: DataFrame, cols: Sequence[str], known: Sequence[float] | None = None) -> Moments:
    """Sums over pairwise complete rows; null and NaN are missing. Two passes: means (if not ``known``), then products."""
    d = len(cols)
    if not 1 <= d <= MOST_COLUMNS:
        raise ValueError(f"between 1 and {MOST_COLUMNS} columns, not {d}")
    with small_in_memory(_numbers(df, cols)) as held:
        row = held.agg(*[F.avg(c) for c in held.columns]).first() if known is None else known
        means = np.array([0.0 if m is None else m for m in row])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s, q, p = (np.zeros((d, d)) for _ in range(4))
            for b in batches:
                for k in range(0, len(b), _BLOCK):
                    part = b.slice(k, _BLOCK)
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                    there = np.isfinite(x)
                    x = np.where(there, x - means, 0.0)
                    mask = there.astype(float)
                    n += mask.T @ mask
                    s += x.T @ mask
                    q += (x * x).T @ mask
                    p += x.T @ x
            i, j = np.triu_indices(d)
            values = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, values)],
                ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
            )

        parts = held.mapInArrow(run, _PAIR).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
        found = parts.toArrow()  # one row per pair of columns
    n, s, q, p = (np.zeros((d, d)) for _ in range(4))
    i, j = found["i"].to_numpy(), found["j"].to_numpy()
    for m, upper, lower in ((n, "n", "n"), (s, "sx", "sy"), (q, "sxx", "syy"), (p, "sxy", "sxy")):
        m[j, i] = found[lower].to_numpy()
        m[i, j] = found[upper].to_numpy()
    return Moments(means, n, s, q, p)


def ranked(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """The columns as average ranks among their own values that are there, and the means of these; missing stays missing.

    Ranks come from counts per value in a global order, so equal values, however many, are
    one row of the order. One pass counts the values of all columns. The mean of n ranks is
    (n + 1) / 2, so no pass is needed for it.
    """
    fields = {f.name: f for f in df.schema.fields}
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(cols):
        kinds.setdefault(df.select(value_of(fields[c]).alias("v")).schema["v"].dataType.simpleString(), []).append(i)
    out, means = df, [0.0] * len(cols)
    for some in kinds.values():
        cells = F.array(*[F.struct(F.lit(i).alias("__i"), value_of(fields[cols[i]]).alias("__v")) for i in some])
        counts = durable(df.select(F.inline(cells)).groupBy("__i", "__v").agg(F.count(F.lit(1)).alias("__n")))
        there = F.sum(F.when(F.col("__v").isNotNull(), F.col("__n")))
        sizes = counts.groupBy("__i").agg(F.sum("__n"), there, F.count("__v")).collect()  # one row per column
        for i, total, rows, values in sizes:
            c, own = cols[i], counts.where(F.col("__i") == i).drop("__i")
            order = running_before(own.where("__v is not null"), ["__v"], {"__below": F.col("__n")}, values)
            ranks = order.select("__v", (F.col("__below") + (F.col("__n") + 1) / 2).alias("__rank"))
            keyed = out.withColumn("__v", value_of(fields[c]))
            out = lookup_join(keyed, materialize(ranks), ["__v"], hot=lambda own=own, total=total: hot_of(own, total, ["__v"]))
            out = out.withColumn(c, F.col("__rank")).drop("__v", "__rank")
            means[i] = ((rows or 0) + 1) / 2
    return out, means


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, n, corr for every ordered pair of columns, each with itself too.

    Pearson's correlation over the rows where both are there (n of them); null with fewer
    than two such rows or where one does not vary among them. "spearman" correlates the
    average ranks, taken per column over its own values.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f'method is "pearson" or "spearman", not {method!r}')
    data, means = ranked(df.select(*[quoted(c) for c in cols]), cols) if method == "spearman" else (df, None)
    m = moments(data, cols, means)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            n = m.n[i, j]
            value = None
            if n >= 2:
                xx, yy = m.q[i, j] - m.s[i, j] ** 2 / n, m.q[j, i] - m.s[j, i] ** 2 / n
                # What is left of a constant column is rounding.
                if xx > 1e-12 * m.q[i, j] and yy > 1e-12 * m.q[j, i]:
                    value = float(max(-1.0, min(1.0, (m.p[i, j] - m.s[i, j] * m.s[j, i] / n) / math.sqrt(xx * yy))))
            rows.append((a, b, int(n), value))
    return local_frame(df.sparkSession, rows, "a string, b string, n long, corr double")


# ------------------------------------------------------ principal components


@dataclass(frozen=True)
class Components:
    """Centre and unit of each column, axes (one row each, largest variance first), variances and their shares."""

    cols: tuple[str, ...]
    centre: np.ndarray
    unit: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    shares: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Add a column per axis; null where a column is missing."""
        fields = {f.name: f for f in df.schema.fields}
        scaled = [(value_of(fields[c]).cast("double") - F.lit(float(m))) / F.lit(float(u)) for c, m, u in zip(self.cols, self.centre, self.unit, strict=True)]
        return df.withColumns({f"{prefix}{k + 1}": sum(x * F.lit(float(w)) for x, w in zip(scaled, axis, strict=True)) for k, axis in enumerate(self.axes)})

    def table(self, spark) -> DataFrame:
        """component (from 1), column, weight, variance, share."""
        rows = [
            (k + 1, c, float(w), float(self.variances[k]), float(self.shares[k]))
            for k, axis in enumerate(self.axes) for c, w in zip(self.cols, axis, strict=True)
        ]
        return local_frame(spark, rows, "component int, column string, weight double, variance double, share double")


def principal_components(df: DataFrame, cols: Sequence[str], k: int | None = None, scale: bool = False) -> Components:
    """The first ``k`` principal components of the complete rows.

    ``scale`` divides each column by its standard deviation first (a constant column stays).
    The sign of an axis is such that its weight of largest size, the first of equal ones,
    is positive. Fewer than two complete rows are an error.
    """
    m = moments(complete_rows(df, cols), cols)
    n = m.n[0, 0]
    if n < 2:
        raise ValueError("fewer than two complete rows")
    covariance = (m.p - np.outer(m.s.diagonal(), m.s.diagonal()) / n) / (n - 1)
    unit = np.ones(len(cols))
    if scale:
        deviation = np.sqrt(np.maximum(covariance.diagonal(), 0))
        unit = np.where(deviation > 0, deviation, 1.0)
        covariance = covariance / np.outer(unit, unit)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: k or len(cols)]
    axes = vectors[:, order].T
    # Sizes that agree up to rounding count as equal.
    largest = np.argmax(np.round(np.abs(axes), 9), axis=1)
    axes = axes * np.sign(axes[np.arange(len(axes)), largest])[:, None]
    found = np.maximum(values[order], 0)
    total = np.maximum(values, 0).sum()
    shares = found / total if total > 0 else np.zeros(len(found))
    return Components(tuple(cols), m.means, unit, axes, found, shares)


# --------------------------------------------------------------------- lasso


@dataclass(frozen=True)
class LassoStep:
    penalty: float
    intercept: float
    coefficients: list[float]
    r2: float
    rounds: int


def lasso_path(
    df: DataFrame, cols: Sequence[str], target: str, penalties: Sequence[float] | int = 20, tol: float = 1e-10, rounds: int = 10_000
) -> list[LassoStep]:
    """Coefficients for each penalty, largest first, by coordinate descent on the matrix of products.

    Minimises the sum of squared errors / (2 n) + penalty * sum of absolute coefficients of
    the columns in units of their standard deviation; coefficients are given for the
    columns as they are. Each penalty starts from the solution before it. A number of
    penalties stands for as many from the least one with no coefficient down to a
    thousandth of it, evenly in logarithms. Rows with a missing value do not count; constant
    columns get 0. After the pass for the products no row is read again.
    """
    m = moments(complete_rows(df, [*cols, target]), [*cols, target])
    n = m.n[0, 0]
    if not n:
        raise ValueError("no complete rows")
    shift = m.s.diagonal() / n
    covariance = m.p / n - np.outer(shift, shift)
    deviation = np.sqrt(np.maximum(covariance.diagonal(), 0))
    varies = deviation[:-1] > 1e-12 * np.sqrt(np.maximum(m.q.diagonal()[:-1] / n, 1e-300))
    unit = np.where(varies, deviation[:-1], 1.0)
    g = covariance[:-1, :-1] / np.outer(unit, unit)
    c = np.where(varies, covariance[:-1, -1] / unit, 0.0)
    most = float(np.abs(c).max(initial=0.0))
    if isinstance(penalties, int):
        penalties = np.geomspace(most, most / 1000, penalties).tolist() if most > 0 else [0.0]
    beta, out = np.zeros(len(cols)), []
    for penalty in sorted(penalties, reverse=True):
        done = 0
        for done in range(1, rounds + 1):
            largest = 0.0
            for j in np.flatnonzero(varies):
                rest = c[j] - g[j] @ beta + g[j, j] * beta[j]
                new = math.copysign(max(abs(rest) - penalty, 0.0), rest) / g[j, j]
                largest, beta[j] = max(largest, abs(new - beta[j])), new
            if largest <= tol * max(1.0, most):
                break
        weights = beta / unit
        variance = covariance[-1, -1]
        error = variance - 2 * beta @ c + beta @ g @ beta
        intercept = m.means[-1] + shift[-1] - float(weights @ (m.means[:-1] + shift[:-1]))
        out.append(LassoStep(float(penalty), intercept, weights.tolist(), 1 - error / variance if variance > 0 else 0.0, done))
    return out


def predict_linear(df: DataFrame, cols: Sequence[str], step: LassoStep, into: str = "prediction") -> DataFrame:
    """The prediction of one step of the path; null where a column is missing."""
    value: Column = F.lit(step.intercept)
    for c, w in zip(cols, step.coefficients, strict=True):
        value = value + quoted(c).cast("double") * F.lit(w)
    return df.withColumn(into, value)

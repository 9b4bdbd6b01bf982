"""k-means, mixtures and cluster indices over numeric columns.

Passes over the rows return sums per cluster only. The driver holds centres and sums, whose
size is clusters x columns. Indices need no distance between two rows: the mean squared
distance of a row to a cluster follows from the cluster's count, sum and sum of squares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.missing import is_missing, quoted
from tablewright.session import local_frame, small_in_memory

#: Sums of a cluster and column are the driver's largest table.
MOST_CLUSTERS = 4096


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without a missing (null or NaN) value in ``cols``."""
    fields = {f.name: f for f in df.schema.fields}
    for c in cols:
        df = df.where(~is_missing(fields[c]))
    return df


def _point(cols: Sequence[str]) -> Column:
    return F.array(*[quoted(c).cast("double") for c in cols])


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, one column for each centre."""
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _matrix(points: pd.Series, width: int) -> np.ndarray:
    return np.array(points.tolist(), float).reshape(len(points), width)


def assign(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]], into: str = "cluster") -> DataFrame:
    """Add the number of the nearest centre, the first of equally near ones; null where a column is missing."""
    held = np.array(centres, float)

    @F.pandas_udf("int")
    def nearest(points: pd.Series) -> pd.Series:
        x = _matrix(points, held.shape[1])
        found = pd.Series(_gaps(x, held).argmin(axis=1) if len(x) else [], index=points.index, dtype="Int32")
        return found.where(np.isfinite(x).all(axis=1))

    return df.withColumn(into, nearest(F.transform(_point(cols), lambda v: F.coalesce(v, F.lit(float("nan"))))))


def farthest_first(df: DataFrame, cols: Sequence[str], k: int) -> list[list[float]]:
    """Up to ``k`` rows that lie far apart: the row nearest to the mean, then always the one farthest from those before.

    Of equally far rows the one with the largest values is taken, column by column, so the
    result does not depend on the order of the rows. Fewer distinct rows give fewer
    centres. One pass for each centre.
    """
    rows = complete_rows(df, cols).select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = [F.col(f"c{i}") for i in range(len(cols))]
    with small_in_memory(rows) as held:
        mean = held.agg(*[F.avg(c) for c in names]).first()
        if mean[0] is None:
            return []

        def square(to: Sequence[float]) -> Column:
            return sum((c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(names, to, strict=True))

        centres = [list(held.agg(F.max(F.struct((-square(mean)).alias("near"), *names))).first()[0][1:])]
        while len(centres) < k:
            far = F.least(*[square(c) for c in centres]) if len(centres) > 1 else square(centres[0])
            best = held.agg(F.max(F.struct(far.alias("far"), *names))).first()[0]
            if not best["far"]:
                break
            centres.append(list(best[1:]))
    return centres


@dataclass(frozen=True)
class Centres:
    """Fitted centres, the rows of each, the sum of squared distances of all rows, and the rounds it took."""

    cols: tuple[str, ...]
    centres: list[list[float]]
    sizes: list[int]
    inertia: float
    rounds: int

    def transform(self, df: DataFrame, into: str = "cluster") -> DataFrame:
        return assign(df, self.cols, self.centres, into)


def _moments(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Count and sum of the rows nearest to each centre, and the sum of squared distances, from one pass."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cost = np.zeros(k), np.zeros((k, width)), np.zeros(k)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            gaps = _gaps(x, centres)
            near = gaps.argmin(axis=1)
            n += np.bincount(near, minlength=k)
            cost += np.bincount(near, gaps[np.arange(len(x)), near], k)
            for j in range(width):
                total[:, j] += np.bincount(near, x[:, j], k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(cost)],
            ["k", "n", "total", "cost"],
        )

    parts = points.mapInArrow(run, "k int, n double, total array<double>, cost double")
    sums = parts.groupBy("k").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)], F.sum("cost").alias("cost")
    )
    n, total, cost = np.zeros(k), np.zeros((k, width)), 0.0
    for r in sums.collect():  # one row per cluster
        n[r["k"]], total[r["k"]], cost = r["n"], list(r)[2 : 2 + width], cost + r["cost"]
    return n, total, cost


def lloyd(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]], rounds: int = 20, tol: float = 0.0) -> Centres:
    """k-means rounds from given centres: every row to its nearest centre, every centre to the mean of its rows.

    Rows with a missing value do not count. A centre without rows stays where it is. Stops
    after ``rounds``, or when no centre moves by more than ``tol``. The inertia belongs to the
    centres returned.
    """
    now = np.array(centres, float).reshape(len(centres), len(cols))
    if not len(now):
        return Centres(tuple(cols), [], [], 0.0, 0)
    if len(now) > MOST_CLUSTERS:
        raise ValueError(f"{len(now)} centres; at most {MOST_CLUSTERS}")
    with small_in_memory(complete_rows(df, cols).select(_point(cols).alias("p"))) as points:
        done = 0
        n, total, cost = _moments(points, now)
        while done < rounds:
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now)
            far = np.abs(moved - now).max(initial=0.0)
            now, done = moved, done + 1
            n, total, cost = _moments(points, now)
            if far <= tol:
                break
    return Centres(tuple(cols), now.tolist(), n.astype(int).tolist(), cost, done)


def fit_k_means(df: DataFrame, cols: Sequence[str], k: int, start: str = "farthest", rounds: int = 20, seed: int = 0) -> Centres:
    """k-means with ``k`` centres at most.

    ``start`` is "farthest" (see ``farthest_first``; the result depends on the rows only) or
    "parallel" (Spark ML's k-means||, seeded, which outliers attract less). Centres are
    numbered by their values.
    """
    if not 1 <= k <= MOST_CLUSTERS:
        raise ValueError(f"k lies between 1 and {MOST_CLUSTERS}")
    if start == "farthest":
        first = farthest_first(df, cols, k)
    elif start == "parallel":
        named = complete_rows(df, cols).select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
        rows = VectorAssembler(inputCols=named.columns, outputCol="features").transform(named)
        first = [] if rows.isEmpty() else KMeans(k=k, seed=seed, maxIter=1).fit(rows).clusterCenters()
    else:
        raise ValueError(f'start is "farthest" or "parallel", not {start!r}')
    return lloyd(df, cols, sorted(list(map(float, c)) for c in first), rounds)


def cluster_indices(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """How well given clusters part the rows: one row with rows, clusters, inertia and the usual indices.

    * silhouette: mean of (b - a) / max(a, b), where a is the mean squared distance of a row
      to the others of its cluster and b the least mean squared distance to another one; 0 for
      the row of a cluster of one.
    * calinski_harabasz: dispersion between over dispersion within, each by its degrees of freedom.
    * davies_bouldin: mean over clusters of the largest (s_i + s_j) / d_ij, s being the mean
      distance to the centre and d the distance of two centres.

    Rows without cluster or with a missing value do not count. With fewer than two
    clusters the three indices are null; calinski_harabasz too where nothing varies within the
    clusters, davies_bouldin where two centres coincide. Three passes; no pair of rows is
    compared. At most MOST_CLUSTERS clusters.
    """
    spark, width = df.sparkSession, len(cols)
    schema = "rows long, clusters long, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"
    rows = complete_rows(df, cols).where(quoted(cluster).isNotNull())
    rows = rows.select(quoted(cluster).alias("g"), *[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = [f"c{i}" for i in range(width)]
    with small_in_memory(rows) as held:
        means = held.agg(*[F.avg(c) for c in names]).first()
        if means[0] is None:
            return local_frame(spark, [(0, 0, 0.0, None, None, None)], schema)
        # Sums of squares around the mean of all rows keep their digits.
        around = [F.col(c) - F.lit(float(m)) for c, m in zip(names, means, strict=True)]
        sums = held.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(c) for c in around], F.sum(sum(c * c for c in around)).alias("squares")
        )
        found = sums.orderBy("g").limit(MOST_CLUSTERS + 1).collect()
        if len(found) > MOST_CLUSTERS:
            raise ValueError(f"more than {MOST_CLUSTERS} clusters")
        n = np.array([r["n"] for r in found], float)
        centres = np.array([list(r)[2 : 2 + width] for r in found], float) / n[:, None]
        spread = np.array([r["squares"] for r in found], float) / n
        keys = [r["g"] for r in found]
        k, total = len(n), n.sum()
        inertia = float((n * np.maximum(spread - (centres**2).sum(axis=1), 0)).sum())
        if k < 2:
            return local_frame(spark, [(int(total), k, inertia, None, None, None)], schema)
        place = {g: i for i, g in enumerate(keys)}

        @F.pandas_udf("struct<silhouette double, gap double>")
        def judge(g: pd.Series, points: pd.Series) -> pd.DataFrame:
            x, own = _matrix(points, width), g.map(place).to_numpy(int)
            at = np.arange(len(x))
            # Mean squared distance to the rows of each cluster, the row itself included where it is one.
            far = (x**2).sum(axis=1)[:, None] + spread[None, :] - 2 * x @ centres.T
            mine = n[own]
            a = np.where(mine > 1, far[at, own] * mine / np.maximum(mine - 1, 1), 0.0)
            far[at, own] = np.inf
            b = far.min(axis=1, initial=np.inf)
            top = np.maximum(a, b)
            score = np.where((mine > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
            return pd.DataFrame({"silhouette": score, "gap": np.sqrt(((x - centres[own]) ** 2).sum(axis=1))})

        judged = held.select("g", judge("g", F.array(*around)).alias("j"))
        scores = judged.groupBy("g").agg(F.sum("j.silhouette").alias("s"), F.avg("j.gap").alias("gap")).collect()
    silhouette = sum(r["s"] for r in scores) / total
    middle = (n[:, None] * centres).sum(axis=0) / total
    between = float((n * ((centres - middle) ** 2).sum(axis=1)).sum())
    ch = between / (k - 1) / (inertia / (total - k)) if inertia > 0 and total > k else None
    gap = np.zeros(k)
    for r in scores:
        gap[place[r["g"]]] = r["gap"]
    apart = np.sqrt(_gaps(centres, centres))
    np.fill_diagonal(apart, np.inf)
    db = float(((gap[:, None] + gap[None, :]) / apart).max(axis=1).mean()) if (apart > 0).all() else None
    return local_frame(spark, [(int(total), k, inertia, float(silhouette), ch, db)], schema)


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int], start: str = "farthest", rounds: int = 20, seed: int = 0) -> DataFrame:
    """k-means for each k: k, inertia, bend, chosen and the indices of ``cluster_indices``.

    bend is how far the inertia lies below the line from the first to the last k, both axes
    scaled to 0..1; the largest is chosen, the smallest k of equal ones. Fewer than three
    k have no bend, and none is chosen then.
    """
    ks = sorted(set(ks))
    found = []
    first = farthest_first(df, cols, max(ks)) if start == "farthest" else None
    for k in ks:
        if first is None:
            model = fit_k_means(df, cols, k, start, rounds, seed)
        else:
            model = lloyd(df, cols, sorted(first[:k]), rounds)
        r = cluster_indices(model.transform(df, "__cluster"), cols, "__cluster").first()
        found.append((k, model.inertia, r["silhouette"], r["calinski_harabasz"], r["davies_bouldin"]))
    high, low = found[0][1], found[-1][1]
    bends = [None] * len(found)
    if len(found) > 2 and high > low:
        for i, (k, inertia, *_) in enumerate(found):
            bends[i] = 1 - (k - ks[0]) / (ks[-1] - ks[0]) - (inertia - low) / (high - low)
    best = max((i for i, b in enumerate(bends) if b is not None), key=lambda i: (round(bends[i], 12), -i), default=None)
    rows = [(k, inertia, bends[i], i == best, *rest) for i, (k, inertia, *rest) in enumerate(found)]
    return local_frame(
        df.sparkSession,
        rows,
        "k int, inertia double, bend double, chosen boolean, silhouette double, calinski_harabasz double, davies_bouldin double",
    )


# ------------------------------------------------------------------ mixtures


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances of normal components, and the mean log-likelihood after each round."""

    cols: tuple[str, ...]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: list[float]

    def transform(self, df: DataFrame, into: str = "component", probabilities: str | None = None) -> DataFrame:
        """Add the likeliest component (null where a column is missing), and the probability of each."""
        model, width = self, len(self.cols)

        @F.pandas_udf("array<double>")
        def shares(points: pd.Series) -> pd.Series:
            x = _matrix(points, width)
            return pd.Series(list(_responsibilities(x, model)[0]), index=points.index)

        fields = {f.name: f for f in df.schema.fields}
        whole = ~F.greatest(*[is_missing(fields[c]) for c in self.cols], F.lit(False))
        point = F.transform(_point(self.cols), lambda v: F.coalesce(v, F.lit(0.0)))
        p = F.when(whole, shares(point))
        out = df.withColumn("__p", p)
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("int")
        out = out.withColumn(into, best)
        return (out.withColumn(probabilities, F.col("__p")) if probabilities else out).drop("__p")


def _responsibilities(x: np.ndarray, model: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Each component's share of each row, and each row's log-likelihood."""
    k, width = model.means.shape
    logs = np.zeros((len(x), k))
    for j in range(k):
        root = np.linalg.cholesky(model.covariances[j])
        z = np.linalg.solve(root, (x - model.means[j]).T)
        logs[:, j] = math.log(model.weights[j]) if model.weights[j] > 0 else -np.inf
        logs[:, j] -= 0.5 * (z**2).sum(axis=0) + np.log(np.diag(root)).sum() + 0.5 * width * math.log(2 * math.pi)
    top = logs.max(axis=1, keepdims=True) if len(x) else logs[:, :1]
    total = np.exp(logs - top).sum(axis=1)
    return np.exp(logs - top) / total[:, None], top[:, 0] + np.log(total)


def fit_mixture(
    df: DataFrame, cols: Sequence[str], k: int, rounds: int = 50, tol: float = 1e-6, ridge: float = 1e-6,
    means: Sequence[Sequence[float]] | None = None, diagonal: bool = False,
) -> Mixture:
    """Normal mixture by expectation maximisation.

    A round is one pass: each task returns, for each component, the sum of its shares, of
    the shares times the row, and times the row's products; the driver solves for the next
    parameters. Starts from ``means`` (else ``farthest_first``), equal weights and the
    covariance of all rows. ``ridge`` times the mean variance is added to every diagonal, so a
    component on equal rows stays regular. Rows with a missing value do not count; a
    component that no row belongs to keeps its place with weight 0. Stops when the mean
    log-likelihood gains no more than ``tol``. Without rows there is no fit, but an error.
    """
    width = len(cols)
    first = np.array(means if means is not None else farthest_first(df, cols, k), float).reshape(-1, width)
    if not len(first):
        raise ValueError("no complete rows to fit")
    with small_in_memory(complete_rows(df, cols).select(_point(cols).alias("p"))) as points:
        n, centre, spread, _ = _weighted(points, None, np.zeros((1, width)))
        if not n[0]:
            raise ValueError("no complete rows to fit")
        every = spread[0] / n[0] - np.outer(centre[0], centre[0]) / n[0] ** 2
        floor = ridge * max(float(np.trace(every)) / width, 1e-12) * np.eye(width)

        def shape(c: np.ndarray) -> np.ndarray:
            return (np.diag(np.diag(c)) if diagonal else c) + floor

        now = Mixture(tuple(cols), np.full(len(first), 1 / len(first)), first, np.stack([shape(every)] * len(first)), [])
        history: list[float] = []
        for _ in range(rounds):
            n, total, products, likelihood = _weighted(points, now, now.means)
            history.append(likelihood / n.sum())
            if len(history) > 1 and history[-1] - history[-2] <= tol:
                break
            held = np.maximum(n, 1e-300)
            shift = total / held[:, None]
            fitted = n > 1e-9
            new_means = np.where(fitted[:, None], now.means + shift, now.means)
            new = [
                shape(products[j] / held[j] - np.outer(shift[j], shift[j])) if fitted[j] else now.covariances[j] for j in range(len(n))
            ]
            now = Mixture(now.cols, np.where(fitted, n, 0) / n[fitted].sum(), new_means, np.stack(new), history)
    return Mixture(now.cols, now.weights, now.means, now.covariances, history)


def _weighted(points: DataFrame, model: Mixture | None, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Per component the sums of shares, of rows around ``around`` and of their products; and the log-likelihood."""
    k, width = around.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, 1 + width + width * width))
        likelihood = 0.0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            shares, logs = (np.ones((len(x), 1)), np.zeros(len(x))) if model is None else _responsibilities(x, model)
            likelihood += float(logs.sum())
            for j in range(k):
                y = x - around[j]
                weighted = y * shares[:, j : j + 1]
                sums[j] += np.concatenate([[shares[:, j].sum()], weighted.sum(axis=0), (weighted.T @ y).ravel()])
        flat = np.append(sums.ravel(), likelihood)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    rows = points.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k * (1 + width + width * width) + 1)
    for r in rows:  # components x (1 + columns + columns^2) numbers
        flat[r["i"]] = r["v"]
    sums = flat[:-1].reshape(k, -1)
    return sums[:, 0], sums[:, 1 : 1 + width], sums[:, 1 + width :].reshape(k, width, width), float(flat[-1])

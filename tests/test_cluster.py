import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators.cluster import cluster_indices, elbow, farthest_first, fit_k_means, fit_mixture, lloyd

XY = ["x", "y"]


def blobs(n=240, seed=1, spread=0.3):
    rng = random.Random(seed)
    centres = [(0.0, 0.0), (5.0, 0.0), (0.0, 6.0)]
    return [(i, *(c + rng.gauss(0, spread) for c in centres[i % 3]), i % 3) for i in range(n)]


def brute_indices(points, labels):
    x, g = np.array(points), np.array(labels)
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    keys = sorted(set(labels))
    scores = []
    for i in range(len(x)):
        own = (g == g[i]) & (np.arange(len(x)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a, b = gap[i][own].mean(), min(gap[i][g == k].mean() for k in keys if k != g[i])
        scores.append((b - a) / max(a, b))
    centres = np.array([x[g == k].mean(axis=0) for k in keys])
    inertia = sum(((x[g == k] - c) ** 2).sum() for k, c in zip(keys, centres))
    between = sum((g == k).sum() * ((c - x.mean(axis=0)) ** 2).sum() for k, c in zip(keys, centres))
    ch = between / (len(keys) - 1) / (inertia / (len(x) - len(keys)))
    s = [np.sqrt(((x[g == k] - c) ** 2).sum(axis=1)).mean() for k, c in zip(keys, centres)]
    db = np.mean([max((s[i] + s[j]) / math.dist(centres[i], centres[j]) for j in range(len(keys)) if j != i) for i in range(len(keys))])
    return inertia, np.mean(scores), ch, db


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_indices_against_all_pairs(spark, shift):
    data = [(x + shift, y, f"g{g}") for _, x, y, g in blobs(90)] + [(shift + 9.0, 9.0, "alone")]
    more = [(None, 1.0, "g0"), (float("nan"), 1.0, "g0"), (shift, 1.0, None)]
    found = cluster_indices(spark.createDataFrame(data + more, "x double, y double, g string").repartition(4), XY, "g").first()
    want = brute_indices([d[:2] for d in data], [d[2] for d in data])
    assert (found.rows, found.clusters) == (91, 4)
    assert [found.inertia, found.silhouette, found.calinski_harabasz, found.davies_bouldin] == pytest.approx(want, rel=1e-6)


def test_indices_of_few_rows(spark):
    schema = "x double, y double, g int"
    assert tuple(cluster_indices(spark.createDataFrame([], schema), XY, "g").first()) == (0, 0, 0.0, None, None, None)
    one = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 1.0, 1)], schema)
    assert tuple(cluster_indices(one, XY, "g").first())[:3] == (2, 1, 0.5)
    same = spark.createDataFrame([(1.0, 1.0, 1), (1.0, 1.0, 2)], schema)
    assert tuple(cluster_indices(same, XY, "g").first()) == (2, 2, 0.0, 0.0, None, None)


def test_k_means_finds_the_blobs(spark):
    df = spark.createDataFrame(blobs(), "id int, x double, y double, g int").repartition(5)
    for start in ("farthest", "parallel"):
        model = fit_k_means(df, XY, 3, start, seed=3)
        labelled = model.transform(df)
        assert labelled.select("g", "cluster").distinct().count() == 3 and model.sizes == [80, 80, 80]
        again = cluster_indices(labelled, XY, "cluster").first()
        assert again.inertia == pytest.approx(model.inertia)
    assert model.centres == sorted(model.centres)


def test_k_means_does_not_depend_on_order_and_handles_gaps(spark):
    data = blobs(60) + [(100, None, 1.0, 0), (101, float("nan"), 1.0, 0)] + [(102 + i, 0.0, 0.0, 0) for i in range(50)]
    df = spark.createDataFrame(data, "id int, x double, y double, g int")
    first, second = (fit_k_means(df.repartition(n), XY, 4) for n in (1, 7))
    assert np.allclose(first.centres, second.centres) and first.sizes == second.sizes
    labels = {r.id: r.cluster for r in first.transform(df.withColumn("cluster_id", F.lit(1))).collect()}
    assert labels[100] is labels[101] is None and labels[0] is not None
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert farthest_first(same, XY, 3) == [[1.0, 2.0]] and fit_k_means(same, XY, 3).sizes == [5]
    assert fit_k_means(same.limit(0), XY, 3).centres == []
    # A centre that no row is nearest to stays.
    assert lloyd(same, XY, [[1.0, 2.0], [50.0, 50.0]]).centres == [[1.0, 2.0], [50.0, 50.0]]
    with pytest.raises(ValueError, match="start"):
        fit_k_means(same, XY, 2, "random")


def test_elbow_chooses_the_planted_number(spark):
    df = spark.createDataFrame(blobs(), "id int, x double, y double, g int")
    found = elbow(df, XY, [1, 2, 3, 4, 5]).orderBy("k").collect()
    assert [r.k for r in found if r.chosen] == [3]
    assert max((r for r in found if r.k > 1), key=lambda r: r.silhouette).k == 3
    assert [r.inertia for r in found] == sorted((r.inertia for r in found), reverse=True)
    assert not any(r.chosen for r in elbow(df, XY, [2, 3]).collect())


def test_mixture_recovers_planted_components(spark):
    rng = np.random.default_rng(2)
    a = rng.multivariate_normal([0, 0], [[1.0, 0.6], [0.6, 0.5]], 900)
    b = rng.multivariate_normal([4, 1], [[0.3, 0.0], [0.0, 2.0]], 300)
    data = [(float(x), float(y), 0) for x, y in a] + [(float(x), float(y), 1) for x, y in b] + [(None, 1.0, 0)]
    df = spark.createDataFrame(data, "x double, y double, g int").repartition(6)
    fitted = fit_mixture(df, XY, 2, rounds=60)
    steps = np.diff(fitted.log_likelihood)
    assert (steps >= -1e-9).all()
    order = np.argsort(fitted.means[:, 0])
    assert fitted.weights[order] == pytest.approx([0.75, 0.25], abs=0.03)
    assert np.allclose(fitted.means[order], [[0, 0], [4, 1]], atol=0.25)
    assert np.allclose(fitted.covariances[order], [[[1.0, 0.6], [0.6, 0.5]], [[0.3, 0], [0, 2.0]]], atol=0.3)
    found = fitted.transform(df, probabilities="p").collect()
    right = sum((r.component == order[r.g]) for r in found if r.x is not None)
    assert right > 0.97 * 1200 and all(sum(r.p) == pytest.approx(1) for r in found if r.x is not None)
    assert [r.component for r in found if r.x is None] == [None]


def test_mixture_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([(2.0,)] * 20, "x double")
    fitted = fit_mixture(same, ["x"], 2, means=[[2.0], [9.0]])
    assert np.isfinite(fitted.covariances).all() and fitted.weights.sum() == pytest.approx(1)
    with pytest.raises(ValueError, match="no complete rows"):
        fit_mixture(same.limit(0), ["x"], 2)

"""Order statistics, ranks and cut-offs: the large-data paths against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import ordering, sampling
from tablewright.session import local_frame


def frame(spark, values, name="x"):
    return spark.createDataFrame(pd.DataFrame({name: values})).repartition(3)


def shapes():
    rng = np.random.default_rng(7)
    return {
        "even": rng.random(4000),
        "heavy_tail": np.exp(rng.normal(0, 8, 4000)),
        "one_hot_value": np.concatenate([np.full(2000, 5.0), rng.random(2000) * 10]),
        "few_values": rng.integers(0, 4, 4000).astype(float),
        "two_clusters": np.concatenate([rng.random(2001), 1e9 + rng.random(1999)]),
        "one_row": np.array([3.25]),
    }


@pytest.mark.parametrize("shape", list(shapes()))
def test_bracketed_quantiles_match_numpy(spark, monkeypatch, shape):
    monkeypatch.setattr(ordering, "EXACT_ROWS", 0)
    monkeypatch.setattr(ordering, "EXACT_VALUES", 0)
    monkeypatch.setattr(ordering, "BRACKET_ROWS", 40)
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", 100)
    values = shapes()[shape]
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    found = ordering.exact_quantiles(frame(spark, values), ["x"], probs)["x"]
    assert found == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=1e-12)


def test_halving_is_used_when_the_sketch_misses(spark):
    values = np.arange(1001.0)
    df = frame(spark, values)
    lo, hi, under, inside, between = ordering._halve(df, "x", (0.0, 1000.0), 700.0)
    assert not between and lo <= 700.0 <= hi and under == (values < lo).sum() and inside == ((values >= lo) & (values <= hi)).sum()
    # A rank between the halves keeps both neighbours.
    lo, hi, *_, between = ordering._halve(df, "x", (0.0, 1000.0), 500.5)
    assert between and (lo, hi) == (500.0, 501.0)


def test_quantiles_ignore_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,), (4.0,)], "x double")
    assert ordering.exact_quantiles(df, ["x"], [0.5])["x"] == [2.0]
    assert ordering.exact_quantiles(df.where("x > 100"), ["x"], [0.5])["x"] == [None]


def test_running_sums_by_ranges_match_one_window(spark, monkeypatch):
    rng = random.Random(3)
    data = [(i, rng.random(), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, s double, n long")
    from pyspark.sql import functions as F

    small = ordering.running_before(df, ["s"], {"b": F.col("n")}, 500)
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", 10)
    monkeypatch.setattr(ordering, "RANGE_ROWS", 60)
    large = ordering.running_before(df, ["s"], {"b": F.col("n")}, 500)
    a = {r["id"]: r["b"] for r in small.collect()}
    b = {r["id"]: r["b"] for r in large.collect()}
    running, want = 0, {}
    for i, _, n in sorted(data, key=lambda r: r[1]):
        want[i], running = running, running + n
    assert a == want and b == want


@pytest.mark.parametrize("cutoff_rows, largest, spots", [(1, 2700, 4), (7, 2700, 4), (1, 10**7, 4), (1, 10**7, 10**6), (50_000, 2700, 4)])
def test_cutoffs_take_exact_counts_in_every_group(spark, monkeypatch, cutoff_rows, largest, spots):
    monkeypatch.setattr(ordering, "CUTOFF_ROWS", cutoff_rows)
    # One class holds most rows.
    data = [(i, "hot" if i % 10 else f"rare{i % 30}") for i in range(3000)]
    df = spark.createDataFrame(data, "id long, c string")
    wanted = local_frame(
        spark, [("hot", 0, 700), ("hot", 1, 2699), ("rare0", 0, 1), ("rare10", 0, 100)], "c string, slot int, k bigint"
    )
    cuts = ordering.hash_cutoffs(df, ["id"], 42, wanted, ["c"], largest, spots).collect()
    hashes = df.select("c", ordering.row_hash(["id"], 42).alias("h")).toPandas()
    got = {(r["c"], r["slot"]): int(((hashes.c == r["c"]) & (hashes.h <= r["cut"])).sum()) for r in cuts}
    assert got == {("hot", 0): 700, ("hot", 1): 2699, ("rare0", 0): 1, ("rare10", 0): 100}


@pytest.mark.parametrize("n", [0, 1, 50, 199, 200, 500])
def test_large_samples_are_exact(spark, monkeypatch, n):
    monkeypatch.setattr(ordering, "CUTOFF_ROWS", 5)
    df = spark.range(200).withColumnRenamed("id", "k")
    if n == 0:
        n = 20
        df = df.selectExpr("7 as k").limit(200)  # nothing but copies of one row
    got = sampling.sample_rows(df, n)
    assert got.count() == min(n, 200)
    if df.distinct().count() > 1:
        assert got.distinct().count() == min(n, 200)

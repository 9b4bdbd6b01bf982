import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators.features import FEATURES, LABEL
from tablewright.operators.hashing import bucket_sums, collisions, hash_features
from tablewright.operators.models import TrainShape, model_registry
from tablewright.operators.moments import correlation_matrix, lasso_path, predict_linear, principal_components
from tablewright.operators.target_encoding import encode_out_of_fold, fit_target_means

COLS = ["a", "b", "c", "flat", "few"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 400
    a = rng.normal(size=n)
    data = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(size=n) + 1e7, "c": rng.integers(0, 5, n).astype(float), "flat": 3.5, "few": np.nan})
    data.loc[rng.random(n) < 0.2, "a"] = np.nan
    data.loc[rng.random(n) < 0.3, "c"] = np.nan
    data.loc[7, "few"] = 1.0
    schema = ", ".join(f"{c} double" for c in COLS)
    rows = [tuple(None if i % 3 == 0 and math.isnan(v) else v for v in r) for i, r in enumerate(data.itertuples(index=False, name=None))]
    return spark.createDataFrame(rows, schema).repartition(5), data


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_of_pairwise_complete_rows(frame, method):
    df, data = frame
    used = data.rank() if method == "spearman" else data
    for r in correlation_matrix(df, COLS, method).collect():
        x, y = used[r.a], used[r.b]
        both = x.notna() & y.notna()
        assert r.n == both.sum()
        if r.n < 2 or x[both].nunique() < 2 or y[both].nunique() < 2:
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-7)


def test_correlations_of_no_rows(frame):
    df, _ = frame
    assert {(r.n, r["corr"]) for r in correlation_matrix(df.limit(0), ["a", "b"]).collect()} == {(0, None)}
    with pytest.raises(ValueError, match="method"):
        correlation_matrix(df, ["a"], "kendall")


@pytest.mark.parametrize("scale", [False, True])
def test_principal_components_against_a_closed_form(frame, scale):
    df, data = frame
    whole = data[["a", "b", "c"]].dropna()
    x = whole - whole.mean()
    x = x / x.std() if scale else x
    values, vectors = np.linalg.eigh(np.cov(x.T))
    model = principal_components(df, ["a", "b", "c"], 2, scale)
    assert model.variances == pytest.approx(values[::-1][:2]) and model.shares == pytest.approx(values[::-1][:2] / values.sum())
    for k in range(2):
        assert abs(model.axes[k] @ vectors[:, 2 - k]) == pytest.approx(1)
        assert model.axes[k][np.argmax(np.abs(model.axes[k]))] > 0
    out = model.transform(df)
    told = out.agg(F.count("pc1"), F.var_samp("pc1"), F.var_samp("pc2"), F.corr("pc1", "pc2")).first()
    assert told[0] == len(whole) and list(told)[1:] == pytest.approx([*values[::-1][:2], 0], abs=1e-6)
    with pytest.raises(ValueError, match="two complete rows"):
        principal_components(df.limit(0), ["a"])


def test_lasso_against_soft_thresholds_and_least_squares(spark):
    # Columns of a full design are orthogonal.
    rng = random.Random(2)
    rows = [(float(a), float(b), 3.0 * a - 0.5 * b + rng.gauss(0, 0.3), 7.0) for a in (-1, 0, 1, 2) for b in (-3, -1, 2) for _ in range(20)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 7.0), (1.0, 1.0, float("nan"), 7.0)], "a double, b double, y double, flat double")
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    covariance = [np.cov(x[:, k], y, bias=True)[0, 1] for k in range(2)]
    for step in lasso_path(df, ["a", "b", "flat"], "y", [2.0, 0.5, 0.1, 0.0]):
        want = []
        for k in range(2):
            s = x[:, k].std()
            want.append(math.copysign(max(abs(covariance[k] / s) - step.penalty, 0), covariance[k]) / s)
        assert step.coefficients == pytest.approx([*want, 0.0])
        assert step.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ want)
    plain = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    assert step.coefficients[:2] == pytest.approx(plain[:2], abs=1e-6)
    told = predict_linear(df, ["a", "b", "flat"], step).where("not isnan(y) and a is not null").select(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    assert 1 - told / y.var() == pytest.approx(step.r2)
    path = lasso_path(df, ["a", "b"], "y", 10)
    assert path[0].coefficients == [0.0, 0.0] and len(path) == 10
    sizes = [sum(map(abs, s.coefficients)) for s in path]
    assert sizes == sorted(sizes)


def test_correlated_columns_share_the_lasso(spark):
    """Optimality: each active column's product with the residual is the penalty, the others' is below it."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 1))
    x = base + rng.normal(size=(300, 6)) * [0.2, 0.5, 1, 1, 2, 2]
    y = x @ [1.0, 0, -2, 0, 0, 0.5] + rng.normal(size=300)
    cols = [f"x{k}" for k in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in [*cols, "y"]))
    for step in lasso_path(df, cols, "y", [0.5, 0.1, 0.01]):
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        left = y - step.intercept - x @ step.coefficients
        pull = z.T @ left / len(y)
        active = np.abs(step.coefficients) > 0
        assert np.abs(pull[active]) == pytest.approx(step.penalty, rel=1e-5) and (np.abs(pull[~active]) <= step.penalty + 1e-7).all()


def test_lasso_and_svm_families(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(4)
    data = [(x, z, float(x + 0.2 * z > 0), float(2 * (x > 0.3) + (x < -0.3)), 3 * x) for x, z in ((rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300))]
    df = spark.createDataFrame(data, "x double, z double, two double, three double, y double")
    rows = VectorAssembler(inputCols=["x", "z"], outputCol=FEATURES).transform(df)
    for target, classes in (("two", 2), ("three", 3)):
        model = model_registry("classification", ["svm"])["svm"].build({"C": 10.0}, TrainShape(300, 2, classes)).fit(rows.withColumn(LABEL, F.col(target)))
        right = model.transform(rows).where(F.col("prediction") == F.col(target)).count()
        assert right > (285 if classes == 2 else 200)
    model = model_registry("regression", ["lasso"])["lasso"].build({"alpha": 0.5}, TrainShape(300, 2)).fit(rows.withColumn(LABEL, F.col("y")))
    assert model.coefficients[1] == 0 and 2 < model.coefficients[0] < 3


# ---------------------------------------------------------- target encoding


def brute_encoding(rows, smoothing):
    out = []
    for key, c, fold, _ in rows:
        rest = [(c2, y) for _, c2, f2, y in rows if f2 != fold and y is not None]
        mine = [y for c2, y in rest if c2 == c]
        if not rest:
            out.append((key, None))
            continue
        prior = sum(y for _, y in rest) / len(rest)
        out.append((key, (sum(mine) + smoothing * prior) / (len(mine) + smoothing) if mine else prior))
    return out


@pytest.mark.parametrize("smoothing", [0.0, 5.0])
def test_encoding_out_of_fold(spark, smoothing):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "y", "=x", "none", None, f"rare{i}"]), rng.choice([0, 1, 2, None]), rng.choice([rng.random(), None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, c string, fold int, y double").repartition(4)
    found = encode_out_of_fold(df, ["c"], "y", "fold", smoothing).collect()
    want = dict(brute_encoding(rows, smoothing))
    assert len(found) == 300 and found[0].__fields__ == ["k", "c", "fold", "y", "c_te"]
    for r in found:
        assert r.c_te == pytest.approx(want[r.k])
    # A row's own target changes nothing for it.
    moved = df.withColumn("y", F.when(F.col("k") == 7, 1000.0).otherwise(F.col("y")))
    again = {r.k: r.c_te for r in encode_out_of_fold(moved, ["c"], "y", "fold", smoothing).collect()}
    assert again[7] == pytest.approx(want[7])


def test_encoding_of_new_rows_gaps_and_one_fold(spark):
    df = spark.createDataFrame([("x", 1.0, 0), ("x", 3.0, 0), ("y", 8.0, 0), (None, 0.0, 0)], "c string, y double, f int")
    model = fit_target_means(df, ["c"], "y", 2.0)
    new = spark.createDataFrame([("x",), ("z",), (None,)], "c string")
    assert {r.c: r.c_te for r in model.transform(new).collect()} == {"x": 2.5, "z": 3.0, None: 2.0}
    assert {r.c_te for r in encode_out_of_fold(df, ["c"], "y", "f").collect()} == {None}
    assert encode_out_of_fold(df.limit(0), ["c"], "y", "f").collect() == []
    assert [r.c_te for r in fit_target_means(df.limit(0), ["c"], "y").transform(new).collect()] == [None] * 3
    numbers = spark.createDataFrame([(float("nan"), 1.0, 0), (None, 2.0, 1), (1.0, 3.0, 1)], "c double, y double, f int")
    assert [r.c_te for r in encode_out_of_fold(numbers, ["c"], "y", "f", 0.0).collect()] == [2.0, 1.0, 1.0]
    with pytest.raises(ValueError, match="plain values"):
        fit_target_means(df.withColumn("c", F.array("c")), ["c"], "y")


# ----------------------------------------------------------- hashed features


def test_hashed_features_cancel_collide_and_skip_gaps(spark):
    rows = [("a", 2.0), ("b", -1.0), (None, float("nan")), ("c", None), ("a", 0.0)] * 3
    df = spark.createDataFrame(rows, "t string, v double")
    out = hash_features(df, ["t", "v"], 1 << 18).collect()
    one = {r.t: [x.value for x in r.hashed] for r in out if r.t == "c"}
    assert [abs(x) for x in one["c"]] == [1.0] and [r.hashed for r in out if r.t is None] == [[]] * 3
    assert all([x.bucket for x in r.hashed] == sorted(x.bucket for x in r.hashed) for r in out)
    sums = {r.bucket: r.total for r in bucket_sums(df, ["t", "v"], 1 << 18).collect()}
    assert sorted(abs(t) for t in sums.values()) == [3.0, 3.0, 3.0, 6.0]
    assert [(r["values"], r.buckets, r.shared) for r in collisions(df, ["t", "v"], 1).orderBy("column").collect()] == [(3, 1, 3), (1, 1, 1)]
    assert [(r["values"], r.buckets, r.shared) for r in collisions(df, ["t", "v"]).orderBy("column").collect()] == [(3, 3, 0), (1, 1, 0)]
    assert bucket_sums(df.limit(0), ["t", "v"]).count() == 0


def test_out_of_fold_takes_one_join_for_each_column(spark, monkeypatch):
    from tablewright.operators import target_encoding

    joins, join = [], target_encoding.lookup_join
    monkeypatch.setattr(target_encoding, "lookup_join", lambda *args, **kwargs: joins.append(1) or join(*args, **kwargs))
    # Category b has no target in fold 1, category c in no fold.
    data = [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 5.0), ("b", 1, None), ("c", 1, float("nan")), (None, None, 2.0)]
    df = spark.createDataFrame(data, "g string, fold int, y double")
    out = target_encoding.encode_out_of_fold(df, ["g"], "y", "fold", smoothing=2.0)
    got = {(r["g"], r["fold"]): r["g_te"] for r in out.collect()}
    zero, one, none = (3 + 2) / 2, (1 + 5 + 2) / 3, (1 + 3 + 5) / 3
    assert len(joins) == 1 and got == pytest.approx(
        {("a", 0): (3 + 2 * zero) / 3, ("a", 1): (1 + 2 * one) / 3, ("b", 0): zero, ("b", 1): (5 + 2 * one) / 3, ("c", 1): one, (None, None): none}
    )

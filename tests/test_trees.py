import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler

from tablewright.operators import trees
from tablewright.operators.features import FEATURES, LABEL
from tablewright.operators.models import TrainShape, model_registry
from tablewright.operators.trees import Settings, Trees


def told(x, y, depth, classify=False, least=1, level=0):
    """What a plain greedy tree says, as a function; every cut between two values is tried."""

    def score(part):
        return sum((part == c).sum() ** 2 for c in np.unique(y)) / len(part) if classify else part.sum() ** 2 / len(part)

    best = None
    for f in range(x.shape[1]) if level < depth else ():
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            gain = score(y[low]) + score(y[~low]) - score(y)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, cut)
    if best is None:
        value = np.bincount(y.astype(int)).argmax() if classify else y.mean()
        return lambda z: np.full(len(z), value, float)
    _, f, cut = best
    low = x[:, f] <= cut
    left, right = (told(x[s], y[s], depth, classify, least, level + 1) for s in (low, ~low))
    return lambda z: np.where(z[:, f] <= cut, left(z), right(z))


def table(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)) / 4.0
    z = x[:, 0] + x[:, 1] * (x[:, 2] > 1) + rng.normal(size=n)
    return x, 1000 + z, np.digitize(z, [1.5, 3.0]).astype(float)


def frame(spark, x, y, weight=None):
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(**{LABEL: y, "w": 1.0 if weight is None else weight})
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol=FEATURES).transform(spark.createDataFrame(pdf).repartition(3))


def said(model, df):
    rows = model.transform(df).select(FEATURES, "prediction").collect()
    return {tuple(r[0]): r[1] for r in rows}


def want(x, values):
    return {tuple(r): pytest.approx(v) for r, v in zip(x.tolist(), values, strict=True)}


@pytest.mark.parametrize("least", [1, 30])
def test_one_tree_against_brute_force(spark, monkeypatch, least):
    x, y, c = table()
    assert said(Trees(Settings(1, 3, least)).fit(frame(spark, x, y)), frame(spark, x, y)) == want(x, told(x, y, 3, least=least)(x))
    s = Settings(1, 3, least, classes=3)
    assert said(Trees(s).fit(frame(spark, x, c)), frame(spark, x, c)) == want(x, told(x, c, 3, True, least)(x))
    # Few nodes a pass, sums by a shuffle, and blocks of few rows change nothing.
    monkeypatch.setattr(trees, "PASS_CELLS", 1)
    monkeypatch.setattr(trees, "DRIVER_CELLS", 0)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 50)
    assert said(Trees(s).fit(frame(spark, x, c)), frame(spark, x, c)) == want(x, told(x, c, 3, True, least)(x))


@pytest.mark.parametrize("keep_every", [2, 10])
def test_boosting_against_brute_force(spark, monkeypatch, keep_every):
    """The first tree counts in full, the others by their step; each class is told from the rest."""
    monkeypatch.setattr(trees, "KEEP_EVERY", keep_every)
    x, y, c = table()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    total = told(x, y, 2)(x)
    for _ in range(4):
        total = total + 0.3 * told(x, 2 * (y - total), 2)(x)
    assert said(Trees(Settings(5, 2, step=0.3)).fit(frame(spark, x, y)), frame(spark, x, y)) == want(x, total)
    sums = []
    for k in range(3):
        sign = np.where(c == k, 1.0, -1.0)
        total = told(x, sign, 2)(x)
        for _ in range(4):
            total = total + 0.3 * told(x, 4 * sign / (1 + np.exp(2 * sign * total)), 2)(x)
        sums.append(total)
    model = Trees(Settings(5, 2, classes=3, step=0.3)).fit(frame(spark, x, c))
    assert said(model, frame(spark, x, c)) == want(x, np.argmax(sums, axis=0).astype(float))
    two = Trees(Settings(5, 2, classes=2, step=0.3)).fit(frame(spark, x, (c == 2).astype(float)))
    rows = two.transform(frame(spark, x, c)).select(FEATURES, "probability", "prediction").collect()
    assert {tuple(r[0]): r[1][1] for r in rows} == want(x, 1 / (1 + np.exp(-2 * sums[2])))
    assert all(r[2] == float(r[1][1] > 0.5) for r in rows)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_classes_of_a_boosted_model_share_passes(spark):
    """Each class had a model of its own, with its own copy of the rows and as many jobs again."""
    x, _, c = table()
    jobs = []
    for k, y in ((2, (c > 0).astype(float)), (3, c)):
        spark.sparkContext.setJobGroup(f"boosted {k}", "")
        model_registry("classification", ["xgb"])["xgb"].build({"n_estimators": 3, "max_depth": 3}, TrainShape(400, 3, k)).fit(frame(spark, x, y))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosted {k}")))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs[1] < 1.5 * jobs[0]


def test_rows_with_weights_and_cuts_of_many_values(spark):
    x, y, c = table(120)
    copies = np.random.default_rng(1).integers(1, 5, 120)
    every = np.repeat(np.arange(120), copies)
    for s, label in (({"trees": 4, "depth": 3, "step": 0.5}, y), ({"trees": 1, "depth": 3, "classes": 3}, c)):
        plain = said(Trees(Settings(**s)).fit(frame(spark, x[every], label[every])), frame(spark, x, label))
        once = said(Trees(Settings(**s, weight="w")).fit(frame(spark, x, label, copies.astype(float))), frame(spark, x, label))
        assert once == {k: pytest.approx(v) for k, v in plain.items()}
    wide = np.random.default_rng(2).normal(size=(5000, 3))
    read = frame(spark, wide, np.zeros(5000)).select(trees.vector_to_array(FEATURES), LABEL, "w")
    for f, cuts in enumerate(trees.fit_cuts(read)):
        shares = np.diff(np.searchsorted(np.sort(wide[:, f]), cuts))
        assert len(cuts) == trees.BINS - 1 and shares.max() < 1.3 * 5000 / trees.BINS


def test_forest_draws_rows_and_features_and_is_saved(spark, tmp_path):
    x, _, c = table(900, 5)
    df = frame(spark, x, c)
    model = model_registry("classification", ["rf"])["rf"].build({"n_estimators": 8, "max_depth": 4}, TrainShape(900, 3, 3)).fit(df)
    rows = model.transform(df).select("probability", "prediction", LABEL).collect()
    assert all(sum(r[0]) == pytest.approx(1) and r[0].argmax() == r[1] for r in rows)
    assert np.mean([r[1] == r[2] for r in rows]) > 0.6
    PipelineModel([model]).write().overwrite().save(f"{tmp_path}/m")
    assert said(PipelineModel.load(f"{tmp_path}/m"), df) == said(model, df)
    with pytest.raises(ValueError, match="no rows"):
        Trees(Settings()).fit(df.limit(0))

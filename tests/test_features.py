"""Labels, splits, folds, preprocessing, prepare, models and metrics."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import features, metrics, models, neighbors, ordering, sampling
from tablewright.operators.search import run_all
from tablewright.plans.prepare import ROW_ID, prepare
from tablewright.sources.model_store import load_model


@pytest.fixture
def words(spark):
    """Small tables with a text target, a number target, and a category among the features."""
    text = pd.DataFrame({"feature1": range(1, 6), "feature2": range(10, 60, 10), "target": ["funny", "sad", "happy", "angry", "funny"]})
    number = text.assign(target=[1.5, 2.7, 3.1, 4.8, 5.9])
    mixed = pd.DataFrame(
        {"feature1": range(1, 11), "feature2": [i * 2.1 for i in range(1, 11)], "category": list("ABABABABAB"), "target": range(10, 110, 10)}
    )
    return {k: spark.createDataFrame(v) for k, v in {"text": text, "number": number, "mixed": mixed}.items()}


def test_text_target_cannot_be_regressed(words):
    with pytest.raises(ValueError, match=r"angry.*funny.*happy.*sad"):
        prepare(words["text"], "target", "regression")


def test_text_target_is_classified_without_stratification(words):
    p = prepare(words["text"], "target", "classification")
    assert not p.info.stratified and p.info.target_encoded
    assert (p.train.count(), p.test.count()) == (4, 1)
    assert p.info.majority_ratio == 0.4 and p.info.is_imbalanced is False


def test_correlated_features_are_dropped(words):
    p = prepare(words["number"], "target", "regression")
    assert p.info.leaks.by_correlation == ["feature1", "feature2"] and p.info.num_cols == p.info.cat_cols == []
    assert (p.train.count(), p.test.count()) == (4, 1)
    m = prepare(words["mixed"], "target", "regression")
    assert (m.info.leaks.names, m.info.cat_cols, m.info.num_cols) == (["feature1", "feature2"], ["category"], [])
    with pytest.raises(ValueError, match="not found"):
        prepare(words["mixed"], "absent", "regression")


def test_split_is_exact_disjoint_and_complete(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CUTOFF_ROWS", 20)
    sizes = {"a": 611, "b": 203, "c": 7, "d": 2}
    df = spark.createDataFrame([(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)], "k string, c string")
    split = sampling.train_test_split(df, "c", 0.2, key=["k"]).toPandas()
    assert sorted(split.k) == sorted(r["k"] for r in df.collect())
    test = split[split.split == "test"].groupby("c").size().to_dict()
    total = sum(sizes.values())
    assert sum(test.values()) == int(np.ceil(total * 0.2))
    for c, n in sizes.items():
        assert abs(test.get(c, 0) - n * 0.2) < 1
    again = sampling.train_test_split(df.repartition(7), "c", 0.2, key=["k"]).toPandas()
    assert dict(zip(split.k, split.split)) == dict(zip(again.k, again.split))
    plain = sampling.train_test_split(df, "c", 0.2, key=["k"], stratify=False)
    assert plain.where("split = 'test'").count() == int(np.ceil(total * 0.2))


@pytest.mark.parametrize("target", ["c", None])
def test_folds_are_balanced(spark, monkeypatch, target):
    monkeypatch.setattr(ordering, "CUTOFF_ROWS", 20)
    sizes = {"a": 611, "b": 203, "c": 7, "d": 3, "e": 1}
    df = spark.createDataFrame([(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)], "k string, c string")
    folds = sampling.assign_folds(df, 5, target, key=["k"]).toPandas()
    assert len(folds) == sum(sizes.values()) and set(folds.fold) <= set(range(5))
    for _, part in folds.groupby("c") if target else [("all", folds)]:
        counts = part.groupby("fold").size().reindex(range(5), fill_value=0)
        assert counts.max() - counts.min() <= 1


def test_preprocessor_matches_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"x": rng.normal(3, 2, n), "k": [7.0] * n, "s": rng.choice(list("abc"), n), "r": ["rare%d" % (i % 150) for i in range(n)]})
    pdf.loc[::7, "x"] = np.nan
    pdf.loc[::9, "s"] = None
    train = spark.createDataFrame(pdf).withColumn("s", F.when(F.col("s") != "NaN", F.col("s")))
    pre = features.TablePreprocessor(numericCols=["x", "k"], categoricalCols=["s", "r"]).fit(train)
    got = np.array([r["features"].toArray() for r in pre.transform(train).select("features").collect()])
    x = pdf["x"].fillna(pdf["x"].median())
    assert got[:, 0] == pytest.approx((x - x.mean()) / x.std(ddof=0), abs=1e-9)
    assert (got[:, 1] == 0).all()
    assert sampling.apply_keep(train, ["x", "gone", "s"], "s").columns == ["x", "s"]
    mode = pdf["s"].mode()[0]
    assert (got[:, 2:5] == pd.get_dummies(pdf["s"].fillna(mode)).values).all()
    # Every value of ``r`` is below 1 %: one shared slot, which unseen values do not get.
    assert got.shape[1] == 6 and (got[:, 5] == 1).all()
    unseen = spark.createDataFrame([(None, None, "z", "never"), (3.0, 7.0, "a", "rare1")], "x double, k double, s string, r string")
    rows = [r["features"].toArray().tolist() for r in pre.transform(unseen).select("features").collect()]
    assert rows[0][2:] == [0, 0, 0, 0] and rows[1][2:] == [1, 0, 0, 1]
    pre.save(str(tmp_path / "pre"))
    loaded = features.TablePreprocessorModel.load(str(tmp_path / "pre"))
    assert [r["features"].toArray().tolist() for r in loaded.transform(unseen).select("features").collect()] == rows


def test_long_texts_are_categories_too(spark):
    long = "w " * 60
    df = spark.createDataFrame([(long, 1.0)] * 6 + [("b", 1.0)] * 3 + [(None, 1.0)], "s string, x double")
    pre = features.TablePreprocessor(numericCols=[], categoricalCols=["s"]).fit(df)
    got = [r["features"].toArray().tolist() for r in pre.transform(df).select("features").collect()]
    assert got == [[0.0, 1.0]] * 6 + [[1.0, 0.0]] * 3 + [[0.0, 1.0]]


def test_registry_and_sampler():
    assert list(models.model_registry("classification", ["knn", "magic"])) == ["knn"]
    assert list(models.model_registry("regression", ["magic"])) == ["rf", "xgb"]
    with pytest.raises(ValueError, match="mlp"):
        models.model_registry("regression", ["mlp"])
    draws = models.sample_params(models.FOREST_SPACE, 200)
    assert draws == models.sample_params(models.FOREST_SPACE, 200) and len(draws) == 200
    assert {3, 19} <= {d["max_depth"] for d in draws} and max(d["n_estimators"] for d in draws) < 600
    assert {d["max_features"] for d in draws} == {"sqrt", "log2", None}
    assert all(1e-3 <= d["C"] <= 1e3 for d in models.sample_params(models.LOGREG_SPACE, 50))
    assert models.sample_params({}) == [{}]


@pytest.mark.parametrize("block", [4096, 13, 2])
@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_match_brute_force(spark, monkeypatch, block, p):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", block)
    rng = np.random.default_rng(2)
    train, query = rng.integers(0, 5, (60, 2)).astype(float), rng.integers(0, 5, (25, 2)).astype(float)
    t = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(train)], "id long, v array<double>, y double")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(query)], "id long, v array<double>")
    got = neighbors.nearest(q, t, "v", "id", "y", 4, p).orderBy("query_id", "rank").collect()
    want = []
    for i, row in enumerate(query):
        gap = np.abs(train - row) ** p
        dist = np.round(gap.sum(axis=1) ** (1 / p), 6)
        for rank, j in enumerate(np.lexsort((np.arange(60), dist))[:4], 1):
            want.append((i, rank, j, dist[j], float(j % 3)))
    assert [tuple(r) for r in got] == want


def test_neighbours_visit_few_cells_and_skip_gaps(spark, monkeypatch):
    """On a line a query needs its own cell and those next to it, however many there are."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    sent = []
    search = neighbors._search
    monkeypatch.setattr(neighbors, "_search", lambda aimed, *rest: sent.append(aimed.count()) or search(aimed, *rest))
    big = 1 << 60
    data = [(big + i, [i / 7], float(i % 2)) for i in range(600)]
    more = [(None, [1.0], 1.0), (5, None, 1.0), (6, [1.0, 2.0], 1.0), (big, [0.0], 0.0)]
    df = spark.createDataFrame(data + more[:3], "id long, v array<double>, y double").repartition(3)
    queries = spark.createDataFrame(data + more, "id long, v array<double>, y double")
    got = {}
    for r in neighbors.nearest(queries, df, "v", "id", "y", 2, skip_self=True).collect():
        got.setdefault(r.query_id - big, []).append(r.neighbor_id - big)
    want = {i: sorted((j for j in range(600) if j != i), key=lambda j: (round(abs(i - j) / 7, 6), j))[:2] for i in range(600)}
    assert {i: sorted(g) for i, g in got.items()} == {i: sorted(w) for i, w in want.items()}
    assert len(sent) == 2 and sum(sent) < 4 * 600
    assert neighbors.nearest(queries, df.limit(0), "v", "id", "y").count() == 0


def test_metrics_on_ties_and_empty_classes(spark, monkeypatch):
    pdf = pd.DataFrame({"y": [1, 0, 1, 0, 1, 0, 0], "score": [0.9, 0.9, 0.4, 0.1, 0.4, 0.4, 0.2]})
    df = spark.createDataFrame(pdf)
    pos, neg = pdf[pdf.y == 1].score.values, pdf[pdf.y == 0].score.values
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", 1)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(want)
    preds = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c"), ("b", "b")], "y string, p string")
    row = metrics.classification_scores(preds).first()
    assert (row["acc"], row["f1_macro"]) == pytest.approx((0.5, (2 / 3 + 0.5 + 0) / 3))
    assert (row["precision_macro"], row["recall_macro"]) == pytest.approx(((1 + 0.5 + 0) / 3, (0.5 + 0.5 + 0) / 3))
    assert metrics.roc_auc(df.where("y = 1")).first()[0] is None


def test_search_trains_ranks_and_saves(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=240)
    pdf = pd.DataFrame({"key": range(240), "x": x, "z": rng.normal(size=240), "s": rng.choice(["u", "v"], 240), "kind": np.where(x + 0.3 * rng.normal(size=240) > 0, "yes", "no")})
    p = prepare(spark.createDataFrame(pdf), "kind", "classification", key=["key"])
    assert p.info.stratified
    small = {"n_estimators": 4, "max_depth": 3, "max_iter": 20, "n_neighbors": 5}
    runs, trained = run_all(
        p.train, p.test, "classification", ["logreg", "rf", "knn"], p.preprocessor, [ROW_ID], n_iter=1, folds=2,
        overrides=small, artifacts_dir=str(tmp_path),
    )
    board = {r["model"]: r for r in runs.collect()}
    assert set(board) == {"logreg", "rf", "knn"} and board["knn"]["model_path"] is None
    assert board["logreg"]["acc"] > 0.7 and board["logreg"]["roc_auc"] > 0.8 and board["rf"]["cv_score"] > 0.6
    model = load_model(board["logreg"]["model_path"])
    a = [r["prediction"] for r in model.transform(p.test).orderBy(ROW_ID).collect()]
    b = [r["prediction"] for r in trained["logreg"].transform(p.test).orderBy(ROW_ID).collect()]
    assert a == b


def test_onehot_rare_reads_whole_texts(spark, tmp_path):
    from tablewright.plans.cleaning_queries import QUERIES

    # Texts that differ behind the first letter only; one in ten is a long one.
    data = [(i, "a" * 5000 if i % 10 == 0 else f"a{i}", "en" if i else None, "web") for i in range(400)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["name"], r["slot"]): r["rows"] for r in QUERIES["onehot_rare"](spark, str(tmp_path)).collect()}
    long = "md5:" + hashlib.md5(b"a" * 5000).hexdigest()
    assert found == {("lang", "en"): 400, ("source", "web"): 400, ("text", long): 40, ("text", "(rare)"): 360}


@pytest.mark.parametrize("p", [1, 2])
def test_candidates_of_wide_rows_lose_no_tie(p):
    """Screening by a matrix product, and by a bound, leaves the rows that plain sorting gives."""
    rng = np.random.default_rng(3)
    train = np.repeat(rng.normal(size=(60, 24)).astype(np.float32).astype(float) * 50, 4, axis=0)
    queries, ids = np.vstack([train[::3], rng.normal(size=(40, 24)) * 50]), np.arange(240)[::-1]
    q_ids = np.concatenate([ids[::3], 1000 + np.arange(40)])
    plain = np.round(neighbors._gaps(queries, train, p), 6)
    plain[q_ids[:, None] == ids[None, :]] = np.inf
    for k in (1, 5):
        want = {(q, ids[j], plain[i, j]) for i, q in enumerate(q_ids) for j in sorted(range(240), key=lambda j: (plain[i, j], ids[j]))[:k]}
        kth = np.sort(plain, axis=1)[:, k - 1]
        for bound in (np.full(len(queries), np.inf), kth):
            near = np.zeros(len(queries)), bound
            found = neighbors._best(queries, q_ids, near, train, ids, np.zeros(240), np.ones(240), k, p, True).to_pylist()
            assert {(r["query_id"], r["neighbor_id"], r["distance"]) for r in found} == want and len(found) == len(want)


def test_queries_are_aimed_in_small_parts(spark):
    """Distances to 1,024 pivots were held for a whole batch of 10,000 queries at a time."""
    cells = np.ones((3, 40_000), bool)
    b = neighbors.pa.RecordBatch.from_arrays([neighbors.pa.array([1, 2, 3]), neighbors.pa.array([[0.0]] * 3)], ["id", "v"])
    sizes = [len(x) for x in neighbors._aimed(b, cells, np.zeros(cells.shape), np.full(3, np.inf))]
    assert sum(sizes) == 120_000 and max(sizes) <= neighbors.OUT_ROWS


def test_learners_read_parts_of_bounded_size(spark, monkeypatch):
    """Eight partitions stayed eight, however many rows they held."""
    from tablewright.operators import search

    monkeypatch.setattr(search, "PART_ROWS", 100)
    held, rows = search.kept(spark.range(0, 3000, 1, 8))
    sizes = held.rdd.glom().map(len).collect()
    held.unpersist()
    assert rows == sum(sizes) == 3000 and len(sizes) == 30 and max(sizes) <= 200


def test_a_value_on_the_end_of_a_bin_begins_the_next(spark):
    """The end of bin 2 is 10020.96; summed in steps it came out above, and the value fell in bin 2."""
    from tablewright.operators.charts import histogram

    df = spark.createDataFrame([(909.78,), (10020.96,), (92021.58,)], "x double")
    assert [r["bin"] for r in histogram(df, "x", 30).orderBy("bin").collect() if r["count"]] == [0, 3, 29]

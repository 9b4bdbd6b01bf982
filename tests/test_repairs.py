"""Repeated rows, long texts, lost files and other cases that once went wrong."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.kinds import analyze_columns
from tablewright.operators import ordering, sampling
from tablewright.operators.advise import AVAILABLE, normalize_profile
from tablewright.operators.cleaning import apply_type_casts, fit_imputations
from tablewright.operators.features import fit_slots
from tablewright.operators.merge import horizontal_join
from tablewright.operators.models import model_registry
from tablewright.operators.profile import top_values
from tablewright.sources.tables import read_many


def repeated(spark, parts=3):
    rows = [(i % 4 if i % 3 else 9, "a" if i % 3 else "b") for i in range(1000)]
    return spark.createDataFrame(rows, "x long, c string").repartition(parts)


@pytest.mark.parametrize("target", [None, "c"])
def test_split_is_exact_for_repeated_rows(spark, target):
    df = repeated(spark)
    out = sampling.train_test_split(df, target or "c", 0.2, stratify=target is not None)
    assert out.where("split = 'test'").count() == 200 and out.count() == 1000
    if target:
        assert {r["c"]: r["n"] for r in out.where("split = 'test'").groupBy("c").agg(F.count("*").alias("n")).collect()} == {
            "a": 133,
            "b": 67,
        }


@pytest.mark.parametrize("target", [None, "c"])
def test_folds_are_even_for_repeated_rows(spark, target):
    out = sampling.assign_folds(repeated(spark), 5, target)
    sizes = [r["n"] for r in out.groupBy(*([target] if target else []), "fold").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000
    assert len(sizes) == (10 if target else 5) and max(sizes) - min(sizes) <= (134 - 66 if target else 1)
    if not target:
        assert sizes == [200] * 5


def test_one_row_holds_a_third(spark):
    df = spark.range(600).select(F.when(F.col("id") < 200, -1).otherwise(F.col("id")).alias("k"))
    assert sampling.train_test_split(df, "k", 0.3, stratify=False).where("split = 'test'").count() == 180
    sizes = [r["count"] for r in sampling.assign_folds(df, 7).groupBy("fold").count().collect()]
    assert sum(sizes) == 600 and max(sizes) - min(sizes) <= 1


def test_long_texts_tie_by_value(spark):
    long = "a" * 70
    df = spark.createDataFrame([("b",), (long,), ("c",), (long[:-1] + "b",)], "t string")
    assert [r["value"] for r in top_values(df, ["t"], 1).collect()] == [long]
    assert [r["value"] for r in top_values(df, ["t"], 3).orderBy("rank").collect()] == [long, long[:-1] + "b", "b"]
    _, fills, _ = fit_slots(df, ["t"], 0.9)
    mode = fit_imputations(df, [{"name": "t", "strategy": "most_frequent"}])["t"][1]
    digest = spark.createDataFrame([(mode,)], "t string").select(F.md5("t")).first()[0]
    assert mode == long and fills["t"] == f"md5:{digest}"


def test_kind_looks_at_all_rows(spark):
    rows = [("x",)] * 2000 + [("2020-01-01",)] * 9000
    df = spark.createDataFrame(rows, "d string")
    assert analyze_columns(df)["date_cols"] == ["d"] == analyze_columns(df.repartition(7))["date_cols"]
    assert analyze_columns(df.limit(0))["cat_cols"] == ["d"]


def test_same_file_names_are_both_read(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "o.csv").write_text(f"k,v\n1,{folder}\n")
    (tmp_path / "bad.parquet").write_text("no table")
    paths = [str(tmp_path / "a/o.csv"), str(tmp_path / "b/o.csv"), str(tmp_path / "bad.parquet")]
    tables, failures = read_many(spark, paths)
    assert sorted(tables) == ["a/o.csv", "b/o.csv"] and list(failures) == [paths[2]]
    joined = horizontal_join(tables)
    assert joined.columns == ["k", "v"] or sorted(joined.columns)[0] == "k"
    left = tables["a/o.csv"].withColumn("w", F.lit(1))
    right = tables["b/o.csv"].drop("v").withColumn("z", F.lit(2)).withColumn("u", F.lit(3))
    wide = horizontal_join({"a/o.csv": left, "b/o.csv": right})
    assert len(set(wide.columns)) == len(wide.columns) == 5


def test_nan_casts_to_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), float("nan"))], "b double, s double")
    got = apply_type_casts(df, [{"name": "b", "to_dtype": "bool"}, {"name": "s", "to_dtype": "string"}]).collect()
    assert [tuple(r) for r in got] == [(True, "1.0"), (None, None)]


def test_profile_of_several_partitions(spark):
    df = spark.createDataFrame([(f"c{i}", "int", 1, 2) for i in range(6)], "name string, dtype string, missing int, nunique int")
    assert normalize_profile(df.repartition(3)).count() == 6


def test_advice_names_models_that_exist():
    for task, names in AVAILABLE.items():
        assert set(names) <= set(model_registry(task, names))
    with pytest.raises(ValueError, match="max_depth"):
        from tablewright.operators.models import _depth

        _depth({"max_depth": 31}, 10)


def test_scorings(spark):
    from pyspark.ml.linalg import Vectors

    from tablewright.operators.search import fold_score

    rows = [(1.0, 1.0, Vectors.dense([0.2, 0.8])), (0.0, 1.0, Vectors.dense([0.4, 0.6])), (0.0, 0.0, Vectors.dense([0.9, 0.1]))]
    df = spark.createDataFrame(rows, ["label", "prediction", "probability"])
    assert fold_score(df, "classification", "roc_auc") == 1.0
    assert fold_score(df, "classification", "accuracy") == pytest.approx(2 / 3)
    assert fold_score(df, "regression", "neg_mean_absolute_error") == pytest.approx(-1 / 3)
    for task in ("classification", "regression"):
        with pytest.raises(ValueError, match="one of"):
            fold_score(df, task, "no_such_score")


def test_rank_between_two_heavy_values_ends(spark, monkeypatch):
    for name, value in (("EXACT_ROWS", 0), ("EXACT_VALUES", 0), ("BRACKET_ROWS", 1), ("SKETCH_ACCURACY", 100)):
        monkeypatch.setattr(ordering, name, value)
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, 1.0, 2.0, 2.0]}))
    assert ordering.exact_quantiles(df, ["x"], [0.5])["x"] == [1.5]
    heavy = np.repeat([1.0, 2.0, 3.0, 4.0], 50)
    frame = spark.createDataFrame(pd.DataFrame({"x": heavy}))
    found = ordering.exact_quantiles(frame, ["x"], [0.25, 0.5, 0.75])["x"]
    assert found == pytest.approx(list(np.quantile(heavy, [0.25, 0.5, 0.75])))

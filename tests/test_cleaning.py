"""Types, dates, cleaning, masking, leakage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.dates import parse_datetime
from tablewright.functions.kinds import analyze_columns
from tablewright.functions.pii import mask_pii
from tablewright.operators import cleaning, leakage
from tablewright.operators.profile import fit_promote_dates

NAN = float("nan")


def test_date_reading(spark):
    texts = {
        "2024-01-02": "2024-01-02 00:00:00",
        "2024-1-2 3:04:05": "2024-01-02 03:04:05",
        "2020": "2020-01-01 00:00:00",
        "1/2/2024": "2024-01-02 00:00:00",
        "2024/3/4": "2024-03-04 00:00:00",
        "20240102": "2024-01-02 00:00:00",
        "10:30": None,
        "now": None,
        "funny": None,
        "3.5": None,
        "12345678": None,
        "2024-13-01": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", parse_datetime(F.col("t")).cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == texts


def test_column_groups(spark):
    data = [(1, True, f"2024-01-{i % 28 + 1:02d}", "x", None) for i in range(60)]
    df = spark.createDataFrame(data, "n int, b boolean, d string, s string, e string")
    assert analyze_columns(df) == {"num_cols": ["n", "b"], "cat_cols": ["s", "e"], "date_cols": ["d"]}
    # 80 % is not enough.
    mixed = spark.createDataFrame([("2024-01-01",)] * 40 + [("no",)] * 10, "d string")
    assert analyze_columns(mixed)["cat_cols"] == ["d"]
    # A column that is empty at first is still probed.
    late = spark.createDataFrame([(None,)] * 1500 + [("2024-01-01",)] * 60, "d string").coalesce(1)
    assert analyze_columns(late)["date_cols"] == ["d"]
    with pytest.raises(TypeError, match="nested"):
        analyze_columns(spark.createDataFrame([([1],)], "v array<int>"))


def test_date_promotion_needs_every_value(spark):
    good = [("2024-01-01", "2024-01-01", "2024-01-01")] * 19
    df = spark.createDataFrame(good + [("2024-02-02", "bad", None)], "a string, b string, c string")
    assert fit_promote_dates(df) == ["a", "c"]
    half = spark.createDataFrame([("2024-01-01",), (None,)], "a string")
    assert fit_promote_dates(half) == []


def test_casts_leave_a_column_that_would_lose_values(spark):
    df = spark.createDataFrame([("1", "3.7", 1, 2, "x", 2.0), ("no", "4", 0, 1, "y", NAN)], "a string, b string, c int, d int, e string, f double")
    casts = [("a", "int"), ("b", "INT"), ("c", "bool"), ("d", "bool"), ("e", "boolean"), ("f", "Int64"), ("g", "int"), ("a2", "x")]
    fitted = cleaning.fit_type_casts(df, [{"name": n, "to_dtype": t} for n, t in casts])
    assert fitted == {"a": "bigint", "c": "boolean", "f": "bigint"}
    out = cleaning.cast_columns(df, fitted)
    assert [tuple(r) for r in out.collect()] == [(1, "3.7", True, 2, "x", 2), (None, "4", False, 1, "y", None)]


def test_imputation_and_clipping(spark):
    df = spark.createDataFrame(
        [(1.0, "b", None), (NAN, "a", None), (3.0, "a", None), (None, "b", None), (100.0, None, None)],
        "x double, s string, e string",
    )
    out = cleaning.impute(df, [{"name": "x", "strategy": "median"}, {"name": "s"}, {"name": "e"}, {"name": "q"}])
    assert [tuple(r) for r in out.collect()] == [
        (1.0, "b", None), (3.0, "a", None), (3.0, "a", None), (3.0, "b", None), (100.0, "a", None)
    ]
    bounds = cleaning.fit_iqr_clip(df, ["x", "absent"])
    q1, q3 = np.quantile([1.0, 3.0, 100.0], [0.25, 0.75])
    assert bounds == {"x": (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))}
    tight = cleaning.clip_columns(df, {"x": (2.0, 50.0)})
    values = [r["x"] for r in tight.collect()]
    assert values == [2.0, None, 3.0, None, 50.0]
    assert [r["x"] for r in cleaning.clip_columns(tight, {"x": (2.0, 50.0)}).collect()] == values


def test_uninformative_columns(spark):
    data = [(None, 7, i, 1.0 if i == 0 else None, NAN) for i in range(60)]
    df = spark.createDataFrame(data, "a string, b int, c int, d double, e double")
    found = cleaning.fit_uninformative(df)
    assert (found.all_null, found.constant, found.high_missing) == (["a", "e"], ["b", "d"], [])
    two = df.withColumn("d", F.when(F.col("c") < 2, F.col("c")))
    assert cleaning.fit_uninformative(two, 0.9).high_missing == ["d"]
    assert cleaning.drop_uninformative(df).columns == ["c"]


def test_calendar_parts_of_missing_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), (None,)], "d string")
    a, b = cleaning.expand_datetime(df, ["d"]).collect()
    assert tuple(a) == (2024, 2, 29, 3, 0.0, 1.0)
    assert tuple(b) == (None, None, None, None, 0.0, 0.0)


def test_masking(spark):
    texts = {
        "mail a.b+c@x-y.org now": "mail *** now",
        "call +1 555-123-4567": "call ***",
        "id 123456789012345678": "id ***678"[:3] + "***678"[:],
        "on 2024-01-02": "on 2024-01-02",
        "six 123456": "six ***",
        "none": "none",
        None: None,
    }
    df = spark.createDataFrame([(t, 123456) for t in texts], "t string, n int")
    got = mask_pii(df)
    assert [r["t"] for r in got.collect()] == list(texts.values())
    assert {r["n"] for r in got.collect()} == {123456}
    again = [r["t"] for r in mask_pii(got).collect()]
    assert again == list(texts.values())


def test_leakage_by_name_and_correlation(spark):
    assert leakage.leakage_by_name(["Survived_copy", "my_label", "TARGETS", "plain"], "survived") == ["Survived_copy", "my_label", "TARGETS"]
    assert leakage.leakage_by_name(["day", "y_axis"], "y") == ["day", "y_axis"]
    assert leakage.leakage_by_name(["day", "y_axis"], "y", whole_word=True) == ["y_axis"]
    pdf = pd.DataFrame({"t": [1.0, 2, 3, 4, 5, None], "a": [2.0, 4, 6, 8, 10, 1], "c": [1.0] * 6, "n": [1.0, None, 9, 2, 4, 1]})
    df = spark.createDataFrame(pdf)
    got = {r["name"]: r["correlation"] for r in leakage.corr_with_target(df, "t", "regression").collect()}
    assert got["a"] == 1.0 and got["c"] is None
    assert got["n"] == pytest.approx(pdf[["n"]].corrwith(pdf["t"])["n"], abs=1e-6)


def test_target_codes_by_appearance(spark, rows):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c"), (4, None)], "o int, t string")
    assert rows(leakage.target_codes(df, "t", ["o"])) == [("a", 1), ("b", 0), ("c", 2)]
    assert rows(leakage.target_codes(df, "t")) == [("a", 0), ("b", 1), ("c", 2)]

"""Joins: size-checked lookups, hot keys, missing keys, n-way merges."""

import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import joins, merge, sampling


@pytest.fixture
def skewed(spark):
    """A third of the rows under one key, missing keys, and copies."""
    left = [(1, i) for i in range(120)] + [(None, i) for i in range(30)] + [(i % 40, i) for i in range(200)] + [(5, 5)] * 40
    right = [(1, "a"), (None, "n"), (2, "b"), (77, "z")]
    return (
        spark.createDataFrame(left, "k long, v long").repartition(3),
        spark.createDataFrame(right, "k long, w string"),
        left,
        right,
    )


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_lookup_join_small_and_large(spark, monkeypatch, skewed, rows, small, how):
    left, right, l, r = skewed
    table = joins.materialize(right, 100 if small else 1)
    assert table.small == small and table.rows == 4
    monkeypatch.setattr(joins, "HOT_SHARE", 1 / 20)
    names = dict(r)
    if how == "left":
        want = [(k, v, names.get(k)) for k, v in l]
    else:
        want = [(k, v) for k, v in l if (k in names) == (how == "left_semi")]
    assert rows(joins.lookup_join(left, table, ["k"], how)) == sorted(want, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_repeated_keys_match_pandas(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_SHARE", 1 / 10)
    a = pd.DataFrame({"k": [1.0] * 30 + [None] * 5 + [2, 3, 4], "x": range(38)})
    b = pd.DataFrame({"k": [2.0] * 25 + [None, 1, 1, 9], "y": range(29)})
    want = pd.merge(a, b, on="k", how=how)
    tables = {
        "a": spark.createDataFrame(a).withColumn("k", F.when(~F.isnan("k"), F.col("k"))),
        "b": spark.createDataFrame(b).withColumn("k", F.when(~F.isnan("k"), F.col("k"))),
    }
    got = merge.horizontal_join(tables, how, prefix=False, dedupe=False).toPandas()
    key = lambda df: sorted(map(repr, df[["k", "x", "y"]].astype(float).fillna(-1).values.tolist()))
    assert key(got) == key(want)


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_one_shuffle_join_of_three_tables_matches_pandas(spark, how):
    a = pd.DataFrame({"k": [1, 1, 2, None, None, 5], "j": list("xxyzzx"), "o": range(6), "p": [5, 1, 2, 8, 9, 4]})
    b = pd.DataFrame({"k": [2, 1, None, 7], "j": list("yxzq"), "o": range(4), "q": list("abcd")})
    c = pd.DataFrame({"k": [1, 2, 2, 7], "j": list("xyyq"), "o": [3, 1, 0, 2], "r": [1.5, 2.5, 3.5, 4.5]})
    frames = {"d/a.csv": a, "b.csv": b, "c.csv": c}
    want = None
    for name, f in frames.items():
        stem = name.rsplit("/", 1)[-1][:-4]
        f = f.sort_values("o").drop_duplicates(["j", "k"], keep="first").drop(columns="o")
        f = f.rename(columns={x: f"{stem}__{x}" for x in f.columns if x not in ("j", "k")})
        want = f if want is None else pd.merge(want, f, on=["j", "k"], how=how)
    sparked = {
        n: spark.createDataFrame(f).withColumn("k", F.when(~F.isnan("k"), F.col("k"))).withColumnRenamed("o", f"o{i}")
        for i, (n, f) in enumerate(frames.items())
    }
    orders = {n: [f"o{i}"] for i, n in enumerate(frames)}
    got = merge.horizontal_join(sparked, how, order_by=orders)
    assert got.columns[:2] == ["j", "k"]
    got = got.drop(*[x for x in got.columns if x.split("__")[-1] in ("o0", "o1", "o2")]).toPandas()
    text = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert text(got) == text(want)


def test_one_shuffle_join_has_one_exchange(spark):
    tables = {n: spark.range(50).select(F.col("id").alias("k"), F.col("id").alias(n)) for n in "abc"}
    plan = merge.horizontal_join(tables, "outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_metadata_and_stack(spark, rows):
    a = spark.createDataFrame([(1, "x", 2.0)], "id int, n string, a double")
    b = spark.createDataFrame([("y", 2**40)], "n string, id long")
    c = spark.createDataFrame([("y", 3, 1)], "n string, id int, a int")
    tables = {"a.csv": a, "b.csv": b, "c.csv": c}
    assert merge.common_columns(tables) == ["id", "n"] and merge.common_columns({"a": a}) == []
    assert merge.missing_columns(tables) == {"a.csv": [], "b.csv": ["a"], "c.csv": []}
    stacked = merge.vertical_stack(tables)
    assert stacked.columns == ["id", "n", "_source_file"] and dict(stacked.dtypes)["id"] == "bigint"
    assert stacked.count() == 3
    with pytest.raises(ValueError):
        merge.vertical_stack({"a": a.select("a"), "b": b})
    with pytest.raises(ValueError, match="several tables"):
        merge.horizontal_join({"a.csv": a, "b.csv": b, "d.csv": c.select("id", "n", "a")}, prefix=False)


def test_keep_frequent_and_dedupe(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "t string, o int")
    assert rows(sampling.keep_frequent(df, "t")) == [("a", 1), ("a", 2)]
    assert rows(merge.dedupe_keys(df, ["t"], ["o"])) == sorted([("a", 1), ("b", 3), (None, 4)], key=repr)
    assert merge.duplicate_key_count(df, ["t"]).first()[0] == 2


def test_salted_copies_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 1 / 10)
    a = spark.createDataFrame([(1, i) for i in range(40)], "k int, x int")
    b = spark.createDataFrame([(1, i) for i in range(30)], "k int, y int")
    got = joins.skewed_inner_join(a, b, ["k"]).select("x", "y").collect()
    assert sorted(map(tuple, got)) == sorted(itertools.product(range(40), range(30)))

import pytest
from pyspark.sql import functions as F

from tablewright.operators import ordering
from tablewright.operators.importance import permutation_importance, permute_column
from tablewright.plans.prepare import prepare


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(400).select("id", (F.col("id") % 7).alias("a"), F.lit(3).alias("flat"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("gaps"))
    return df.withColumn("y", F.col("a") * 2.0).repartition(5)


@pytest.mark.parametrize("few", [True, False])
def test_a_permutation_keeps_values_and_rows(frame, monkeypatch, few):
    if not few:
        monkeypatch.setattr(ordering, "ONE_TASK_ROWS", 10)
        monkeypatch.setattr(ordering, "RANGE_ROWS", 50)
    out = permute_column(frame, "gaps", ["id"], 1).cache()
    assert out.columns == frame.columns and out.count() == 400
    assert out.select("id", "a", "y").exceptAll(frame.select("id", "a", "y")).isEmpty()
    assert out.select("gaps").exceptAll(frame.select("gaps")).isEmpty()
    moved = out.where(~F.col("gaps").eqNullSafe(F.when(F.col("id") % 5 > 0, F.col("id")))).count()
    assert moved > 300
    again = permute_column(frame.repartition(2), "gaps", ["id"], 1)
    assert again.exceptAll(out).isEmpty() and not permute_column(frame, "gaps", ["id"], 2).exceptAll(out).isEmpty()


def test_importance_of_used_unused_and_constant_columns(frame):
    def measure(df):
        return -df.agg(F.avg(F.abs(F.col("a") * 2 + F.col("flat") - 3 - F.col("y")))).first()[0]

    found = {r.column: r for r in permutation_importance(frame, ["gaps", "flat", "a"], measure, ["id"], 2).collect()}
    assert found["gaps"].importance == found["flat"].importance == 0 and found["a"].importance > 3
    assert {r.baseline for r in found.values()} == {0.0}
    with pytest.raises(ValueError, match="key"):
        permutation_importance(frame, ["id"], measure, ["id"])


def test_class_names_come_back(spark):
    rows = [(i, ["red", "blue", "green"][i % 3], float(i % 3)) for i in range(60)]
    ready = prepare(spark.createDataFrame(rows, "id int, colour string, x double"), "colour", "classification", key=["id"])
    assert sorted(map(tuple, ready.classes.collect())) == [(0.0, "blue"), (1.0, "green"), (2.0, "red")]
    told = ready.data.select(F.col("label").alias("prediction"), "x")
    named = ready.name_classes(told).select("x", "class").distinct().collect()
    assert sorted(map(tuple, named)) == [(0.0, "red"), (1.0, "blue"), (2.0, "green")]
    unknown = spark.createDataFrame([(7.0,), (None,)], "prediction double")
    assert [r["class"] for r in ready.name_classes(unknown).collect()] == [None, None]
    ready.release()
    number = prepare(spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(30)], "id int, y double, x double"), "y", "regression", key=["id"])
    with pytest.raises(ValueError, match="no classes"):
        number.name_classes(told)
    number.release()

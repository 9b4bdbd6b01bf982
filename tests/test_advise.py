"""Advisors, run logs, questions, sources and streams on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import advise, cleaning, questions, runs
from tablewright.operators.profile import kind_counts, light_profile, masked_examples, profile
from tablewright.plans.registry import all_oracles, all_queries
from tablewright.sources import tables as io
from tablewright.streaming.apply import write_cleaned


def columns(*facts):
    return [{"name": n, "dtype": t, "nunique": u, "missing": m} for n, t, u, m in facts]


@pytest.fixture
def passengers(spark):
    cols = columns(
        ("PassengerId", "int64", 100, 0), ("Survived", "int64", 2, 0), ("Pclass", "int64", 3, 0),
        ("Name", "object", 100, 0), ("Sex", "object", 2, 0), ("AllOnes", "int64", 1, 0),
    )
    return advise.profile_from_dict(spark, {"shape": {"rows": 100}, "columns": cols})


def test_target_advice(passengers, rows):
    found = advise.target_candidates(passengers).orderBy("rank").collect()
    assert [r["name"] for r in found] == ["Survived", "Pclass", "Sex"]
    advice = advise.advise_target(passengers).first()
    assert (advice["target"], advice["task"], advice["confidence"]) == ("Survived", "classification", 0.6)
    assert advice["keep_columns"] == ["Pclass", "Name", "Sex"]
    assert [tuple(d) for d in advice["drop_columns"]] == [("PassengerId", "identifier_like"), ("AllOnes", "constant_column")]
    plan = advise.task_plan(passengers).first()
    assert (plan["task_type"], plan["target_candidates"], plan["folds"], plan["stratified"]) == ("classification", ["Survived"], 5, True)


def test_cleaning_advice(spark):
    cols = columns(
        ("id", "int64", 100, 0), ("age", "float64", 70, 5), ("income", "float64", 90, 10), ("signup_date", "object", 80, 0),
        ("gender", "object", 2, 1), ("all_same", "object", 1, 0), ("free_text", "object", 95, 0),
    )
    plan = advise.plan_for(advise.profile_from_dict(spark, {"shape": [100, 7], "columns": cols}))
    assert [d["name"] for d in plan["drop_columns"]] == ["id", "all_same"]
    assert {i["name"]: i["strategy"] for i in plan["imputations"]} == {"age": "median", "income": "median", "gender": "most_frequent"}
    assert plan["parse_dates"] == ["signup_date"]
    assert plan["scaling"]["columns"] == plan["outliers"]["columns"] == ["age", "income"]
    assert [t["name"] for t in plan["text_processing"]] == ["signup_date", "free_text"]


def test_profile_keys_are_normalised(spark, rows):
    given = {
        "shape": [100, 5],
        "columns": [
            {"name": "age", "dtype": "int64", "missing_pct": 5.0, "unique_count": 40},
            {"col": "income", "dtype": "float64", "missing": 2, "unique": 7},
            {"dtype": "object"},
            "plain",
        ],
    }
    got = advise.profile_from_dict(spark, given).select("name", "rows", "missing", "nunique")
    assert rows(got) == [("age", 100, 5, 40), ("income", 100, 2, 7)]


def test_plan_limits():
    assert advise.map_algorithms(["xgboost", "random_forest", "svm"], "classification") == ["xgb", "rf"]
    assert advise.map_algorithms(["ridge"], "classification") == ["rf", "xgb"] == advise.map_algorithms([], "regression")


def test_profile_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    got = {r["name"]: r for r in profile(empty).collect()}
    assert got["a"]["rows"] == got["b"]["nunique"] == 0 and got["a"]["mean"] is None
    nan, null = [spark.createDataFrame([(v, "x"), (1.0, None), (2.0, "x")], "a double, b string") for v in (float("nan"), None)]
    assert [tuple(r) for r in profile(nan).orderBy("pos").collect()] == [tuple(r) for r in profile(null).orderBy("pos").collect()]
    row = profile(null).where("name = 'b'").first()
    assert [tuple(v) for v in row["top_values"]] == [("x", 2)] and row["missing_pct"] == 33.33
    assert tuple(kind_counts(light_profile(null)).first())[:2] == (1, 1)
    assert masked_examples(spark.createDataFrame([("a@b.org", 1)], "m string, n int")).first()["m"] == "***"


RUNS = "run_id int, model string, task string, target string, cv_score double, fit_s double, predict_s double, acc double, f1_macro double, roc_auc double, rmse double, mae double, r2 double"


def test_run_summaries(spark, rows):
    log = spark.createDataFrame(
        [
            (1, "rf", "classification", "t", 0.6, 2.0, 0.2, 0.6, 0.6, None, None, None, None),
            (1, "xgb", "classification", "t", 0.8, 4.0, 0.1, 0.8, 0.65, 0.7, None, None, None),
            (2, "ridge", "regression", "p", -2.0, 1.0, 0.3, None, None, None, 2.0, 1.0, 0.9),
            (2, "linreg", "regression", "p", -2.0, 1.0, 0.3, None, None, None, 2.0, 1.0, 0.8),
        ],
        RUNS,
    )
    assert [r["model"] for r in runs.leaderboard(log).collect()] == ["xgb", "rf", "linreg", "ridge"]
    assert {r["run_id"]: r["model"] for r in runs.best_run(log).collect()} == {1: "xgb", 2: "linreg"}
    stats = {(r["run_id"], r["metric"]): r for r in runs.metric_summary(log).collect()}
    assert stats[1, "acc"]["std"] == pytest.approx(0.1) and stats[1, "acc"]["best"] == 0.8 and (1, "rmse") not in stats
    assert {(r["run_id"], r["issue"]) for r in runs.flag_issues(runs.metric_summary(log)).collect()} == {(1, "low_f1"), (1, "low_auc"), (2, "identical_rmse")}
    times = {r["run_id"]: r for r in runs.time_stats(log).collect()}
    assert (times[1]["fastest_model"], times[1]["slowest_model"], times[2]["fastest_model"]) == ("xgb", "rf", "linreg")
    asked = spark.createDataFrame(
        [
            ("q1", 1, "classification", "t", ["Random_Forest"]), ("q2", 1, "regression", None, []), ("q3", 1, "prediction", "u", ["svm"]),
            ("q4", 1, "exploration", None, None), ("q5", 9, "prediction", None, []),
        ],
        "question string, run_id int, type string, target_column string, required_methods array<string>",
    )
    found = {r["question"]: r for r in questions.question_coverage(asked, log).collect()}
    assert {q: r["status"] for q, r in found.items()} == {
        "q1": "covered", "q2": "not_covered", "q3": "not_covered", "q4": "partially_covered", "q5": "not_covered"
    }
    assert found["q1"]["methods_present"] == ["Random_Forest"] and found["q2"]["next_steps"] == ["train_for_type", "add_metrics"]
    assert found["q3"]["next_steps"] == ["switch_target", "add_methods"] and found["q5"]["reasons"] == ["no_run"]
    answers = {r["question"]: r["status"] for r in questions.answer_questions(asked, log).collect()}
    assert answers == {"q1": "answered", "q2": "not_answered", "q3": "not_answered", "q4": "action_plan", "q5": "not_answered"}


def test_files(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "x, y"), (2, None)], "a int, b string")
    first = io.write_merged(df, str(tmp_path), "merged.csv")
    second = io.write_merged(df, str(tmp_path), "merged.csv")
    assert (first[-10:], second[-12:]) == ("merged.csv", "merged_2.csv")
    assert rows(io.read_table(spark, first)) == rows(df)
    assert rows(io.read_table(spark, first, schema="a long, b string", max_rows=5)) == rows(df)
    df.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    ordered = io.read_table(spark, str(tmp_path / "t.parquet"), row_order=True)
    assert [r["a"] for r in ordered.orderBy(io.ROW_ORDER).collect()] == [1, 2]
    found, failed = io.read_many(spark, [first, str(tmp_path / "absent.csv")])
    assert list(found) == ["merged.csv"] and list(failed) == [str(tmp_path / "absent.csv")]


def test_fitted_steps_on_a_stream(spark, tmp_path, rows):
    df = spark.createDataFrame([(float(i), f"2024-01-{i + 1:02d}") for i in range(20)], "x double, d string")
    df.write.parquet(str(tmp_path / "in"))
    bounds = cleaning.fit_iqr_clip(df, ["x"], whisker=0.1)
    steps = [lambda s: cleaning.clip_columns(s, bounds), lambda s: cleaning.expand_datetime(s, ["d"])]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_cleaned(stream, steps, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    want = steps[1](steps[0](df))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(want)


def test_top_values_limit_groups_before_the_shuffle(spark):
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    counts = spark.createDataFrame([("a", "x", 1)], "name string, value string, n long")
    plan = counts.select("*", F.row_number().over(w).alias("rank")).where("rank <= 3")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_registry_is_consistent():
    known = all_queries()
    assert set(all_oracles()) <= set(known) and len(known) > 90

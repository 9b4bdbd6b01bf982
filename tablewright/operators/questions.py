"""Research questions against run logs: coverage, answers, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.joins import lookup_join, materialize
from tablewright.operators.runs import SCORE

# The aliases of metrics and methods, and the lists by question type.
METRIC_COLUMNS = {"accuracy": "acc", "f1_macro": "f1_macro", "roc_auc": "roc_auc", "rmse": "rmse", "mae": "mae", "r2": "r2"}
METHOD_ALIASES = {
    "random_forest": ["random_forest", "rf"],
    "xgboost": ["xgboost", "xgb"],
    "logistic_regression": ["logistic_regression", "logistic", "logreg"],
    "linear_regression": ["linear_regression", "linear", "linreg"],
    "ridge": ["ridge"],
    "knn": ["knn", "k-nearest", "k nearest"],
    "mlp": ["mlp", "neural network", "multilayer perceptron"],
}
CLASS_METRICS = ["accuracy", "f1_macro", "roc_auc"]
NUMBER_METRICS = ["rmse", "mae", "r2"]
ANALYSIS_MEASURES = ["distribution plots", "correlation heatmap", "feature importance"]
OTHER_MEASURES = ["custom domain metrics"]
DIFFICULTY = {"easy": 1, "medium": 2, "hard": 3}
TOP_QUESTIONS = 6


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def family_of(method: Column) -> Column:
    """Method family of a free-text method name, or NULL."""
    m = F.lower(method)
    out = F.lit(None).cast("string")
    for family, aliases in METHOD_ALIASES.items():
        out = F.when(m.isin(*aliases), family).otherwise(out)
    return out


def run_context(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: task, target, measured metrics, method families, best model.

    Families come from a fixed list, so the collected sets stay short however
    many models a run has.
    """
    measured = [
        F.when(F.max(F.col(col).isNotNull().cast("int")) == 1, F.lit(name))
        for name, col in METRIC_COLUMNS.items()
        if col in runs.columns
    ]
    best = F.min(F.struct(F.col(SCORE).isNull(), -F.col(SCORE), F.col("model").alias("model"), F.col(SCORE).alias("score")))
    context = runs.groupBy(run).agg(
        F.max("task").alias("task"),
        F.max("target").alias("run_target"),
        F.array_compact(F.array(*measured)).alias("measured"),
        F.collect_set(family_of(F.col("model"))).alias("families"),
        best.alias("b"),
    )
    return context.select(
        run, "task", "run_target", "measured", "families", F.col("b.model").alias("best_model"), F.col("b.score").alias("best_score")
    )


def _with_context(questions: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Questions with the context of their run; runs without a question are left out first."""
    asked = materialize(questions.select(run).distinct())
    context = run_context(lookup_join(runs, asked, [run], "left_semi"), run)
    return lookup_join(questions, materialize(context), [run], "left")


def question_coverage(questions: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Is each question covered, partially covered or not covered by its run?

    A question without a run is not covered.
    """
    q = _with_context(questions, runs, run)
    has_run = F.col("best_model").isNotNull()
    raw = F.lower(F.coalesce("type", F.lit("")))
    kind = F.when(raw.isin("classification", "regression"), raw).when(raw == "prediction", F.coalesce("task", F.lit("analysis")))
    q = q.withColumn("expected_type", kind.otherwise("analysis"))
    expected = (
        F.when(F.col("expected_type") == "classification", _texts(CLASS_METRICS))
        .when(F.col("expected_type") == "regression", _texts(NUMBER_METRICS))
        .otherwise(F.array().cast("array<string>"))
    )
    modelled = F.col("expected_type").isin("classification", "regression")
    no_text = F.array().cast("array<string>")
    q = q.withColumns(
        {
            "task_match": has_run & ((F.col("expected_type") == F.col("task")) | (F.col("expected_type") == "analysis")),
            "target_match": _target_match(),
            "metrics_present": F.coalesce(F.array_intersect(expected, "measured"), no_text),
            "methods_present": F.filter(
                F.coalesce("required_methods", no_text),
                lambda m: F.coalesce(F.array_contains(F.col("families"), family_of(m)), F.lit(False)),
            ),
        }
    )
    matched = F.col("task_match") & F.col("target_match")
    has_metrics = F.size("metrics_present") > 0
    status = F.when(matched & has_metrics, "covered").when(matched, "partially_covered").otherwise("not_covered")
    reasons = F.array_compact(
        F.array(
            F.when(~has_run, "no_run").when(~F.col("task_match"), "task_mismatch"),
            F.when(~F.col("target_match"), "target_mismatch"),
            F.when(matched & ~has_metrics, "metrics_missing"),
        )
    )
    open_question = status != "covered"
    steps = F.array_compact(
        F.array(
            F.when(open_question & modelled & ~F.col("task_match"), "train_for_type"),
            F.when(open_question & ~F.col("target_match"), "switch_target"),
            F.when(open_question & modelled & ~has_metrics, "add_metrics"),
            F.when(open_question & (F.size("required_methods") > 0) & (F.size("methods_present") == 0), "add_methods"),
        )
    )
    return q.select(
        *questions.columns,
        "expected_type",
        status.alias("status"),
        reasons.alias("reasons"),
        "metrics_present",
        "methods_present",
        steps.alias("next_steps"),
        "best_model",
        "best_score",
    )


def _target_match() -> Column:
    stated = (F.coalesce("target_column", F.lit("")) != "") & (F.coalesce("run_target", F.lit("")) != "")
    return ~stated | (F.col("target_column") == F.col("run_target"))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("status").agg(F.count(F.lit(1)).alias("questions"))


def answer_questions(
    questions: DataFrame, runs: DataFrame, run: str = "run_id", strict: bool = False
) -> DataFrame:
    """Answered, not answered, or an action plan for exploratory questions.

    A prediction question takes the task of its run; with ``strict`` it counts
    as a regression question.
    """
    q = _with_context(questions, runs, run)
    kind = F.lower(F.coalesce("type", F.lit("")))
    wanted = F.when(kind == "classification", "classification")
    wanted = wanted.otherwise("regression") if strict else wanted.when(kind == "regression", "regression").otherwise(F.col("task"))
    task_match = F.coalesce(wanted == F.col("task"), F.lit(False))
    modelled = kind.isin("classification", "regression", "prediction")
    answered = task_match & _target_match() & F.col("best_model").isNotNull()
    status = F.when(~modelled, "action_plan").when(answered, "answered").otherwise("not_answered")
    unanswered = modelled & ~answered
    reasons = F.array_compact(
        F.array(
            F.when(unanswered & ~task_match, "task_mismatch"),
            F.when(unanswered & ~_target_match(), "target_mismatch"),
        )
    )
    model = F.when(modelled & answered, F.col("best_model"))
    score = F.when(modelled & answered, F.col("best_score"))
    return q.select(
        *questions.columns, status.alias("status"), reasons.alias("reasons"), model.alias("best_model"), score.alias("best_score")
    )


def difficulty_score(difficulty: Column) -> Column:
    d, out = F.lower(F.coalesce(difficulty, F.lit(""))), F.lit(2)
    for name, score in DIFFICULTY.items():
        out = F.when(d == name, score).otherwise(out)
    return out


def prioritize_questions(questions: DataFrame, k: int = TOP_QUESTIONS, tie: str = "question") -> DataFrame:
    """The ``k`` questions with the longest stated value, easier ones first."""
    value = F.length(F.coalesce("business_value", F.lit("")))
    scored = questions.select("*", value.alias("value_length"), difficulty_score(F.col("difficulty")).alias("difficulty_score"))
    return scored.orderBy(F.desc("value_length"), "difficulty_score", tie).limit(k)


def recommended_metrics(questions: DataFrame) -> DataFrame:
    """Measures by question type, and notes on feasibility."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    metrics = (
        F.when(kind.isin("prediction", "classification"), _texts(CLASS_METRICS))
        .when(kind == "regression", _texts(NUMBER_METRICS))
        .when(kind.isin("analysis", "exploration"), _texts(ANALYSIS_MEASURES))
        .otherwise(_texts(OTHER_MEASURES))
    )
    level = F.lower(F.coalesce("difficulty", F.lit("")))
    notes = F.array_compact(
        F.array(
            F.when(F.coalesce("target_column", F.lit("")) != "", "depends_on_target").otherwise("no_target_needed"),
            F.when(level == "hard", "prototype_first").when(level == "easy", "quick_start"),
        )
    )
    return questions.select("*", metrics.alias("metrics"), notes.alias("feasibility"))

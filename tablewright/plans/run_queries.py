"""Registered queries: metrics, run logs and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import metrics, questions, runs
from tablewright.plans.tables import QUESTIONS_SQL, RUN_LOG_SQL, question_list, run_log, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df, digits=6):
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


# ------------------------------------------------------------------ metrics

_GUESS = "CASE WHEN l_quantity < 15 THEN 'A' WHEN l_discount < 0.06 THEN 'N' WHEN l_tax < 0.07 THEN 'R' ELSE 'X' END"
CLASSES_SQL = f"(SELECT l_returnflag AS y, {_GUESS} AS p FROM lineitem)"


def _classes(spark, sf):
    guess = (
        F.when(F.col("l_quantity") < 15, "A")
        .when(F.col("l_discount") < 0.06, "N")
        .when(F.col("l_tax") < 0.07, "R")
        .otherwise("X")
    )
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), guess.alias("p"))


_SCORES_SQL = f"""WITH x AS {CLASSES_SQL}, l AS (SELECT y AS label FROM x UNION SELECT p FROM x),
  s AS (SELECT label, (SELECT count(*) FROM x WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM x WHERE y <> label AND p = label) AS fp,
    (SELECT count(*) FROM x WHERE y = label AND p <> label) AS fn FROM l)"""


@query("metric_accuracy", f"SELECT round(avg(CASE WHEN y = p THEN 1 ELSE 0 END), 6) AS accuracy FROM {CLASSES_SQL}")
def metric_accuracy(spark, sf):
    return rounded(metrics.accuracy(_classes(spark, sf)))


@query("metric_f1_macro", f"{_SCORES_SQL} SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS f1_macro FROM s")
def metric_f1_macro(spark, sf):
    return rounded(metrics.macro_scores(_classes(spark, sf)).select("f1_macro"))


@query(
    "metric_pr_macro",
    f"""{_SCORES_SQL} SELECT round(avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END), 6) AS precision_macro,
    round(avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END), 6) AS recall_macro FROM s""",
)
def metric_pr_macro(spark, sf):
    return rounded(metrics.macro_scores(_classes(spark, sf)).select("precision_macro", "recall_macro"))


@query(
    "metric_roc_auc",
    """WITH x AS (SELECT quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id))
    SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS roc_auc
    FROM x a, x b WHERE a.y = 1 AND b.y = 0""",
)
def metric_roc_auc(spark, sf):
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return rounded(metrics.roc_auc(labels.select(F.col("quality").alias("y"), F.col("n_chars").alias("score"))))


@query(
    "metric_roc_auc_lineitem",
    """WITH x AS (SELECT l_linestatus = 'O' AS y, round(l_extendedprice + l_quantity * 100, 0) AS score FROM lineitem),
    r AS (SELECT y, avg(rank) AS r, count(*) AS n FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rank FROM x) GROUP BY y)
    SELECT round((a.r * a.n - a.n * (a.n + 1) / 2) / (a.n * b.n), 6) AS roc_auc FROM r a, r b WHERE a.y AND NOT b.y""",
)
def metric_roc_auc_lineitem(spark, sf):
    score = F.round(F.col("l_extendedprice") + F.col("l_quantity") * 100, 0)
    df = table(spark, sf, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("y"), score.alias("score"))
    return rounded(metrics.roc_auc(df))


@query(
    "metric_regression",
    """WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500 + 2000 AS p FROM lineitem)
    SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
    round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2 FROM x""",
)
def metric_regression(spark, sf):
    guess = F.col("l_quantity") * 1500 + 2000
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), guess.alias("p"))
    return rounded(metrics.regression_scores(df), 4)


# ------------------------------------------------------------------ run logs


@query(
    "leaderboard",
    f"""SELECT * REPLACE (round(cv_score, 6) AS cv_score, round(fit_s, 3) AS fit_s, round(predict_s, 6) AS predict_s, round(acc, 6) AS acc, round(f1_macro, 6) AS f1_macro,
    round(roc_auc, 6) AS roc_auc, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2) FROM {RUN_LOG_SQL}""",
)
def leaderboard(spark, sf):
    return runs.leaderboard(run_log(spark, sf)).withColumn("cv_score", F.round("cv_score", 6))


@query(
    "best_run",
    f"""SELECT run_id, model, task, target, round(cv_score, 6) AS cv_score, round(fit_s, 6) AS fit_s FROM (SELECT *, row_number() OVER (
    PARTITION BY run_id ORDER BY cv_score DESC, model, task, target, fit_s) AS rn FROM {RUN_LOG_SQL}) WHERE rn = 1""",
)
def best_run(spark, sf):
    return rounded(runs.best_run(run_log(spark, sf)).select("run_id", "model", "task", "target", "cv_score", "fit_s"))


_METRICS = ["acc", "f1_macro", "roc_auc", "rmse", "mae", "r2", "cv_score"]
SUMMARY_SQL = "(" + " UNION ALL ".join(
    f"""SELECT run_id, '{m}' AS metric, min({m}) AS min, max({m}) AS max, avg({m}) AS mean, stddev_pop({m}) AS std,
    list({m} ORDER BY cv_score DESC, model, {m} NULLS FIRST)[1] AS best FROM {RUN_LOG_SQL} GROUP BY run_id HAVING count({m}) > 0"""
    for m in _METRICS
) + ")"


@query(
    "metric_summary",
    f"""SELECT run_id, metric, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std,
    round(best, 6) AS best FROM {SUMMARY_SQL}""",
)
def metric_summary(spark, sf):
    return rounded(runs.metric_summary(run_log(spark, sf)))


@query(
    "time_stats",
    f"""SELECT run_id, round(avg(fit_s), 5) AS fit_avg, round(avg(predict_s), 5) AS predict_avg,
    list(model ORDER BY predict_s, model)[1] AS fastest_model, list(model ORDER BY predict_s DESC, model)[1] AS slowest_model
    FROM {RUN_LOG_SQL} GROUP BY run_id""",
)
def time_stats(spark, sf):
    return rounded(runs.time_stats(run_log(spark, sf)), 5)


@query(
    "flag_issues",
    f"""WITH w AS (SELECT run_id, max(best) FILTER (metric = 'f1_macro') AS f1, max(best) FILTER (metric = 'roc_auc') AS auc,
      max(std) FILTER (metric = 'rmse') AS sd, max(best) FILTER (metric = 'r2') AS r2 FROM {SUMMARY_SQL} GROUP BY run_id),
    f AS (SELECT run_id, 'low_f1' AS issue, 'tune_or_stronger_models' AS advice FROM w WHERE f1 < 0.7
      UNION ALL SELECT run_id, 'low_auc', 'feature_engineering' FROM w WHERE auc < 0.75
      UNION ALL SELECT run_id, 'identical_rmse', 'check_leakage' FROM w WHERE sd < 1e-9
      UNION ALL SELECT run_id, 'low_r2', 'more_features_or_nonlinear' FROM w WHERE r2 < 0.3)
    SELECT * FROM f UNION ALL SELECT run_id, 'none', 'explain_model' FROM w WHERE run_id NOT IN (SELECT run_id FROM f)""",
)
def flag_issues(spark, sf):
    return runs.flag_issues(runs.metric_summary(run_log(spark, sf)))


# ----------------------------------------------------------------- questions

_CONTEXT = f"""c AS (SELECT run_id, max(task) AS task, max(target) AS run_target,
  list_filter([CASE WHEN count(acc) > 0 THEN 'accuracy' END, CASE WHEN count(f1_macro) > 0 THEN 'f1_macro' END,
    CASE WHEN count(roc_auc) > 0 THEN 'roc_auc' END, CASE WHEN count(rmse) > 0 THEN 'rmse' END, CASE WHEN count(mae) > 0 THEN 'mae' END,
    CASE WHEN count(r2) > 0 THEN 'r2' END], lambda x: x IS NOT NULL) AS measured,
  list(DISTINCT model) AS models, list(model ORDER BY cv_score DESC, model)[1] AS best_model, round(max(cv_score), 6) AS best_score
  FROM {RUN_LOG_SQL} GROUP BY run_id)"""
_MATCH = "(target_column IS NULL OR coalesce(run_target, '') = '' OR target_column = run_target)"
COVERAGE_SQL = f"""WITH {_CONTEXT}, q AS (SELECT *, CASE lower(type) WHEN 'classification' THEN 'classification' WHEN 'regression' THEN 'regression'
    WHEN 'prediction' THEN coalesce(task, 'analysis') ELSE 'analysis' END AS expected_type FROM {QUESTIONS_SQL} LEFT JOIN c USING (run_id)),
  m AS (SELECT *, best_model IS NOT NULL AND (expected_type = task OR expected_type = 'analysis') AS task_match, {_MATCH} AS target_match,
    CASE expected_type WHEN 'classification' THEN list_filter(['accuracy','f1_macro','roc_auc'], lambda x: list_contains(measured, x))
      WHEN 'regression' THEN list_filter(['rmse','mae','r2'], lambda x: list_contains(measured, x)) ELSE [] END AS metrics_present,
    list_filter(required_methods, lambda x: (lower(x) = 'random_forest' AND list_contains(models, 'rf')) OR (lower(x) = 'xgb' AND list_contains(models, 'xgb'))
      OR (lower(x) = 'logistic' AND list_contains(models, 'logreg')) OR (lower(x) = 'neural network' AND list_contains(models, 'mlp'))) AS methods_present
    FROM q),
  s AS (SELECT *, CASE WHEN task_match AND target_match AND len(metrics_present) > 0 THEN 'covered' WHEN task_match AND target_match THEN 'partially_covered'
    ELSE 'not_covered' END AS status FROM m)
  SELECT question_id, expected_type, status,
  concat_ws(',', CASE WHEN best_model IS NULL THEN 'no_run' WHEN NOT task_match THEN 'task_mismatch' END, CASE WHEN NOT target_match THEN 'target_mismatch' END,
    CASE WHEN status = 'partially_covered' THEN 'metrics_missing' END) AS reasons,
  coalesce(array_to_string(metrics_present, ','), '') AS metrics_present, coalesce(array_to_string(methods_present, ','), '') AS methods_present,
  concat_ws(',', CASE WHEN status <> 'covered' AND expected_type IN ('classification', 'regression') AND NOT task_match THEN 'train_for_type' END,
    CASE WHEN status <> 'covered' AND NOT target_match THEN 'switch_target' END,
    CASE WHEN status <> 'covered' AND expected_type IN ('classification', 'regression') AND len(metrics_present) = 0 THEN 'add_metrics' END,
    CASE WHEN status <> 'covered' AND len(required_methods) > 0 AND len(methods_present) = 0 THEN 'add_methods' END) AS next_steps,
  best_model, best_score FROM s"""
_COVERAGE = ["question_id", "expected_type", "status", "reasons", "metrics_present", "methods_present", "next_steps", "best_model", "best_score"]


def _flat(df, columns, lists):
    flat = df.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in lists}).select(*columns)
    return rounded(flat)


@query("question_coverage", COVERAGE_SQL)
def question_coverage(spark, sf):
    found = questions.question_coverage(question_list(spark, sf), run_log(spark, sf))
    return _flat(found, _COVERAGE, ["reasons", "metrics_present", "methods_present", "next_steps"])


@query("coverage_totals", f"SELECT status, count(*) AS questions FROM ({COVERAGE_SQL}) GROUP BY status")
def coverage_totals(spark, sf):
    return questions.coverage_totals(questions.question_coverage(question_list(spark, sf), run_log(spark, sf)))


def _answer_sql(strict):
    wanted = "'regression'" if strict else "task"
    return f"""WITH {_CONTEXT}, q AS (SELECT *, lower(type) IN ('classification', 'regression', 'prediction') AS modelled, {_MATCH} AS target_match,
      coalesce(task = CASE lower(type) WHEN 'classification' THEN 'classification' WHEN 'regression' THEN 'regression' ELSE {wanted} END, false) AS task_match
      FROM {QUESTIONS_SQL} LEFT JOIN c USING (run_id)),
    a AS (SELECT *, modelled AND task_match AND target_match AND best_model IS NOT NULL AS answered FROM q)
    SELECT question_id, CASE WHEN NOT modelled THEN 'action_plan' WHEN answered THEN 'answered' ELSE 'not_answered' END AS status,
    concat_ws(',', CASE WHEN modelled AND NOT answered AND NOT task_match THEN 'task_mismatch' END,
      CASE WHEN modelled AND NOT answered AND NOT target_match THEN 'target_mismatch' END) AS reasons,
    CASE WHEN answered THEN best_model END AS best_model, CASE WHEN answered THEN best_score END AS best_score FROM a"""


def _answers(name, strict):
    columns = ["question_id", "status", "reasons", "best_model", "best_score"]

    def run(spark, sf):
        found = questions.answer_questions(question_list(spark, sf), run_log(spark, sf), strict=strict)
        return _flat(found, columns, ["reasons"])

    query(name, _answer_sql(strict))(run)


_answers("answer_status", False)
_answers("answer_status_strict", True)


@query(
    "prioritize_questions",
    f"""SELECT question, length(business_value) AS value_length,
    CASE lower(difficulty) WHEN 'easy' THEN 1 WHEN 'hard' THEN 3 ELSE 2 END AS difficulty_score
    FROM {QUESTIONS_SQL} ORDER BY value_length DESC, difficulty_score, question LIMIT 6""",
)
def prioritize_questions(spark, sf):
    top = questions.prioritize_questions(question_list(spark, sf))
    return top.select("question", "value_length", "difficulty_score")


@query(
    "recommended_metrics",
    f"""SELECT question_id, CASE lower(type) WHEN 'prediction' THEN 'accuracy,f1_macro,roc_auc' WHEN 'classification' THEN 'accuracy,f1_macro,roc_auc'
    WHEN 'regression' THEN 'rmse,mae,r2' WHEN 'exploration' THEN 'distribution plots,correlation heatmap,feature importance'
    ELSE 'custom domain metrics' END AS metrics,
    concat_ws(',', CASE WHEN target_column IS NULL THEN 'no_target_needed' ELSE 'depends_on_target' END,
      CASE lower(difficulty) WHEN 'hard' THEN 'prototype_first' WHEN 'easy' THEN 'quick_start' END) AS feasibility FROM {QUESTIONS_SQL}""",
)
def recommended_metrics(spark, sf):
    found = questions.recommended_metrics(question_list(spark, sf))
    return _flat(found, ["question_id", "metrics", "feasibility"], ["metrics", "feasibility"])

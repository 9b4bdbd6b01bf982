"""Summaries of a run log: one row per trained model of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.joins import by_heat

# The metrics on a leaderboard and the alarm levels.
CLASS_METRICS = ["acc", "f1_macro", "roc_auc"]
NUMBER_METRICS = ["rmse", "mae", "r2"]
SCORE = "cv_score"
LOW_F1, LOW_AUC, LOW_R2, FLAT_RMSE = 0.7, 0.75, 0.3, 1e-9


def _best_first() -> Column:
    """Sort key with the best model of a run first; a missing score comes last."""
    return F.struct(F.col(SCORE).isNull().alias("none"), (-F.col(SCORE)).alias("score"), F.col("model").alias("model"))


def leaderboard(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """All models, best score first within a run, metrics rounded.

    The sort is by (run, score), so a run with very many models spreads over
    several ranges.
    """
    digits = {"fit_s": 3, "predict_s": 6, **{m: 6 for m in CLASS_METRICS + NUMBER_METRICS}}
    rounded = {c: F.round(c, d) for c, d in digits.items() if c in runs.columns}
    return runs.withColumns(rounded).orderBy(run, F.desc_nulls_last(SCORE), "model")


def best_run(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """The best model of every run, ties to the first name."""
    rest = [c for c in runs.columns if c not in (run, "model", SCORE)]
    packed = F.struct(_best_first().alias("key"), F.struct(*[F.col(c) for c in rest], F.col(SCORE)).alias("row"))
    best = runs.groupBy(run).agg(F.min(packed).alias("b"))
    return best.select(run, F.col("b.key.model").alias("model"), f"b.row.{SCORE}", *[F.col(f"b.row.{c}") for c in rest])


def metric_summary(runs: DataFrame, metrics: Sequence[str] | None = None, run: str = "run_id") -> DataFrame:
    """Minimum, maximum, mean, population deviation and best model's value per metric.

    Most runs have few models, so their rows go to their task as they are: what a task would
    know of a run before is wider than its rows. Only runs with a large share of all rows are
    aggregated before.
    """
    metrics = [m for m in (metrics or CLASS_METRICS + NUMBER_METRICS) if m in runs.columns] + [SCORE]
    metrics = list(dict.fromkeys(metrics))
    aggs = []
    for m in metrics:
        v = F.col(m).cast("double")
        aggs += [
            F.min(v).alias(f"{m}__min"),
            F.max(v).alias(f"{m}__max"),
            F.avg(v).alias(f"{m}__mean"),
            F.stddev_pop(v).alias(f"{m}__std"),
        ]
    # All metrics of a run in one row, so that each log row is aggregated once.
    best = F.min(F.struct(_best_first().alias("key"), *[F.col(m).cast("double").alias(m) for m in metrics]))
    hot, rest = by_heat(runs.select(*dict.fromkeys([run, "model", SCORE, *metrics])), [run])
    wide = rest.repartition(run).groupBy(run).agg(*aggs, best.alias("b"))
    if hot is not None:
        wide = wide.unionByName(hot.groupBy(run).agg(*aggs, best.alias("b")))
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                *[F.col(f"{m}__{part}").alias(part) for part in ("min", "max", "mean", "std")],
                F.col(f"b.{m}").alias("best"),
            )
            for m in metrics
        ]
    )
    return wide.select(run, F.inline(cells)).where(F.col("min").isNotNull())


def time_stats(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Mean fit and predict time, fastest and slowest predictor, ties to the first name."""
    fastest = F.min(F.when(F.col("predict_s").isNotNull(), F.struct("predict_s", "model")))
    slowest = F.min(F.when(F.col("predict_s").isNotNull(), F.struct((-F.col("predict_s")).alias("m"), "model")))
    return runs.groupBy(run).agg(
        F.avg("fit_s").alias("fit_avg"),
        F.avg("predict_s").alias("predict_avg"),
        fastest["model"].alias("fastest_model"),
        slowest["model"].alias("slowest_model"),
    )


def flag_issues(summary: DataFrame, run: str = "run_id") -> DataFrame:
    """Alarms of every run with the matching advice."""

    def of(metric: str, col: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(col)))

    wide = summary.groupBy(run).agg(
        of("f1_macro", "best").alias("f1"),
        of("roc_auc", "best").alias("auc"),
        of("rmse", "std").alias("rmse_std"),
        of("r2", "best").alias("r2"),
    )

    def flag(condition: Column, issue: str, advice: str) -> Column:
        return F.when(condition, F.struct(F.lit(issue).alias("issue"), F.lit(advice).alias("advice")))

    flags = F.array_compact(
        F.array(
            flag(F.col("f1") < LOW_F1, "low_f1", "tune_or_stronger_models"),
            flag(F.col("auc") < LOW_AUC, "low_auc", "feature_engineering"),
            flag(F.col("rmse_std") < FLAT_RMSE, "identical_rmse", "check_leakage"),
            flag(F.col("r2") < LOW_R2, "low_r2", "more_features_or_nonlinear"),
        )
    )
    none = F.array(F.struct(F.lit("none").alias("issue"), F.lit("explain_model").alias("advice")))
    return wide.select(run, F.inline(F.when(F.size(flags) > 0, flags).otherwise(none)))

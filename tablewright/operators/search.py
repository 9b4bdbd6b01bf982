"""Random search over model families with per-fold preprocessing."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.missing import quoted
from tablewright.operators.features import FEATURES, LABEL
from tablewright.operators.metrics import classification_scores, regression_scores, roc_auc
from tablewright.operators.models import Family, TrainShape, model_registry, positive_score, sample_params
from tablewright.operators.sampling import FOLD, assign_folds
from tablewright.sources.model_store import save_model
from tablewright.session import local_frame

ROW_ID = "row_id"
#: Rows that a learner reads in one task.
PART_ROWS = 250_000
RUN_COLUMNS = (
    "model string, cv_score double, fit_s double, predict_s double, params string, "
    "acc double, f1_macro double, precision_macro double, recall_macro double, roc_auc double, "
    "rmse double, mae double, r2 double, model_path string"
)


# The names of scorings, the first of each the default; the measure behind it, and its sign.
CLASS_SCORES = {
    "f1_macro": ("f1_macro", 1),
    "accuracy": ("acc", 1),
    "precision_macro": ("precision_macro", 1),
    "recall_macro": ("recall_macro", 1),
    "roc_auc": ("roc_auc", 1),
}
REGRESSION_SCORES = {
    "neg_root_mean_squared_error": ("rmse", -1),
    "neg_mean_absolute_error": ("mae", -1),
    "r2": ("r2", 1),
}


@dataclass
class Trained:
    """The refitted best candidate of one family."""

    name: str
    params: dict[str, Any]
    cv_score: float
    preprocessor: Any
    model: Any
    fit_s: float = 0.0
    predict_s: float = 0.0
    metrics: dict[str, float] = field(default_factory=dict)
    path: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.preprocessor.transform(df))

    def pipeline(self) -> PipelineModel:
        return PipelineModel([self.preprocessor, self.model])


def fold_score(predictions: DataFrame, task: str, scoring: str | None = None) -> float:
    """Score of one fold, larger is better: macro F1 or negative RMSE by default.

    Raises for a name that is not in CLASS_SCORES or REGRESSION_SCORES of the task.
    """
    known = CLASS_SCORES if task == "classification" else REGRESSION_SCORES
    name = scoring or next(iter(known))
    if name not in known:
        raise ValueError(f"scoring {name!r} for {task}: one of {sorted(known)}")
    if name == "roc_auc":
        score = positive_score(predictions)
        if score is None:
            raise ValueError("roc_auc needs a model that gives the probability of two classes")
        return roc_auc(predictions.select(quoted(LABEL), score.alias("score")), LABEL, "score").first()[0]
    measure = classification_scores if task == "classification" else regression_scores
    column, sign = known[name]
    return sign * measure(predictions, LABEL, "prediction").first()[column]


def _shape(features: DataFrame, rows: int, classes: int) -> TrainShape:
    first = features.select(FEATURES).first()
    return TrainShape(rows, len(first[0]) if first else 0, classes)



@dataclass
class Candidate:
    """One draw of one family, with its summed fold scores and fit time."""

    family: Family
    params: dict[str, Any]
    score: float = 0.0
    seconds: float = 0.0


def cross_validate(
    train: DataFrame,
    preprocessor: Estimator,
    candidates: Sequence[Candidate],
    task: str,
    folds: int,
    scoring: str | None = None,
    parallelism: int = 4,
) -> None:
    """Add the mean fold score to every candidate.

    The preprocessor is fitted on the training part of each fold, once for the
    candidates of all families; the resulting vectors are kept for that fold
    only. ``parallelism`` candidates run at a time while the rows are few.
    """
    classes = _classes(train) if task == "classification" else 0
    for fold in range(folds):
        part, rest = train.where(F.col(FOLD) != fold), train.where(F.col(FOLD) == fold)
        fitted = preprocessor.fit(part)
        fit_rows, n = kept(fitted.transform(part).select(*_kept_after(part)))
        check_rows, _ = kept(fitted.transform(rest).select(*_kept_after(rest)))
        try:
            shape = _shape(fit_rows, n, classes)

            def run(c: Candidate) -> None:
                started = time.time()
                model = c.family.build(c.params, shape).fit(fit_rows)
                c.score += fold_score(model.transform(check_rows), task, scoring) / folds
                c.seconds += time.time() - started

            with ThreadPoolExecutor(max_workers=_at_once(fit_rows, parallelism)) as pool:
                list(pool.map(run, candidates))
        finally:
            fit_rows.unpersist()
            check_rows.unpersist()


def _at_once(rows: DataFrame, parallelism: int) -> int:
    """How many learners run at a time: one where its tasks keep all cores busy, since each keeps a copy of the rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return 1 if rows.rdd.getNumPartitions() >= 2 * cores else max(1, parallelism)


def kept(df: DataFrame, source: bool = False) -> tuple[DataFrame, int]:
    """Cached rows and their number, in partitions of ``PART_ROWS`` at most and over all cores.

    The learners read these rows many times, a partition in one task. A split of a file
    holds more rows the larger the file is, so their number alone decides. Rows straight
    from a file (``source``) are counted there and dealt out before they are cached, not after.
    """
    if source:
        rows = df.count()
        held = dealt(df, rows).persist()
        held.count()
        return held, rows
    held = df.persist()
    rows = held.count()
    spread = dealt(held, rows)
    if spread is held:
        return held, rows
    spread = spread.persist()
    spread.count()
    held.unpersist()
    return spread, rows


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows, so many in number, in partitions of ``PART_ROWS`` at most and over all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, math.ceil(rows / PART_ROWS))
    return df if rows < cores or df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def _kept_after(df: DataFrame) -> list[str]:
    return [FEATURES, *[c for c in (ROW_ID, LABEL) if c in df.columns]]


def _classes(train: DataFrame) -> int:
    return int((train.agg(F.max(LABEL)).first()[0] or 0)) + 1


def run_all(
    train: DataFrame,
    test: DataFrame,
    task: str,
    names: Sequence[str],
    preprocessor: Estimator,
    key: Sequence[str],
    n_iter: int = 30,
    folds: int = 5,
    scoring: str | None = None,
    artifacts_dir: str | None = None,
    parallelism: int = 4,
    overrides: dict[str, Any] | None = None,
) -> tuple[DataFrame, dict[str, Trained]]:
    """Search, refit, test and rank the families; returns runs and trained models.

    ``train`` and ``test`` carry ``label``; ``key`` identifies a row for the fold
    assignment. ``overrides`` replaces drawn parameters, for example to bound the
    number of trees in a trial run.
    """
    spark = train.sparkSession
    candidates = [
        Candidate(family, {**params, **(overrides or {})})
        for family in model_registry(task, names).values()
        for params in sample_params(family.space, n_iter)
    ]
    folded, _ = kept(assign_folds(train, folds, LABEL if task == "classification" else None, key=key))
    try:
        cross_validate(folded, preprocessor, candidates, task, folds, scoring, parallelism)
        best: dict[str, Candidate] = {}
        for c in candidates:
            if c.family.name not in best or c.score > best[c.family.name].score:
                best[c.family.name] = c
        trained = _refit(folded.drop(FOLD), preprocessor, list(best.values()), task, folded)
    finally:
        folded.unpersist()
    rows = []
    for name, result in trained.items():
        result.fit_s += sum(c.seconds for c in candidates if c.family.name == name)
        evaluate(result, test, task)
        if artifacts_dir:
            result.path = save_model(result, f"{artifacts_dir}/best_model__{name}")
        rows.append(_run_row(result))
    return local_frame(spark, rows, RUN_COLUMNS), trained


def refit(
    train: DataFrame, preprocessor: Estimator, chosen: Sequence[Candidate], task: str
) -> dict[str, Trained]:
    """Fit the preprocessor once and every chosen candidate on all training rows."""
    held, _ = kept(train)
    try:
        return _refit(held, preprocessor, chosen, task, held)
    finally:
        held.unpersist()


def _refit(
    train: DataFrame, preprocessor: Estimator, chosen: Sequence[Candidate], task: str, held: DataFrame
) -> dict[str, Trained]:
    """``held`` are the cached rows behind ``train``: given up before the learners, which keep copies of their own."""
    fitted = preprocessor.fit(train)
    rows, n = kept(fitted.transform(train).select(*_kept_after(train)))
    held.unpersist()
    out = {}
    try:
        shape = _shape(rows, n, _classes(rows) if task == "classification" else 0)
        for c in chosen:
            started = time.time()
            model = c.family.build(c.params, shape).fit(rows)
            out[c.family.name] = Trained(c.family.name, c.params, c.score, fitted, model, time.time() - started)
    finally:
        rows.unpersist()
    return out


def evaluate(result: Trained, test: DataFrame, task: str) -> None:
    """Measure on the test rows; the prediction time covers every test row."""
    started = time.time()
    predictions = result.transform(test)
    score = positive_score(predictions) if task == "classification" else None
    wanted = [quoted(LABEL), quoted("prediction")] + ([score.alias("score")] if score is not None else [])
    held = predictions.select(*wanted).persist()
    try:
        held.count()
        result.predict_s = time.time() - started
        if task != "classification":
            result.metrics = regression_scores(held, LABEL, "prediction").first().asDict()
            return
        result.metrics = classification_scores(held, LABEL, "prediction").first().asDict()
        if score is not None and _classes(held) <= 2:
            result.metrics["roc_auc"] = roc_auc(held, LABEL, "score").first()[0]
    finally:
        held.unpersist()


def _run_row(t: Trained) -> tuple:
    m = {k: (None if v is None else round(float(v), 6)) for k, v in t.metrics.items()}
    names = ("acc", "f1_macro", "precision_macro", "recall_macro", "roc_auc", "rmse", "mae", "r2")
    return (
        t.name,
        float(t.cv_score),
        round(t.fit_s, 3),
        round(t.predict_s, 6),
        str(dict(sorted(t.params.items()))),
        *[m.get(n) for n in names],
        t.path,
    )

"""Model families, their search spaces, and the random parameter sampler."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.features import FEATURES, LABEL
from tablewright.operators.neighbors import average, nearest, vote
from tablewright.operators.trees import Settings, Trees

MAX_DEPTH = 30  # limit of the tree learners

# The search space of each family. Upper bounds of whole numbers
# are excluded.
LOGREG_SPACE = {"C": ("loguniform", 1e-3, 1e3)}
RIDGE_SPACE = {"alpha": ("loguniform", 1e-3, 1e2)}
FOREST_SPACE = {
    "n_estimators": ("randint", 150, 600),
    "max_depth": ("randint", 3, 20),
    "min_samples_leaf": ("randint", 1, 10),
    "max_features": ("choice", ["sqrt", "log2", None]),
}
BOOSTED_SPACE = {
    "n_estimators": ("randint", 150, 500),
    "max_depth": ("randint", 3, 12),
    "learning_rate": ("loguniform", 1e-2, 3e-1),
    "subsample": ("uniform", 0.6, 0.4),
    "colsample_bytree": ("uniform", 0.6, 0.4),
}
KNN_SPACE = {
    "n_neighbors": ("randint", 3, 51),
    "weights": ("choice", ["uniform", "distance"]),
    "p": ("choice", [1, 2]),
}
LASSO_SPACE = {"alpha": ("loguniform", 1e-4, 1e1)}
SVM_SPACE = {"C": ("loguniform", 1e-3, 1e3)}
MLP_SPACE = {
    "hidden_layer_sizes": ("choice", [(64,), (128,), (64, 32)]),
    "learning_rate_init": ("loguniform", 1e-4, 1e-2),
}


@dataclass(frozen=True)
class TrainShape:
    """What an estimator needs to know about the training rows.

    ``weight`` is a column that says how many rows a row stands for; ``rows`` is their sum then.
    """

    rows: int
    width: int
    classes: int = 0
    weight: str | None = None


@dataclass(frozen=True)
class Family:
    """``build(params, shape)`` gives an unfitted estimator; ``weighted`` ones heed ``shape.weight``."""

    name: str
    space: dict[str, tuple]
    build: Callable[[dict[str, Any], TrainShape], Any]
    weighted: bool = False


def _weight(shape: TrainShape) -> dict[str, str]:
    return {"weightCol": shape.weight} if shape.weight else {}


def _logreg(params, shape):
    # The penalty is stated per row here and per data set in the C convention.
    return LogisticRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        **_weight(shape),
        maxIter=params.get("max_iter", 2000),
        regParam=1.0 / (params.get("C", 1.0) * max(1, shape.rows)),
        elasticNetParam=0.0,
        standardization=False,
    )


def _linreg(params, shape):
    return LinearRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=0.0)


class Ridge:
    """Least squares plus ``alpha`` times the squared coefficients, over all rows together.

    Spark ML takes such a penalty per row and in units of the target's deviation, so that
    deviation is measured first.
    """

    def __init__(self, alpha: float):
        self.alpha = alpha

    def fit(self, train: DataFrame):
        rows, spread = train.agg(F.count(LABEL), F.stddev_pop(LABEL)).first()
        return LinearRegression(
            featuresCol=FEATURES,
            labelCol=LABEL,
            regParam=self.alpha * (spread or 1.0) / max(1, rows),
            elasticNetParam=0.0,
            standardization=False,
        ).fit(train)


def _ridge(params, shape):
    return Ridge(params.get("alpha", 1.0))


def _lasso(params, shape):
    return LinearRegression(
        featuresCol=FEATURES,
        labelCol=LABEL,
        regParam=params.get("alpha", 1.0),
        elasticNetParam=1.0,
        standardization=False,
        maxIter=params.get("max_iter", 1000),
    )


def _svm(params, shape):
    """Linear machine with hinge loss; more than two classes are told one from the rest."""
    one = LinearSVC(
        featuresCol=FEATURES,
        labelCol=LABEL,
        **_weight(shape),
        maxIter=params.get("max_iter", 200),
        regParam=1.0 / (params.get("C", 1.0) * max(1, shape.rows)),
        standardization=False,
    )
    if shape.classes <= 2:
        return one
    return OneVsRest(classifier=one, featuresCol=FEATURES, labelCol=LABEL, **_weight(shape))


def _forest(classify):
    def build(params, shape):
        return Trees(
            Settings(
                trees=params.get("n_estimators", 100),
                depth=_depth(params, 10),
                least=params.get("min_samples_leaf", 1),
                features=params.get("max_features", "sqrt") or "all",
                classes=max(2, shape.classes) if classify else 0,
                weight=shape.weight,
            )
        )

    return build


def _depth(params, default: int) -> int:
    depth = params.get("max_depth", default)
    if depth > MAX_DEPTH:
        raise ValueError(f"max_depth {depth}: Spark ML trees have {MAX_DEPTH} levels at most")
    return depth


def _boosted(classify):
    def build(params, shape):
        # More than two classes are told one from the rest.
        return Trees(
            Settings(
                trees=params.get("n_estimators", 300),
                depth=_depth(params, 6),
                step=params.get("learning_rate", 0.3),
                share=params.get("subsample", 1.0),
                features=str(params.get("colsample_bytree", "all")),
                classes=max(2, shape.classes) if classify else 0,
                weight=shape.weight,
            )
        )

    return build


def _mlp(params, shape):
    # A learning rate acts with gradient descent only.
    return MultilayerPerceptronClassifier(
        solver="gd" if "learning_rate_init" in params else "l-bfgs",
        featuresCol=FEATURES,
        labelCol=LABEL,
        layers=[shape.width, *params.get("hidden_layer_sizes", (64,)), max(2, shape.classes)],
        stepSize=params.get("learning_rate_init", 0.03),
        maxIter=params.get("max_iter", 500),
        seed=42,
    )


class Neighbors:
    """Nearest-neighbour learner: fitting keeps the training rows."""

    def __init__(self, params: dict[str, Any], classify: bool, id_col: str = "row_id"):
        self.k = params.get("n_neighbors", 5)
        self.weights = params.get("weights", "uniform")
        self.p = params.get("p", 2)
        self.classify, self.id_col = classify, id_col

    def fit(self, train: DataFrame) -> NeighborsModel:
        return NeighborsModel(self, _as_array(train))


class NeighborsModel:
    def __init__(self, settings: Neighbors, train: DataFrame):
        self.settings, self.train = settings, train

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.settings
        found = nearest(_as_array(df), self.train, "__vector", s.id_col, LABEL, s.k, s.p)
        predicted = (vote if s.classify else average)(found, s.weights)
        # One prediction per row id, so the join has no hot key.
        return df.join(predicted.withColumnRenamed("query_id", s.id_col), s.id_col, "left")


def _as_array(df: DataFrame) -> DataFrame:
    return df.withColumn("__vector", vector_to_array(FEATURES))


def _knn(classify):
    return lambda params, shape: Neighbors(params, classify)


CLASSIFIERS = {
    "logreg": Family("logreg", LOGREG_SPACE, _logreg, weighted=True),
    "rf": Family("rf", FOREST_SPACE, _forest(True), weighted=True),
    "xgb": Family("xgb", BOOSTED_SPACE, _boosted(True), weighted=True),
    "knn": Family("knn", KNN_SPACE, _knn(True)),
    "mlp": Family("mlp", MLP_SPACE, _mlp),
    "svm": Family("svm", SVM_SPACE, _svm, weighted=True),
}
REGRESSORS = {
    "linreg": Family("linreg", {}, _linreg),
    "ridge": Family("ridge", RIDGE_SPACE, _ridge),
    "lasso": Family("lasso", LASSO_SPACE, _lasso),
    "rf": Family("rf", FOREST_SPACE, _forest(False), weighted=True),
    "xgb": Family("xgb", BOOSTED_SPACE, _boosted(False), weighted=True),
    "knn": Family("knn", KNN_SPACE, _knn(False)),
}
UNSUPPORTED = {"regression": ("mlp",)}
DEFAULT_FAMILIES = ("rf", "xgb")


def model_registry(task: str, names: Sequence[str]) -> dict[str, Family]:
    """The named families; unknown names are passed over, none left means the default pair."""
    base = CLASSIFIERS if task == "classification" else REGRESSORS
    for n in names:
        if n in UNSUPPORTED.get(task, ()):
            raise ValueError(f"{n!r} is not available for {task}")
    picked = {n: base[n] for n in names if n in base}
    return picked or {n: base[n] for n in DEFAULT_FAMILIES}


def sample_params(space: dict[str, tuple], n_iter: int = 30, seed: int = 42) -> list[dict[str, Any]]:
    """Random draws from a search space; a space without parameters gives one empty draw."""
    if not space:
        return [{}]
    rng = random.Random(seed)
    return [{name: _draw(rng, *spec) for name, spec in sorted(space.items())} for _ in range(n_iter)]


def _draw(rng, kind, *args):
    if kind == "loguniform":
        return math.exp(rng.uniform(math.log(args[0]), math.log(args[1])))
    if kind == "randint":
        return rng.randrange(args[0], args[1])
    if kind == "uniform":
        return args[0] + args[1] * rng.random()
    return rng.choice(args[0])


def positive_score(predictions: DataFrame):
    """Probability of class 1 where the learner gives two-class probabilities, else None."""
    return vector_to_array("probability")[1] if "probability" in predictions.columns else None



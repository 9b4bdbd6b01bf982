"""Registered queries: model families, neighbours and search."""

from __future__ import annotations

import math
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators.features import FEATURES, LABEL
from tablewright.operators.models import TrainShape, model_registry
from tablewright.operators.neighbors import average, nearest, vote
from tablewright.operators.sampling import SPLIT
from tablewright.operators.search import PART_ROWS, Candidate, dealt, evaluate, refit, run_all
from tablewright.plans.prepare import ROW_ID, Prepared, prepare
from tablewright.plans.tables import GAPPY_SQL, gappy_lineitem, table
from tablewright.session import local_frame

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _classes(spark, sf):
    """lineitem, with the line status as a two-class target."""
    keep = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber"]
    return prepare(gappy_lineitem(spark, sf).select(*keep, "l_linestatus"), "l_linestatus", "classification")


def _flags(spark, sf):
    """lineitem, with the return flag as a three-class target."""
    keep = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_orderkey", "l_linenumber"]
    return prepare(table(spark, sf, "lineitem").select(*keep, "l_returnflag"), "l_returnflag", "classification")


def _prices(spark, sf):
    """lineitem, with the price as a numeric target."""
    keep = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_orderkey", "l_linenumber"]
    return prepare(gappy_lineitem(spark, sf).select(*keep, "l_extendedprice"), "l_extendedprice", "regression")


_FACTS = "model string, train_rows bigint, test_rows bigint, reaches_baseline boolean"


def _facts(scored: list[tuple[str, dict[str, Any]]], prepared: Prepared, task: str) -> list[tuple]:
    """What must come out whatever the learner's random numbers: the sizes, and a score no worse than a guess.

    The guess is the most frequent class of the test rows, or their mean; a score
    may lie below it by a hundredth. One count serves all models.
    """
    by = [SPLIT] if task == "regression" else [SPLIT, LABEL]
    counts = prepared.data.groupBy(*by).count()
    sizes = {r[0]: r[1:] for r in counts.groupBy(SPLIT).agg(F.sum("count"), F.max("count")).collect()}  # two parts
    rows, most = sizes["test"]

    def reached(metrics: dict[str, Any]) -> bool:
        return bool(metrics["r2"] >= -0.01 if task == "regression" else metrics["acc"] >= most / rows - 0.01)

    return [(name, sizes["train"][0], rows, reached(metrics)) for name, metrics in scored]


def _facts_sql(source: str, target: str, models: list[str]) -> str:
    listed = ", ".join(f"('{m}')" for m in models)
    return f"""WITH t AS (SELECT count({target}) AS n, CAST(ceil(count({target}) * 0.2) AS BIGINT) AS test FROM {source})
    SELECT model, n - test AS train_rows, test AS test_rows, true AS reaches_baseline
    FROM t, (VALUES {listed}) AS m(model)"""


_SOURCES = {
    "_classes": (GAPPY_SQL, "l_linestatus"),
    "_flags": ("lineitem", "l_returnflag"),
    "_prices": (GAPPY_SQL, "l_extendedprice"),
}


def _train(name: str, data, family: str, params: dict[str, Any], task: str = "classification"):
    def run(spark, sf):
        prepared = data(spark, sf)
        candidate = Candidate(model_registry(task, [family])[family], params)
        trained = refit(prepared.train, prepared.preprocessor, [candidate], task)[family]
        evaluate(trained, prepared.test, task)
        facts = _facts([(trained.name, trained.metrics)], prepared, task)
        prepared.release()
        return local_frame(spark, facts, _FACTS)

    query(name, _facts_sql(*_SOURCES[data.__name__], [family]))(run)


_train("train_logreg", _classes, "logreg", {"C": 1.0, "max_iter": 50})
_train("train_rf_cls", _flags, "rf", {"n_estimators": 10, "max_depth": 6})
_train("train_gbt_cls", _classes, "xgb", {"n_estimators": 5, "max_depth": 4, "learning_rate": 0.3})
_train("train_gbt_multiclass", _flags, "xgb", {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3})
_train("train_mlp", _flags, "mlp", {"hidden_layer_sizes": (16,), "max_iter": 20})
_train("train_linreg", _prices, "linreg", {}, "regression")
_train("train_ridge", _prices, "ridge", {"alpha": 1.0}, "regression")
_train("train_rf_reg", _prices, "rf", {"n_estimators": 10, "max_depth": 6}, "regression")
_train("train_gbt_reg", _prices, "xgb", {"n_estimators": 5, "max_depth": 4, "learning_rate": 0.3}, "regression")


@query(
    "linreg_slope",
    """SELECT 'all' AS part, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, count(*) AS rows FROM lineitem""",
)
def linreg_slope(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias(LABEL))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol=FEATURES).transform(df)
    family = model_registry("regression", ["linreg"])["linreg"]
    model = family.build({}, TrainShape(0, 1)).fit(rows)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("all").alias("part"),
        F.round(F.lit(float(model.coefficients[0])), 4).alias("slope"),
        F.round(F.lit(float(model.intercept)), 3).alias("intercept"),
        "rows",
    )


# --------------------------------------------------------------- neighbours


@query(
    "knn_predict_embeddings",
    """WITH d AS (SELECT a.vec_id AS id, b.vec_id AS other, b.label, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS gap
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS rank FROM d) WHERE rank <= 5),
    v AS (SELECT id, label, count(*) AS votes FROM n GROUP BY id, label)
    SELECT id AS vec_id, label::DOUBLE AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS rn FROM v) WHERE rn = 1""",
)
def knn_predict_embeddings(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = nearest(vectors, vectors, "embedding", "vec_id", "label", k=5, skip_self=True)
    return vote(found).withColumnRenamed("query_id", "vec_id")


@query(
    "knn_regress",
    """WITH x AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS a, p_retailprice AS y, (p_partkey % 97) / 7.0::DOUBLE AS b FROM part),
    d AS (SELECT x.id, z.id AS other, z.y, round(abs(x.a - z.a) + abs(x.b - z.b), 6) AS gap FROM x JOIN x z ON x.id <> z.id),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS rank FROM d) WHERE rank <= 5),
    w AS (SELECT *, CASE WHEN min(gap) OVER (PARTITION BY id) = 0 THEN CASE WHEN gap = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1.0::DOUBLE / gap END AS w FROM n)
    SELECT id AS p_partkey, round(sum(w * y) / sum(w), 4) AS prediction FROM w GROUP BY id""",
)
def knn_regress(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.array(F.col("p_size") / 10, (F.col("p_partkey") % 97) / 7).alias("place"),
        "p_retailprice",
    )
    found = nearest(parts, parts, "place", "p_partkey", "p_retailprice", k=5, p=1, skip_self=True)
    predicted = average(found, "distance").withColumnRenamed("query_id", "p_partkey")
    return predicted.withColumn("prediction", F.round("prediction", 4))


# ------------------------------------------------------------------- search

_SMALL = {"n_estimators": 5, "max_depth": 4, "max_iter": 20, "n_neighbors": 5}


def _board(spark, runs, prepared: Prepared, task: str):
    """The facts of each run; a run without a cross-validation score does not reach the baseline."""
    found = runs.collect()  # one row per model
    facts = _facts([(r["model"], r.asDict()) for r in found], prepared, task)
    rows = [(*fact[:3], fact[3] and r["cv_score"] is not None) for fact, r in zip(facts, found, strict=True)]
    prepared.release()
    return local_frame(spark, rows, _FACTS)


@query("cv_leaderboard", _facts_sql("lineitem", "l_returnflag", ["logreg", "rf"]))
def cv_leaderboard(spark, sf):
    prepared = _flags(spark, sf)
    runs, _ = run_all(
        prepared.train, prepared.test, "classification", ["logreg", "rf"], prepared.preprocessor, [ROW_ID],
        n_iter=2, folds=2, overrides=_SMALL,
    )
    return _board(spark, runs, prepared, "classification")


@query("run_all_small", _facts_sql(GAPPY_SQL, "l_extendedprice", ["linreg", "ridge", "rf"]))
def run_all_small(spark, sf):
    prepared = _prices(spark, sf)
    runs, _ = run_all(
        prepared.train, prepared.test, "regression", ["linreg", "ridge", "rf"], prepared.preprocessor, [ROW_ID],
        n_iter=2, folds=2, overrides=_SMALL,
    )
    return _board(spark, runs, prepared, "regression")


# ------------------------------------------- learners against what they must find


_PLANTED, COPIES = ["l_discount", "l_quantity", "l_tax"], "copies"


def _planted(spark, sf, label):
    """lineitem's three numeric columns and a label made of them."""
    return table(spark, sf, "lineitem").select(*_PLANTED, label.cast("double").alias(LABEL))


def _assembled(rows, columns=_PLANTED):
    return VectorAssembler(inputCols=columns, outputCol=FEATURES).transform(rows)


def _counted(rows):
    """Each different row once, kept, with the number of its copies; and how many rows there are in all.

    A loss that is a sum over rows is the same sum over different rows times copies. A learner
    with weights then passes over the file's different rows, however often they repeat.
    """
    once = rows.groupBy(*_PLANTED, LABEL).agg(F.count(F.lit(1)).cast("double").alias(COPIES)).persist()
    different, n = once.agg(F.count(F.lit(1)), F.sum(COPIES)).first()
    # The shuffle's own number of partitions leaves most of them nearly empty where few rows differ.
    counted = once.coalesce(math.ceil(different / PART_ROWS) or 1).persist()
    counted.count()
    once.unpersist()
    return counted, int(n or 0)


def _scaled(counted, n: int):
    """Columns of mean 0 and deviation 1 over all rows, in which a neural network settles in fewer passes."""
    once, squared = [F.sum(F.col(c) * F.col(COPIES)) for c in _PLANTED], [F.sum(F.col(c) ** 2 * F.col(COPIES)) for c in _PLANTED]
    sums = counted.agg(*once, *squared).first()
    out = {}
    for c, total, squares in zip(_PLANTED, sums[: len(_PLANTED)], sums[len(_PLANTED) :], strict=True):
        mean = total / n
        out[f"scaled_{c}"] = (F.col(c) - mean) / (max(0.0, squares / n - mean * mean) ** 0.5 or 1.0)
    return out


def _told(task: str, name: str, params: dict[str, Any], rows, counted, n: int, classes: int = 0):
    """What a learner fitted on all ``n`` rows predicts for each different row."""
    family = model_registry(task, [name])[name]
    if family.weighted:
        different = _assembled(counted)
        return family.build(params, TrainShape(n, len(_PLANTED), classes, COPIES)).fit(different).transform(different)
    # Without weights it reads all rows, of which it keeps a copy of its own.
    scaled = _scaled(counted, n)
    every = _assembled(dealt(rows, n).withColumns(scaled), list(scaled))
    model = family.build(params, TrainShape(n, len(_PLANTED), classes)).fit(every)
    return model.transform(_assembled(counted.withColumns(scaled), list(scaled)))


_LEARNERS = {
    "logreg": {"C": 100.0, "max_iter": 100},
    "rf": {"n_estimators": 5, "max_depth": 3, "max_features": None},
    "xgb": {"n_estimators": 2, "max_depth": 2},
    "svm": {"C": 1e6, "max_iter": 60},
    "mlp": {"hidden_layer_sizes": (3,), "max_iter": 80},
}


@query(
    "planted_classes",
    f"""SELECT model, truth, truth AS prediction, rows
    FROM (SELECT (l_discount > 0.055)::INT::DOUBLE AS truth, count(*) AS rows FROM lineitem GROUP BY 1)
    CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in _LEARNERS)}) m(model)""",
)
def planted_classes(spark, sf):
    """Every classifier finds a rule without noise: the confusion counts have nothing off the diagonal."""
    rows = _planted(spark, sf, F.col("l_discount") > 0.055)
    counted, n = _counted(rows)
    parts = []
    for name, params in _LEARNERS.items():
        told = _told("classification", name, params, rows, counted, n, 2)
        counts = told.groupBy(F.col(LABEL).alias("truth"), "prediction").agg(F.sum(COPIES).cast("long").alias("rows"))
        parts += [(name, *r) for r in counts.collect()]  # two classes
    counted.unpersist()
    return local_frame(spark, parts, "model string, truth double, prediction double, rows long")


@query(
    "planted_values",
    """SELECT model, l_discount > 0.055 AS high, count(*) AS rows,
      round(avg(3 + 4 * (l_discount > 0.055)::INT), 6) AS prediction
    FROM lineitem CROSS JOIN (VALUES ('rf'), ('xgb')) m(model) GROUP BY ALL""",
)
def planted_values(spark, sf):
    """Tree regressors find a step: the least and the mean prediction on either side are its height."""
    rows = _planted(spark, sf, 3 + 4 * (F.col("l_discount") > 0.055).cast("int"))
    counted, n = _counted(rows)
    parts = []
    for name, params in (("rf", {"n_estimators": 5, "max_depth": 3, "max_features": None}), ("xgb", {"n_estimators": 1, "max_depth": 3, "learning_rate": 1.0})):
        told = _told("regression", name, params, rows, counted, n)
        mean = F.sum(F.col("prediction") * F.col(COPIES)) / F.sum(COPIES)
        sides = told.groupBy((F.col("l_discount") > 0.055).alias("high")).agg(F.sum(COPIES).cast("long").alias("rows"), mean.alias("prediction"))
        parts += [(name, r["high"], r["rows"], round(r["prediction"], 6)) for r in sides.collect()]  # two sides
    counted.unpersist()
    return local_frame(spark, parts, "model string, high boolean, rows long, prediction double")


_TARGET_SQL = "l_extendedprice / 1000.0::DOUBLE + 2 * l_quantity - 500 * l_tax"


def _target():
    return F.col("l_extendedprice") / 1000 + 2 * F.col("l_quantity") - 500 * F.col("l_tax")


@query(
    "linear_coefficients",
    f"""WITH t AS (SELECT l_quantity AS a, l_tax AS b, {_TARGET_SQL} AS y FROM lineitem),
    s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb,
      covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS b_y FROM t),
    c AS (SELECT model, s.*, aa + p AS pa, bb + p AS pb FROM s, (VALUES ('linreg', 0.0::DOUBLE), ('ridge', 40.0::DOUBLE)) m(model, p)),
    w AS (SELECT *, (ay * pb - b_y * ab) / (pa * pb - ab * ab) AS wa, (b_y * pa - ay * ab) / (pa * pb - ab * ab) AS wb FROM c)
    SELECT model, round(wa, 5) AS quantity, round(wb, 3) AS tax, round(my - wa * ma - wb * mb, 3) AS intercept FROM w""",
)
def linear_coefficients(spark, sf):
    """Least squares without and with a penalty against the normal equations."""
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_tax", _target().alias(LABEL))
    rows = VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol=FEATURES).transform(rows)
    n, found = rows.count(), []
    for name, params in (("linreg", {}), ("ridge", {"alpha": 40.0})):
        model = model_registry("regression", [name])[name].build(params, TrainShape(n, 2)).fit(rows)
        found.append((name, round(float(model.coefficients[0]), 5), round(float(model.coefficients[1]), 3), round(float(model.intercept), 3)))
    return local_frame(spark, found, "model string, quantity double, tax double, intercept double")


@query(
    "logreg_two_cells",
    """WITH t AS (SELECT l_quantity > 25 AS x, avg((l_linestatus = 'O' OR l_quantity > 40)::INT::DOUBLE) AS p FROM lineitem GROUP BY 1)
    SELECT 'logreg' AS model, round(max(ln(p / (1 - p))) FILTER (WHERE x) - max(ln(p / (1 - p))) FILTER (WHERE NOT x), 3) AS slope,
      round(max(ln(p / (1 - p))) FILTER (WHERE NOT x), 3) AS intercept FROM t""",
)
def logreg_two_cells(spark, sf):
    """With one feature of two values the best fit is the log odds of each."""
    label = ((F.col("l_linestatus") == "O") | (F.col("l_quantity") > 40)).cast("double").alias(LABEL)
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") > 25).cast("double").alias("x"), label)
    rows = VectorAssembler(inputCols=["x"], outputCol=FEATURES).transform(rows)
    family = model_registry("classification", ["logreg"])["logreg"]
    model = family.build({"C": 1e9, "max_iter": 200}, TrainShape(rows.count(), 1, 2)).fit(rows)
    found = [("logreg", round(float(model.coefficients[0]), 3), round(float(model.intercept), 3))]
    return local_frame(spark, found, "model string, slope double, intercept double")

"""Rules over profile rows: targets, tasks, columns to drop, cleaning plans.

Every rule is a projection or a small grouping of a profile table with one row
per (``table``, column), so a whole catalog is advised in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.session import local_frame

# The word lists, type words and thresholds of the rules.
TARGET_WORDS = ["target", "label", "y", "class", "clicked", "survived", "churn", "default", "fraud"]
PLAN_TARGET_WORDS = ["target", "label", "y", "survived", "churn", "default", "clicked", "class"]
IDENTIFIER_WORDS = [
    "id", "uuid", "guid", "ssn", "phone", "email", "mobile", "passport", "zipcode", "postcode", "address",
]
LEAK_WORDS = ["label", "target", "outcome", "answer", "y_"]
DATE_WORDS = ["date", "time", "timestamp"]
NUMERIC_TYPES = ["int", "float", "double", "long", "decimal"]
CATEGORY_TYPES = ["object", "category", "string"]
REGRESSION_VALUES = 20
HIGH_MISSING = 0.98
IMPUTE_MISSING = 0.3
TEXT_SHARE = 0.5
TEXT_VALUES = 50
ALGORITHMS = [
    "logistic_regression", "random_forest", "xgboost", "knn", "mlp", "linear_regression", "ridge", "lasso",
    "svm", "kmeans", "gmm", "agglomerative",
]
METRICS = [
    "accuracy", "f1_macro", "f1_weighted", "roc_auc_ovr", "roc_auc", "precision", "recall", "log_loss",
    "rmse", "mae", "r2", "mape", "silhouette", "calinski_harabasz", "davies_bouldin",
]
DEFAULT_ALGORITHMS = {
    "classification": ["random_forest", "xgboost", "logistic_regression"],
    "regression": ["xgboost", "ridge", "knn"],
    "clustering": ["kmeans", "gmm"],
}
DEFAULT_METRICS = {
    "classification": ["f1_macro", "roc_auc_ovr", "accuracy"],
    "regression": ["rmse", "mae", "r2"],
    "clustering": ["silhouette"],
}
MAX_ALGORITHMS, MAX_METRICS = 5, 3
LOCAL_NAMES = {
    "xgboost": "xgb",
    "random_forest": "rf",
    "ridge": "ridge",
    "knn": "knn",
    "logistic_regression": "logreg",
    "linear_regression": "linreg",
    "mlp": "mlp",
}
AVAILABLE = {
    "classification": ["logreg", "rf", "xgb", "knn", "mlp"],
    # There is no neural-network regressor to train, so none is advised.
    "regression": ["linreg", "ridge", "rf", "xgb", "knn"],
}

TABLE = "table"


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _contains_any(c: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def _name() -> Column:
    return F.lower("name")


def is_numeric_type(dtype: Column) -> Column:
    return _contains_any(F.lower(dtype), NUMERIC_TYPES) & ~F.contains(F.lower(dtype), F.lit("datetime"))


def is_category_type(dtype: Column) -> Column:
    return _contains_any(F.lower(dtype), CATEGORY_TYPES)


# -------------------------------------------------------------- input forms


def normalize_profile(df: DataFrame) -> DataFrame:
    """Accept the alternative names of the profile fields.

    Missing may come as a percentage, distinct values under three names, the
    column name under three; rows without a name are left out.
    """

    def first_of(names: Sequence[str], dtype: str) -> Column:
        present = [F.col(n).cast(dtype) for n in names if n in df.columns]
        return F.coalesce(*present) if present else F.lit(None).cast(dtype)

    rows = first_of(["rows", "n_rows"], "bigint")
    from_share = F.round(first_of(["missing_pct"], "double") * 0.01 * rows).cast("bigint")
    table = F.col(TABLE) if TABLE in df.columns else F.lit("")
    pos = F.col("pos") if "pos" in df.columns else F.monotonically_increasing_id()
    return df.select(
        table.alias(TABLE),
        first_of(["name", "col", "column"], "string").alias("name"),
        pos.alias("pos"),
        F.coalesce(first_of(["dtype"], "string"), F.lit("")).alias("dtype"),
        rows.alias("rows"),
        F.coalesce(first_of(["missing"], "bigint"), from_share).alias("missing"),
        first_of(["nunique", "unique", "unique_count"], "bigint").alias("nunique"),
    ).where(F.col("name").isNotNull())


def profile_from_dict(spark: SparkSession, given: Mapping[str, Any], table: str = "") -> DataFrame:
    """A profile record (shape as mapping or list, columns as records) as profile rows."""
    shape = given.get("shape")
    rows = shape.get("rows") if isinstance(shape, Mapping) else shape[0] if shape else None
    fields = ["name", "col", "column", "dtype", "missing", "missing_pct", "nunique", "unique", "unique_count"]
    records = [
        (table, i, rows, *[None if c.get(k) is None else str(c[k]) for k in fields])
        for i, c in enumerate(given.get("columns") or [])
        if isinstance(c, Mapping)
    ]
    schema = f"{TABLE} string, pos int, rows bigint, " + ", ".join(f"{k} string" for k in fields)
    return normalize_profile(local_frame(spark, records, schema))


# ------------------------------------------------------------------ targets


def target_candidates(profiles: DataFrame) -> DataFrame:
    """Ranked target columns per table: known names first, then 2- or 3-valued columns."""
    word = F.array_position(_texts(TARGET_WORDS), _name())
    first = F.row_number().over(Window.partitionBy(TABLE, _name()).orderBy("pos"))
    rank = F.when((word > 0) & (first == 1), word)
    few = F.col("nunique").isin(2, 3)
    order = F.coalesce(rank, F.when(few, len(TARGET_WORDS) + 1 + F.col("pos")))
    kept = profiles.select("*", order.alias("__order")).where(F.col("__order").isNotNull())
    w = Window.partitionBy(TABLE).orderBy("__order")
    why = F.when(F.col("__order") <= len(TARGET_WORDS), "known_name").otherwise("few_values")
    return kept.select(TABLE, F.row_number().over(w).alias("rank"), "name", why.alias("reason"), "dtype", "nunique")


def task_by_type(dtype: Column, nunique: Column) -> Column:
    """Regression for number types with 20 or more distinct values."""
    many = F.coalesce(nunique, F.lit(0)) >= REGRESSION_VALUES
    numeric = _contains_any(F.lower(dtype), NUMERIC_TYPES)
    return F.when(numeric & many, "regression").otherwise("classification")


def infer_task(profiles: DataFrame) -> DataFrame:
    """The task each column would be, if it were the target."""
    return profiles.select(TABLE, "name", task_by_type(F.col("dtype"), F.col("nunique")).alias("task"))


def advise_target(profiles: DataFrame) -> DataFrame:
    """Per table: target, its task, the columns to keep and to drop, and a confidence."""
    best = target_candidates(profiles).where(F.col("rank") == 1)
    chosen = best.select(
        F.col(TABLE).alias("__t"), F.col("name").alias("target"), task_by_type(F.col("dtype"), F.col("nunique")).alias("task")
    )
    reasons = drop_reasons(profiles)
    # One row per table on the broadcast side of a catalog of column rows.
    joined = reasons.join(chosen, F.col(TABLE) == F.col("__t"), "left")
    keep = F.col("reason").isNull() & ~F.col("name").eqNullSafe(F.col("target"))
    names = F.sort_array(F.collect_list(F.when(keep, F.struct("pos", "name"))))
    dropped = F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("pos", "name", "reason"))))
    grouped = joined.groupBy(TABLE).agg(
        F.first("target").alias("target"), F.first("task").alias("task"), names.alias("k"), dropped.alias("d")
    )
    return grouped.select(
        TABLE,
        "target",
        "task",
        F.transform("k", lambda x: x["name"]).alias("keep_columns"),
        F.transform("d", lambda x: F.struct(x["name"], x["reason"])).alias("drop_columns"),
        F.when(F.col("target").isNotNull(), 0.6).otherwise(0.4).alias("confidence"),
    )


# ------------------------------------------------------------ columns to drop


def drop_reason() -> Column:
    rows = F.col("rows")
    return (
        F.when(_contains_any(_name(), IDENTIFIER_WORDS), "identifier_like")
        .when(F.col("nunique") <= 1, "constant_column")
        .when((rows > 0) & (F.col("missing") >= HIGH_MISSING * rows), "too_many_missing_values")
    )


def drop_reasons(profiles: DataFrame) -> DataFrame:
    """Each column with the first reason to drop it, or none."""
    return profiles.select(TABLE, "pos", "name", drop_reason().alias("reason"))


# -------------------------------------------------------------- cleaning plan


def cleaning_plan(profiles: DataFrame) -> DataFrame:
    """The steps advised for each column: (action, argument) pairs in order."""
    rows, missing, nunique = F.col("rows"), F.col("missing"), F.col("nunique")
    numeric, words = is_numeric_type(F.col("dtype")), is_category_type(F.col("dtype"))
    dtype = F.lower("dtype")
    dated = _contains_any(dtype, ["datetime", "timestamp"]) | (dtype == "date") | _contains_any(_name(), DATE_WORDS)
    some_missing = (rows > 0) & (missing > 0) & (missing <= IMPUTE_MISSING * rows)
    long_text = words & (rows > 0) & (nunique > TEXT_SHARE * rows) & (nunique >= TEXT_VALUES)

    def step(condition: Column, action: str, argument: str) -> Column:
        return F.when(condition, F.struct(F.lit(action).alias("action"), F.lit(argument).alias("argument")))

    steps = F.array_compact(
        F.array(
            step(some_missing & numeric, "impute", "median"),
            step(some_missing & words & ~numeric, "impute", "most_frequent"),
            step(dated, "parse_date", ""),
            step(numeric, "scale", ""),
            step(numeric, "clip", "iqr_clip"),
            step(long_text, "text", "high_cardinality_text"),
        )
    )
    reason = drop_reason()
    drop = F.array(F.struct(F.lit("drop").alias("action"), reason.alias("argument")))
    leak = _contains_any(_name(), LEAK_WORDS)
    return profiles.select(
        TABLE, "pos", "name", F.when(reason.isNotNull(), drop).otherwise(steps).alias("steps"), leak.alias("leakage_risk")
    )


def leakage_names(profiles: DataFrame) -> DataFrame:
    return profiles.where(_contains_any(_name(), LEAK_WORDS)).select(TABLE, "name")


def plan_for(profiles: DataFrame) -> dict[str, Any]:
    """The cleaning plan of one table in the form ``apply_cleaning_plan`` takes."""
    rows = cleaning_plan(profiles).orderBy("pos").collect()  # one row per column
    plan: dict[str, Any] = {
        "drop_columns": [],
        "imputations": [],
        "type_casts": [],
        "parse_dates": [],
        "scaling": {"apply": True, "columns": []},
        "outliers": {"apply": True, "columns": [], "method": "iqr_clip"},
        "text_processing": [],
        "leakage_risk": [r["name"] for r in rows if r["leakage_risk"]],
    }
    for r in rows:
        for s in r["steps"]:
            name, action, argument = r["name"], s["action"], s["argument"]
            if action == "drop":
                plan["drop_columns"].append({"name": name, "reason": argument})
            elif action == "impute":
                plan["imputations"].append({"name": name, "strategy": argument})
            elif action == "parse_date":
                plan["parse_dates"].append(name)
            elif action == "scale":
                plan["scaling"]["columns"].append(name)
            elif action == "clip":
                plan["outliers"]["columns"].append(name)
            else:
                plan["text_processing"].append({"name": name, "suggestion": argument})
    return plan


# ------------------------------------------------------------------ task plans


def _by_task(task: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    out = _texts(lists["clustering"])
    for name in ("regression", "classification"):
        out = F.when(task == name, _texts(lists[name])).otherwise(out)
    return out


def task_plan(profiles: DataFrame) -> DataFrame:
    """Per table: classification on the best known target name, else regression."""
    word = F.array_position(_texts(PLAN_TARGET_WORDS), _name())
    hit = F.min(F.when(word > 0, F.struct(word.alias("w"), "pos", "name")))
    found = profiles.groupBy(TABLE).agg(hit.alias("h"))
    task = F.when(F.col("h").isNotNull(), "classification").otherwise("regression")
    candidates = F.array_compact(F.array(F.col("h.name")))
    return found.select(
        TABLE,
        task.alias("task_type"),
        candidates.alias("target_candidates"),
        _by_task(task, DEFAULT_ALGORITHMS).alias("algorithms"),
        _by_task(task, DEFAULT_METRICS).alias("metrics"),
        F.lit(5).alias("folds"),
        (task == "classification").alias("stratified"),
    )


def clamp_plan(plans: DataFrame) -> DataFrame:
    """Keep known algorithms and metrics, at most five and three; defaults when none is left."""

    def clamp(col: str, known: Sequence[str], most: int, defaults) -> Column:
        left = F.slice(F.filter(col, lambda x: x.isin(*known)), 1, most)
        return F.when(F.size(left) > 0, left).otherwise(_by_task(F.col("task_type"), defaults))

    return plans.withColumns(
        {
            "algorithms": clamp("algorithms", ALGORITHMS, MAX_ALGORITHMS, DEFAULT_ALGORITHMS),
            "metrics": clamp("metrics", METRICS, MAX_METRICS, DEFAULT_METRICS),
        }
    )


def map_algorithms(algorithms: Sequence[str], task: str) -> list[str]:
    """Plan names to local family names; the default pair when none fits the task."""
    local = [LOCAL_NAMES.get(a, a) for a in algorithms or []]
    return [a for a in local if a in AVAILABLE[task]] or ["rf", "xgb"]


# ------------------------------------------------------------- outside advice


def validate_advice(profiles: DataFrame, advice: DataFrame) -> DataFrame:
    """Reduce advice rows (table, kind, name, value) to known columns and fill defaults.

    A kind of advice of which nothing is left falls back to the rules, except
    for the kinds that may be empty.
    """
    # The default of each kind of advice.
    defaults = {
        "drop": "unknown",
        "impute": "most_frequent",
        "cast": "auto",
        "outlier": "iqr_clip",
        "text": "hashing_trick",
        "parse_date": "",
        "leak": "",
        "keep": "",
    }
    default = F.lit("")
    for kind, value in defaults.items():
        default = F.when(F.col("kind") == kind, value).otherwise(default)
    known = advice.join(profiles.select(TABLE, "name"), [TABLE, "name"], "left_semi")
    targets = known.where(F.col("kind") == "target").select(TABLE, "name").distinct()
    kept = known.where(F.col("kind") != "target")
    # The target is never in the keep-list.
    clash = targets.select(TABLE, "name", F.lit("keep").alias("kind"))
    kept = kept.join(clash, [TABLE, "name", "kind"], "left_anti")
    value = F.when(F.coalesce("value", F.lit("")) == "", default).otherwise(F.col("value"))
    result = kept.select(TABLE, "kind", "name", value.alias("value"), F.lit("advice").alias("origin"))
    result = result.unionByName(targets.select(TABLE, F.lit("target").alias("kind"), "name", F.lit("").alias("value"), F.lit("advice").alias("origin")))
    given = result.select(TABLE, "kind").distinct()
    rules = rule_advice(profiles).join(given, [TABLE, "kind"], "left_anti")
    return result.unionByName(rules.withColumn("origin", F.lit("rule")))


def rule_advice(profiles: DataFrame) -> DataFrame:
    """The rule results as advice rows, for the kinds that may not be empty."""
    steps = cleaning_plan(profiles).select(TABLE, "name", F.inline("steps"))
    kinds = steps.where(F.col("action").isin("drop", "impute", "parse_date", "text"))
    rows = kinds.select(TABLE, F.col("action").alias("kind"), "name", F.col("argument").alias("value"))
    leaks = leakage_names(profiles).select(TABLE, F.lit("leak").alias("kind"), "name", F.lit("").alias("value"))
    return rows.unionByName(leaks)

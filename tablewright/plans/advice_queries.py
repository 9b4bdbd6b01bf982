"""Registered queries: advisors over the profile rows of a catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import advise
from tablewright.operators.profile import catalog_profile
from tablewright.plans.tables import CATALOG_SQL, catalog_tables
from tablewright.sources.tables import plan_to_json

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def profiles(spark, sf):
    """Profile rows of the catalog: computed once, as the rules read them several times."""
    return catalog_profile(catalog_tables(spark, sf))


CATALOG = f'WITH p AS ({CATALOG_SQL})'

# The rules once more, written as SQL over the profile rows ``p``.
NUMERIC = "dtype IN ('bigint', 'int', 'double')"
WORDS = ["id", "uuid", "guid", "ssn", "phone", "email", "mobile", "passport", "zipcode", "postcode", "address"]
IDENTIFIER = "(" + " OR ".join(f"name LIKE '%{w}%'" for w in WORDS) + ")"
REASON = f"""CASE WHEN {IDENTIFIER} THEN 'identifier_like' WHEN nunique <= 1 THEN 'constant_column'
  WHEN missing >= 0.98 * rows THEN 'too_many_missing_values' END"""
LEAK = "(name LIKE '%label%' OR name LIKE '%target%' OR name LIKE '%outcome%' OR name LIKE '%answer%' OR name LIKE '%y\\_%' ESCAPE '\\')"
TASK = f"CASE WHEN {NUMERIC} AND nunique >= 20 THEN 'regression' ELSE 'classification' END"
KNOWN = "list_position(['target','label','y','class','clicked','survived','churn','default','fraud'], name)"
CANDIDATES = f"""c AS (SELECT "table", name, dtype, nunique, CASE WHEN {KNOWN} > 0 THEN {KNOWN} WHEN nunique IN (2, 3) THEN 10 + pos END AS o FROM p),
  t AS (SELECT "table", row_number() OVER (PARTITION BY "table" ORDER BY o) AS rank, name,
    CASE WHEN o <= 9 THEN 'known_name' ELSE 'few_values' END AS reason, dtype, nunique FROM c WHERE o IS NOT NULL)"""


@query("infer_task", f'{CATALOG} SELECT "table", name, {TASK} AS task FROM p')
def infer_task(spark, sf):
    return advise.infer_task(profiles(spark, sf))


@query("target_candidates", f"{CATALOG}, {CANDIDATES} SELECT * FROM t")
def target_candidates(spark, sf):
    return advise.target_candidates(profiles(spark, sf))


@query("drop_reasons", f'{CATALOG} SELECT "table", pos, name, {REASON} AS reason FROM p')
def drop_reasons(spark, sf):
    return advise.drop_reasons(profiles(spark, sf))


@query(
    "advise_target",
    f"""{CATALOG}, {CANDIDATES}, b AS (SELECT "table", name AS target, {TASK} AS task FROM t WHERE rank = 1),
    d AS (SELECT "table" AS tab, pos, name, {REASON} AS reason FROM p)
    SELECT tab AS "table", any_value(target) AS target, any_value(task) AS task,
    coalesce(string_agg(name, ',' ORDER BY pos) FILTER (reason IS NULL AND name IS DISTINCT FROM target), '') AS keep_columns,
    coalesce(string_agg(name || ':' || reason, ',' ORDER BY pos) FILTER (reason IS NOT NULL), '') AS drop_columns,
    CASE WHEN any_value(target) IS NULL THEN 0.4 ELSE 0.6 END::DOUBLE AS confidence
    FROM d LEFT JOIN b ON d.tab = b."table" GROUP BY tab""",
)
def advise_target(spark, sf):
    advice = advise.advise_target(profiles(spark, sf))
    dropped = F.transform("drop_columns", lambda x: F.concat(x["name"], F.lit(":"), x["reason"]))
    return advice.withColumns(
        {"keep_columns": F.array_join("keep_columns", ","), "drop_columns": F.array_join(dropped, ",")}
    )


STEPS = f"""CASE WHEN ({REASON}) IS NOT NULL THEN 'drop:' || ({REASON}) ELSE concat_ws(' ',
  CASE WHEN missing > 0 AND missing <= 0.3 * rows AND {NUMERIC} THEN 'impute:median'
    WHEN missing > 0 AND missing <= 0.3 * rows AND dtype = 'string' THEN 'impute:most_frequent' END,
  CASE WHEN dtype LIKE 'timestamp%' OR name LIKE '%date%' OR name LIKE '%time%' THEN 'parse_date:' END,
  CASE WHEN {NUMERIC} THEN 'scale:' END, CASE WHEN {NUMERIC} THEN 'clip:iqr_clip' END,
  CASE WHEN dtype = 'string' AND nunique > 0.5 * rows AND nunique >= 50 THEN 'text:high_cardinality_text' END) END"""


@query("cleaning_plan", f'{CATALOG} SELECT "table", pos, name, {STEPS} AS steps, {LEAK} AS leakage_risk FROM p')
def cleaning_plan(spark, sf):
    plan = advise.cleaning_plan(profiles(spark, sf))
    return plan.withColumn(
        "steps", F.array_join(F.transform("steps", lambda s: F.concat(s["action"], F.lit(":"), s["argument"])), " ")
    )


TASK_PLAN = """h AS (SELECT "table", arg_min(name, list_position(['target','label','y','survived','churn','default','clicked','class'], name))
  FILTER (list_position(['target','label','y','survived','churn','default','clicked','class'], name) > 0) AS target,
  sum(nunique)::BIGINT AS values FROM p GROUP BY "table")"""


def _joined(plan):
    return plan.withColumns({c: F.array_join(c, ",") for c in ("target_candidates", "algorithms", "metrics")})


@query(
    "task_plan",
    f"""{CATALOG}, {TASK_PLAN} SELECT "table", CASE WHEN target IS NULL THEN 'regression' ELSE 'classification' END AS task_type,
    coalesce(target, '') AS target_candidates,
    CASE WHEN target IS NULL THEN 'xgboost,ridge,knn' ELSE 'random_forest,xgboost,logistic_regression' END AS algorithms,
    CASE WHEN target IS NULL THEN 'rmse,mae,r2' ELSE 'f1_macro,roc_auc_ovr,accuracy' END AS metrics,
    5 AS folds, target IS NOT NULL AS stratified, values AS distinct_values FROM h""",
)
def task_plan(spark, sf):
    known = profiles(spark, sf)
    values = known.groupBy("table").agg(F.sum("nunique").alias("distinct_values"))
    # One row per table on both sides.
    return _joined(advise.task_plan(known)).join(F.broadcast(values), "table")


@query(
    "clamp_plan",
    f"""{CATALOG}, {TASK_PLAN} SELECT "table", CASE WHEN target IS NULL THEN 'regression' ELSE 'classification' END AS task_type,
    coalesce(target, '') AS target_candidates,
    CASE WHEN values % 2 = 0 THEN 'svm,knn,mlp,ridge,lasso' WHEN target IS NULL THEN 'xgboost,ridge,knn' ELSE 'random_forest,xgboost,logistic_regression' END AS algorithms,
    CASE WHEN values % 2 = 1 THEN 'mae,r2,mape' WHEN target IS NULL THEN 'rmse,mae,r2' ELSE 'f1_macro,roc_auc_ovr,accuracy' END AS metrics,
    5 AS folds, target IS NOT NULL AS stratified FROM h""",
)
def clamp_plan(spark, sf):
    known = profiles(spark, sf)
    even = F.sum("nunique") % 2 == 0
    many = ["magic", "svm", "knn", "mlp", "oracle", "ridge", "lasso", "gmm"]
    few = ["magic", "oracle"]

    def texts(values):
        return F.array(*[F.lit(v) for v in values])

    odd = known.groupBy("table").agg(
        F.when(even, texts(many)).otherwise(texts(few)).alias("algorithms"),
        F.when(even, texts(["guess"])).otherwise(texts(["mae", "r2", "guess", "mape", "rmse"])).alias("metrics"),
    )
    plans = advise.task_plan(known).drop("algorithms", "metrics").join(F.broadcast(odd), "table")
    return _joined(advise.clamp_plan(plans))


@query(
    "plan_json",
    f"""{CATALOG}, {TASK_PLAN} SELECT '{{"table":"' || "table" || '","task_type":"' || CASE WHEN target IS NULL THEN 'regression' ELSE 'classification' END
    || '","target_candidates":[' || coalesce('"' || target || '"', '') || '],"algorithms":['
    || CASE WHEN target IS NULL THEN '"xgboost","ridge","knn"' ELSE '"random_forest","xgboost","logistic_regression"' END || '],"metrics":['
    || CASE WHEN target IS NULL THEN '"rmse","mae","r2"' ELSE '"f1_macro","roc_auc_ovr","accuracy"' END
    || '],"folds":5,"stratified":' || CASE WHEN target IS NULL THEN 'false' ELSE 'true' END || '}}' AS plan FROM h""",
)
def plan_json(spark, sf):
    return plan_to_json(advise.task_plan(profiles(spark, sf)))


@query(
    "validate_advice",
    f"""{CATALOG}, r AS (SELECT "table", name, {REASON} AS reason, {STEPS} AS steps, {LEAK} AS leak, dtype, rows, missing, nunique FROM p),
    k AS (SELECT "table", unnest(['drop', 'impute', 'keep', 'cast']) AS kind, name, missing FROM p),
    a AS (SELECT "table", kind, name, CASE kind WHEN 'drop' THEN 'unknown' WHEN 'impute' THEN 'mean' WHEN 'cast' THEN 'auto' ELSE '' END AS value
      FROM k WHERE (kind = 'impute' AND missing > 0) OR (kind = 'keep' AND name <> 'churn') OR (kind = 'drop' AND "table" = 'signups')
        OR (kind = 'cast' AND "table" = 'events')
      UNION ALL SELECT "table", 'target', name, '' FROM p WHERE name = 'churn'),
    rules AS (SELECT "table", 'drop' AS kind, name, reason AS value FROM r WHERE reason IS NOT NULL
      UNION ALL SELECT "table", 'impute', name, CASE WHEN steps LIKE '%impute:median%' THEN 'median' ELSE 'most_frequent' END FROM r WHERE steps LIKE '%impute:%'
      UNION ALL SELECT "table", 'parse_date', name, '' FROM r WHERE steps LIKE '%parse_date:%'
      UNION ALL SELECT "table", 'text', name, 'high_cardinality_text' FROM r WHERE steps LIKE '%text:high%'
      UNION ALL SELECT "table", 'leak', name, '' FROM r WHERE leak)
    SELECT *, 'advice' AS origin FROM a
    UNION ALL SELECT *, 'rule' FROM rules WHERE ("table", kind) NOT IN (SELECT "table", kind FROM a)""",
)
def validate_advice(spark, sf):
    known = profiles(spark, sf)

    def advice(kind, value, where):
        return known.where(where).select("table", F.lit(kind).alias("kind"), "name", F.lit(value).alias("value"))

    parts = [
        advice("impute", "mean", F.col("missing") > 0),
        advice("keep", "", F.lit(True)),
        advice("drop", "", F.col("table") == "signups"),
        advice("cast", "", F.col("table") == "events"),
        advice("target", "", F.col("name") == "churn"),
        advice("drop", "gone", F.lit(True)).withColumn("name", F.concat("name", F.lit("_absent"))),
    ]
    given = parts[0]
    for p in parts[1:]:
        given = given.unionByName(p)
    return advise.validate_advice(known, given)

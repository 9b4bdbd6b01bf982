"""Inputs of the registered queries, in Spark and as the matching SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# ------------------------------------------------- lineitem with gaps

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def gappy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with NULLs in l_tax and l_returnflag and NaNs in l_quantity."""
    df = table(spark, folder, "lineitem")
    number = F.col("l_linenumber")
    return df.withColumns(
        {
            "l_tax": F.when(number != 3, F.col("l_tax")),
            "l_returnflag": F.when(number != 5, F.col("l_returnflag")),
            "l_quantity": F.when(number == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity")),
        }
    )


GAPPY_SQL = """(SELECT * REPLACE (
  CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax,
  CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag,
  CASE WHEN l_linenumber <> 2 THEN l_quantity END AS l_quantity) FROM lineitem)"""


# ------------------------------------------------- a sign-up table

SIGNUPS = {
    "customer_id": "bigint",
    "churn": "int",
    "all_same": "string",
    "mostly_missing": "int",
    "full_name": "string",
    "balance": "double",
    "segment": "string",
    "signup_date": "string",
    "y_rank": "int",
}


def signups(spark: SparkSession, folder: str) -> DataFrame:
    """customer as a raw upload: an id, a constant, gaps, dates as text."""
    k = F.col("c_custkey")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    return table(spark, folder, "customer").select(
        k.alias("customer_id"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("churn"),
        F.lit("same").alias("all_same"),
        F.when(k % 100 == 0, F.col("c_nationkey")).alias("mostly_missing"),
        F.col("c_name").alias("full_name"),
        F.when(k % 10 != 3, F.col("c_acctbal")).alias("balance"),
        F.when(k % 10 != 4, F.col("c_mktsegment")).alias("segment"),
        F.concat(F.lit("2024-02-"), day).alias("signup_date"),
        F.col("c_nationkey").alias("y_rank"),
    )


SIGNUPS_SQL = """(SELECT c_custkey AS customer_id,
  CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS churn,
  'same' AS all_same,
  CASE WHEN c_custkey % 100 = 0 THEN c_nationkey END AS mostly_missing,
  c_name AS full_name,
  CASE WHEN c_custkey % 10 <> 3 THEN c_acctbal END AS balance,
  CASE WHEN c_custkey % 10 <> 4 THEN c_mktsegment END AS segment,
  '2024-02-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS signup_date,
  c_nationkey AS y_rank FROM customer)"""


# ------------------------------------------------- catalog of profiles

COLUMNS = {
    "signups": SIGNUPS,
    "orders": {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    },
    "events": {
        "event_id": "bigint",
        "ts": "timestamp_ntz",
        "user_id": "bigint",
        "event_type": "string",
        "value": "double",
        "props": "string",
    },
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}


def catalog_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = {n: table(spark, folder, n) for n in COLUMNS if n not in ("signups", "lineitem")}
    return {"signups": signups(spark, folder), "lineitem": gappy_lineitem(spark, folder), **tables}


def kind_of(dtype: str) -> str:
    return "date" if dtype.startswith(("timestamp", "date")) else "text" if dtype == "string" else "num"


def profile_sql(name: str, source: str | None = None, columns: dict[str, str] | None = None) -> str:
    """The light profile of one table as SQL."""
    source = source or {"signups": SIGNUPS_SQL, "lineitem": GAPPY_SQL}.get(name, name)
    parts = [
        f"SELECT '{name}' AS \"table\", '{c}' AS name, {i} AS pos, '{t}' AS dtype, '{kind_of(t)}' AS kind, "
        f"count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS nunique FROM {source}"
        for i, (c, t) in enumerate((columns or COLUMNS[name]).items())
    ]
    return " UNION ALL ".join(parts)


CATALOG_SQL = " UNION ALL ".join(profile_sql(n) for n in COLUMNS)


# ------------------------------------------------- run log and questions

MODELS = ["logreg", "rf", "xgb", "knn", "mlp", "ridge", "linreg"]


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem read as a log of training runs: an order is a run, a line a model."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), F.col("l_linenumber"))
    number = F.col("l_orderkey") % 3 == 0
    target = F.element_at(F.array(F.lit("churn"), F.lit("price"), F.lit("")), (F.col("l_orderkey") % 3 + 1).cast("int"))

    def when_number(c):
        return F.when(number, c)

    def when_class(c):
        return F.when(~number, c)

    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        model.alias("model"),
        F.when(number, "regression").otherwise("classification").alias("task"),
        target.alias("target"),
        (F.col("l_quantity") / 51.7 - F.col("l_discount")).alias("cv_score"),
        (F.col("l_extendedprice") / 997).alias("fit_s"),
        (F.col("l_tax") + F.col("l_quantity") / 997).alias("predict_s"),
        when_class(F.col("l_quantity") / 51.3).alias("acc"),
        when_class(F.col("l_quantity") / 59.3).alias("f1_macro"),
        when_class(F.when(F.col("l_returnflag") != "A", 1 - F.col("l_discount") * 4)).alias("roc_auc"),
        when_number(F.col("l_extendedprice")).alias("rmse"),
        when_number(F.col("l_extendedprice") * 0.8).alias("mae"),
        when_number(1 - F.col("l_discount") * 10).alias("r2"),
    )


RUN_LOG_SQL = """(SELECT l_orderkey AS run_id,
  (['logreg','rf','xgb','knn','mlp','ridge','linreg'])[l_linenumber] AS model,
  CASE WHEN l_orderkey % 3 = 0 THEN 'regression' ELSE 'classification' END AS task,
  (['churn','price',''])[l_orderkey % 3 + 1] AS target,
  l_quantity / 51.7::DOUBLE - l_discount AS cv_score,
  l_extendedprice / 997 AS fit_s,
  l_tax + l_quantity / 997 AS predict_s,
  CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity / 51.3::DOUBLE END AS acc,
  CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity / 59.3::DOUBLE END AS f1_macro,
  CASE WHEN l_orderkey % 3 <> 0 AND l_returnflag <> 'A' THEN 1 - l_discount * 4 END AS roc_auc,
  CASE WHEN l_orderkey % 3 = 0 THEN l_extendedprice END AS rmse,
  CASE WHEN l_orderkey % 3 = 0 THEN l_extendedprice * 0.8::DOUBLE END AS mae,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 - l_discount * 10 END AS r2
  FROM lineitem)"""


def question_list(spark: SparkSession, folder: str) -> DataFrame:
    """documents read as research questions about the runs of the same number."""
    k = F.col("doc_id")

    def pick(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))

    methods = F.element_at(
        F.array(
            F.array(F.lit("Random_Forest"), F.lit("xgb")),
            F.array(F.lit("logistic"), F.lit("neural network")),
            F.array(F.lit("survival analysis")),
            F.array().cast("array<string>"),
        ),
        (F.col("n_chars") % 4 + 1).cast("int"),
    )
    return table(spark, folder, "documents").select(
        k.alias("question_id"),
        k.alias("run_id"),
        F.concat(F.lit("question "), k.cast("string")).alias("question"),
        pick(["classification", "regression", "Prediction", "exploration", "other"], k % 5).alias("type"),
        F.when(F.col("lang") == "en", "churn").when(F.col("lang") == "fr", "price").alias("target_column"),
        pick(["Easy", "Medium", "Hard", "unknown"], F.col("n_chars") % 4).alias("difficulty"),
        F.col("text").alias("business_value"),
        methods.alias("required_methods"),
    )


QUESTIONS_SQL = """(SELECT doc_id AS question_id, doc_id AS run_id, 'question ' || doc_id AS question,
  (['classification','regression','Prediction','exploration','other'])[doc_id % 5 + 1] AS type,
  CASE lang WHEN 'en' THEN 'churn' WHEN 'fr' THEN 'price' END AS target_column,
  (['Easy','Medium','Hard','unknown'])[n_chars % 4 + 1] AS difficulty,
  text AS business_value,
  CASE n_chars % 4 WHEN 0 THEN ['Random_Forest','xgb'] WHEN 1 THEN ['logistic','neural network']
    WHEN 2 THEN ['survival analysis'] ELSE CAST([] AS VARCHAR[]) END AS required_methods
  FROM documents)"""

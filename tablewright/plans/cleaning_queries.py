"""Registered queries: cleaning, masking, leakage and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.pii import EMAIL, ID_NUMBER, MASK, PHONE, mask_pii
from tablewright.operators import advise, cleaning, features, leakage
from tablewright.operators.profile import LONG_TEXT, light_profile
from tablewright.plans.prepare import prepare
from tablewright.plans.tables import GAPPY_SQL, SIGNUPS_SQL, gappy_lineitem, signups, table
from tablewright.session import local_frame

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# -------------------------------------------------------------- imputation


def _impute(name, column, strategy, value_sql):
    sql = f"SELECT l_orderkey, l_linenumber, coalesce({column}, ({value_sql})) AS {column} FROM {GAPPY_SQL}"

    def run(spark, sf):
        df = gappy_lineitem(spark, sf).select("l_orderkey", "l_linenumber", column)
        return cleaning.impute(df, [{"name": column, "strategy": strategy}, {"name": "absent"}])

    query(name, sql)(run)


_impute("impute_median", "l_quantity", "median", f"SELECT quantile_cont(l_quantity, 0.5) FROM {GAPPY_SQL}")
_impute("impute_mean", "l_tax", "mean", f"SELECT avg(l_tax) FROM {GAPPY_SQL}")
_impute(
    "impute_mode",
    "l_returnflag",
    "most_frequent",
    f"SELECT l_returnflag FROM {GAPPY_SQL} WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
)
_rounded = QUERIES["impute_mean"]
QUERIES["impute_mean"] = lambda spark, sf: _rounded(spark, sf).withColumn("l_tax", F.round("l_tax", 6))
ORACLES["impute_mean"] = (
    f"SELECT l_orderkey, l_linenumber, round(coalesce(l_tax, (SELECT avg(l_tax) FROM {GAPPY_SQL})), 6) AS l_tax FROM {GAPPY_SQL}"
)


# ---------------------------------------------------------------- clipping


@query(
    "iqr_clip",
    f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b,
      quantile_cont(l_quantity, 0.25) AS c, quantile_cont(l_quantity, 0.75) AS d FROM {GAPPY_SQL})
    SELECT l_orderkey, l_linenumber, round(greatest(a - 0.1 * (b - a), least(b + 0.1 * (b - a), l_extendedprice)), 4) AS l_extendedprice,
    CASE WHEN l_quantity IS NOT NULL THEN round(greatest(c - 0.1 * (d - c), least(d + 0.1 * (d - c), l_quantity)), 4) END AS l_quantity
    FROM {GAPPY_SQL}, q""",
)
def iqr_clip(spark, sf):
    df = gappy_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    clipped = cleaning.iqr_clip(df, ["l_extendedprice", "l_quantity"], whisker=0.1)
    return clipped.withColumns({c: F.round(c, 4) for c in ("l_extendedprice", "l_quantity")})


# ---------------------------------------------------- uninformative columns


@query(
    "drop_uninformative",
    f"""SELECT 'all_same' AS name, 'constant' AS reason, count(*) - count(all_same) AS missing FROM {SIGNUPS_SQL}
    UNION ALL SELECT 'mostly_missing', 'high_missing', count(*) - count(mostly_missing) FROM {SIGNUPS_SQL}
    UNION ALL SELECT 'never', 'all_null', count(*) FROM {SIGNUPS_SQL}""",
)
def drop_uninformative(spark, sf):
    df = signups(spark, sf).withColumn("never", F.lit(None).cast("double"))
    found = cleaning.fit_uninformative(df)
    rows = [(c, r) for r in ("all_null", "constant", "high_missing") for c in getattr(found, r)]
    missing = light_profile(df).select("name", "missing")
    return F.broadcast(local_frame(spark, rows, "name string, reason string")).join(missing, "name")


# -------------------------------------------------------------------- dates


def _expand_sql(c, source, keys):
    return f"""SELECT {keys}, year({c}) AS {c}__year, month({c}) AS {c}__month, day({c}) AS {c}__day, isodow({c}) - 1 AS {c}__dow,
    CASE WHEN day({c}) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}__is_month_start,
    CASE WHEN CAST({c} AS DATE) = last_day({c}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}__is_month_end FROM {source}"""


@query(
    "expand_datetime",
    _expand_sql("o_orderdate", "(SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS o_orderdate FROM orders)", "o_orderkey"),
)
def expand_datetime(spark, sf):
    date = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("o_orderdate")
    return cleaning.expand_datetime(table(spark, sf, "orders").select("o_orderkey", date), ["o_orderdate"])


@query("expand_datetime_lineitem", _expand_sql("l_shipdate", "lineitem", "l_orderkey, l_linenumber"))
def expand_datetime_lineitem(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return cleaning.expand_datetime(df, ["l_shipdate"])


# ------------------------------------------------------------------ masking


def _mask_sql(c):
    for pattern in (EMAIL, PHONE, ID_NUMBER):
        c = f"regexp_replace({c}, '{pattern}', '{MASK}', 'g')"
    return c


@query("mask_pii_documents", f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents")
def mask_pii_documents(spark, sf):
    return mask_pii(table(spark, sf, "documents").select("doc_id", "text"))


@query("mask_pii_conversations", f"SELECT conv_id, turn, {_mask_sql('text')} AS text FROM conversations")
def mask_pii_conversations(spark, sf):
    return mask_pii(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["text"])


# --------------------------------------------------------------------- plans


@query(
    "apply_cleaning_plan",
    f"""WITH b AS (SELECT quantile_cont(balance, 0.5) AS med FROM {SIGNUPS_SQL}),
    s AS (SELECT segment FROM {SIGNUPS_SQL} WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT churn, full_name, CAST(signup_date AS TIMESTAMP) AS signup_date, y_rank, coalesce(balance, med) AS balance,
      coalesce(x.segment, s.segment) AS segment FROM {SIGNUPS_SQL} x, b, s),
    q AS (SELECT quantile_cont(balance, 0.25) AS q1, quantile_cont(balance, 0.75) AS q3, quantile_cont(churn, 0.25) AS c1,
      quantile_cont(churn, 0.75) AS c3, quantile_cont(y_rank, 0.25) AS y1, quantile_cont(y_rank, 0.75) AS y3 FROM f)
    SELECT full_name, signup_date, segment, round(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), balance)), 4) AS balance,
    round(greatest(c1 - 1.5 * (c3 - c1), least(c3 + 1.5 * (c3 - c1), churn)), 4) AS churn,
    round(greatest(y1 - 1.5 * (y3 - y1), least(y3 + 1.5 * (y3 - y1), y_rank)), 4) AS y_rank FROM f, q""",
)
def apply_cleaning_plan(spark, sf):
    df = signups(spark, sf)
    plan = advise.plan_for(light_profile(df).withColumn("table", F.lit("signups")))
    cleaned = cleaning.apply_cleaning_plan(df, plan)
    return cleaned.withColumns({c: F.round(c, 4) for c in ("balance", "churn", "y_rank")})


# ------------------------------------------------------------------- leakage


def _leaky(spark, sf):
    """lineitem with a doubled target and a constant among the features."""
    return gappy_lineitem(spark, sf).select(
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_linenumber",
        F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice") * 2 + 1).alias("double_price"),
        F.lit(7).alias("always_seven"),
    )


LEAKY_SQL = f"""(SELECT l_extendedprice, l_quantity, l_discount, l_tax, l_linenumber,
  CASE WHEN l_linenumber <> 4 THEN l_extendedprice * 2 + 1 END AS double_price, 7 AS always_seven FROM {GAPPY_SQL})"""
_CORR = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "double_price"]


def _corr_sql(y, cols, source):
    return " UNION ALL ".join(f"SELECT '{c}' AS name, round(corr({c}, {y}), 6) AS correlation FROM {source}" for c in cols)


@query(
    "corr_with_target",
    _corr_sql("l_extendedprice", _CORR, LEAKY_SQL) + " UNION ALL SELECT 'always_seven', CAST(NULL AS DOUBLE)",
)
def corr_with_target(spark, sf):
    return leakage.corr_with_target(_leaky(spark, sf), "l_extendedprice", "regression")


@query(
    "corr_with_text_target",
    "WITH x AS (SELECT o_orderkey, o_custkey, o_totalprice, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS y FROM orders) "
    + _corr_sql("y", ["o_orderkey", "o_custkey", "o_totalprice"], "x"),
)
def corr_with_text_target(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return leakage.corr_with_target(df, "o_orderpriority", "classification")


@query(
    "leakage_corr",
    f"SELECT * FROM ({_corr_sql('l_extendedprice', _CORR, LEAKY_SQL)}) WHERE abs(correlation) >= 0.98",
)
def leakage_corr(spark, sf):
    found = leakage.corr_with_target(_leaky(spark, sf), "l_extendedprice", "regression")
    return found.where(F.abs("correlation") >= leakage.CORRELATION_LIMIT)


@query(
    "leakage_guard",
    f"""SELECT count(*) AS rows, round(avg(balance), 4) AS balance, count(segment) AS segment, count(full_name) AS full_name
    FROM {SIGNUPS_SQL}""",
)
def leakage_guard(spark, sf):
    df = signups(spark, sf).select(
        "churn", "balance", "segment", "full_name", F.col("y_rank").alias("churn_rank"), (F.col("churn") * -3).alias("flag"),
        F.col("y_rank").alias("outcome_code"),
    )
    left = leakage.leakage_guard(df, "churn", "classification").drop("churn")
    aggs = {"balance": F.round(F.avg("balance"), 4)}
    return left.agg(
        F.count(F.lit(1)).alias("rows"), *[aggs.get(c, F.count(c)).alias(c) for c in left.columns]
    )


# ------------------------------------------------------------------ features


@query(
    "encode_label",
    "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders",
)
def encode_label(spark, sf):
    return features.encode_label(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(
    "scale_numeric",
    f"""WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_tax, 0.5) AS mt FROM {GAPPY_SQL}),
    f AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, mq) AS l_quantity, coalesce(l_tax, mt) AS l_tax, 7 AS seven FROM {GAPPY_SQL}, m),
    s AS (SELECT avg(l_quantity) AS aq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS a_t, stddev_pop(l_tax) AS st FROM f)
    SELECT l_orderkey, l_linenumber, round((l_quantity - aq) / sq, 6) AS l_quantity, round((l_tax - a_t) / st, 6) AS l_tax,
    0.0::DOUBLE AS seven FROM f, s""",
)
def scale_numeric(spark, sf):
    df = gappy_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(7).alias("seven"))
    scaled = features.scale_numeric(df, ["l_quantity", "l_tax", "seven"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax", "seven")})


def _slots_sql(name, expr):
    return f"""SELECT '{name}' AS name, slot, count(*) AS rows FROM (
    SELECT CASE WHEN count(*) OVER (PARTITION BY v) >= 0.01 * count(*) OVER () THEN v ELSE '(rare)' END AS slot FROM (
    SELECT coalesce({expr}, (SELECT {expr} FROM documents WHERE {expr} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS v
    FROM documents)) GROUP BY slot"""


#: Texts beyond the length are named by their digest.
_WHOLE_TEXT = f"CASE WHEN length(text) > {LONG_TEXT} THEN 'md5:' || md5(text) ELSE text END"


@query("onehot_rare", " UNION ALL ".join(_slots_sql(*c) for c in (("lang", "lang"), ("source", "source"), ("text", _WHOLE_TEXT))))
def onehot_rare(spark, sf):
    """Whole columns: few languages and sources, and texts that are nearly all rare."""
    cols = ["lang", "source", "text"]
    return features.onehot_sums(table(spark, sf, "documents").select(*cols), cols)


@query(
    "prepare_summary",
    f"""WITH x AS (SELECT count(l_returnflag) AS n FROM {GAPPY_SQL}),
    m AS (SELECT count(*) AS c FROM {GAPPY_SQL} WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY 1 DESC LIMIT 1)
    SELECT 'train_rows' AS item, CAST(n - ceil(n * 0.2) AS DOUBLE) AS value FROM x UNION ALL SELECT 'test_rows', ceil(n * 0.2) FROM x
    UNION ALL SELECT 'classes', count(DISTINCT l_returnflag) FROM {GAPPY_SQL}
    UNION ALL SELECT 'numeric_columns', 8 + 6 UNION ALL SELECT 'text_columns', 1 UNION ALL SELECT 'dropped_columns', 0
    UNION ALL SELECT 'majority_ratio', round(c / n, 6) FROM x, m""",
)
def prepare_summary(spark, sf):
    prepared = prepare(gappy_lineitem(spark, sf), "l_returnflag", "classification")
    info = prepared.info
    fixed = [
        ("numeric_columns", float(len(info.num_cols))),
        ("text_columns", float(len(info.cat_cols))),
        ("dropped_columns", float(len(info.dropped.names) + len(info.leaks.names))),
        ("majority_ratio", round(info.majority_ratio, 6)),
    ]
    counts = prepared.data.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.concat("split", F.lit("_rows")).alias("item"), F.col("n").cast("double").alias("value"))
    classes = prepared.data.select("label").distinct().agg(F.count(F.lit(1)).cast("double").alias("value"))
    return (
        rows.unionByName(classes.select(F.lit("classes").alias("item"), "value"))
        .unionByName(local_frame(spark, fixed, "item string, value double"))
    )

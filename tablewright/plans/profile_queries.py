"""Registered queries: scans, types, profiles and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.dates import looks_like_datetime
from tablewright.functions.kinds import analyze_columns
from tablewright.operators import charts, profile
from tablewright.operators.cleaning import apply_type_casts, parse_dates
from tablewright.plans.tables import (
    CATALOG_SQL,
    COLUMNS,
    GAPPY_SQL,
    SIGNUPS_SQL,
    catalog_tables,
    gappy_lineitem,
    kind_of,
    profile_sql,
    signups,
    table,
)
from tablewright.sources.tables import read_table
from tablewright.session import local_frame

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# ------------------------------------------------------------------- scans


@query("read_parquet_count", "SELECT count(*) AS rows FROM lineitem")
def read_parquet_count(spark, sf):
    return read_table(spark, f"{sf}/lineitem.parquet").agg(F.count(F.lit(1)).alias("rows"))


@query("shape", "SELECT count(*) AS rows, 11 AS cols FROM lineitem")
def shape(spark, sf):
    return profile.table_shape(table(spark, sf, "lineitem"))


# ------------------------------------------------------------------- types


def _groups_sql():
    groups = {"num": "num_cols", "date": "date_cols", "text": "cat_cols"}
    rows = []
    for c, t in COLUMNS["signups"].items():
        group = "date_cols" if c == "signup_date" else groups[kind_of(t)]
        rows.append(f"SELECT '{c}' AS name, '{group}' AS \"group\", count({c}) AS present FROM {SIGNUPS_SQL}")
    return " UNION ALL ".join(rows)


@query("column_groups", _groups_sql())
def column_groups(spark, sf):
    df = signups(spark, sf)
    rows = [(c, g) for g, cols in analyze_columns(df).items() for c in cols]
    present = profile.long_form(
        df.agg(*[F.count(c).alias(c) for c in df.columns]), {c: {"present": c} for c in df.columns}
    )
    return F.broadcast(local_frame(spark, rows, "name string, group string")).join(present, "name")


@query(
    "datetime_parse_rate",
    """SELECT round(avg(CASE WHEN TRY_CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) IS NOT NULL THEN 1 ELSE 0 END), 6) AS ts_rate,
    round(avg(CASE WHEN TRY_CAST(event_type AS TIMESTAMP) IS NOT NULL THEN 1 ELSE 0 END), 6) AS type_rate,
    round(avg(CASE WHEN TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE strftime(ts, '%-m/%-d/%Y') END AS VARCHAR) LIKE '%/%'
      THEN 1 ELSE 0 END), 6) AS slash_rate FROM events""",
)
def datetime_parse_rate(spark, sf):
    ts = F.col("ts")
    slash = F.concat_ws("/", F.month(ts), F.dayofmonth(ts), F.year(ts))
    mixed = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(slash)

    def rate(c):
        return F.round(F.avg(looks_like_datetime(c).cast("int")), 6)

    return table(spark, sf, "events").agg(
        rate(ts.cast("string")).alias("ts_rate"),
        rate(F.col("event_type")).alias("type_rate"),
        rate(mixed).alias("slash_rate"),
    )


@query(
    "promote_dates",
    f"SELECT customer_id, CAST(signup_date AS TIMESTAMP) AS signup_date, segment FROM {SIGNUPS_SQL}",
)
def promote_dates(spark, sf):
    return profile.promote_dates(signups(spark, sf).select("customer_id", "signup_date", "segment"))


@query(
    "type_casts",
    """SELECT event_id, value AS value_number, CAST(value AS VARCHAR) AS value_unchanged, user_id AS user_number,
    (event_id % 2) = 1 AS odd, event_type, CAST(user_id AS VARCHAR) AS user_text, CAST(NULL AS BIGINT) AS props FROM events""",
)
def type_casts(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.col("value").cast("string").alias("value_number"),
        F.col("value").cast("string").alias("value_unchanged"),
        F.col("user_id").cast("string").alias("user_number"),
        (F.col("event_id") % 2).alias("odd"),
        "event_type",
        F.col("user_id").alias("user_text"),
        "props",
    )
    casts = {
        "value_number": "Float64", "value_unchanged": "int", "user_number": "long", "odd": "bool",
        "event_type": "category", "user_text": "str", "props": "int", "event_id": "unknown", "absent": "int",
    }
    return apply_type_casts(df, [{"name": n, "to_dtype": t} for n, t in casts.items()])


@query(
    "parse_dates",
    """SELECT event_id, CASE WHEN event_id % 5 <> 1 THEN date_trunc('second', ts) END AS ts_text,
    CAST(NULL AS TIMESTAMP) AS event_type FROM events""",
)
def parse_dates_query(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_id") % 5 == 1, F.lit("10:30")).otherwise(stamp)
    df = table(spark, sf, "events").select("event_id", text.alias("ts_text"), "event_type")
    return parse_dates(df, ["ts_text", "event_type", "absent"])


# ---------------------------------------------------------------- profiles


def _each(columns, make):
    return " UNION ALL ".join(make(c) for c in columns)


@query(
    "missing_pct",
    _each(
        COLUMNS["lineitem"],
        lambda c: f"SELECT '{c}' AS name, round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct FROM {GAPPY_SQL}",
    ),
)
def missing_pct(spark, sf):
    return profile.missing_pct(gappy_lineitem(spark, sf))


@query(
    "missing_count",
    _each(COLUMNS["lineitem"], lambda c: f"SELECT '{c}' AS name, count(*) - count({c}) AS missing FROM {GAPPY_SQL}"),
)
def missing_count(spark, sf):
    return profile.missing_count(gappy_lineitem(spark, sf))


@query(
    "nunique",
    _each(COLUMNS["lineitem"], lambda c: f"SELECT '{c}' AS name, count(DISTINCT {c}) AS nunique FROM {GAPPY_SQL}"),
)
def nunique(spark, sf):
    return profile.nunique(gappy_lineitem(spark, sf))


def numeric_sql(c: str, source: str) -> str:
    points = ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS {n}" for n, p in profile.PERCENTILES.items())
    return (
        f"SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
        f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, {points} FROM {source}"
    )


LINE_NUMERIC = [c for c, t in COLUMNS["lineitem"].items() if kind_of(t) == "num"]
EVENT_NUMERIC = ["event_id", "user_id", "value"]


@query("numeric_summary", _each(LINE_NUMERIC, lambda c: numeric_sql(c, GAPPY_SQL)))
def numeric_summary(spark, sf):
    return profile.numeric_summary(gappy_lineitem(spark, sf))


def top_sql(c: str, source: str, k: int) -> str:
    return (
        f"SELECT * FROM (SELECT '{c}' AS name, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank, "
        f"CAST({c} AS VARCHAR) AS value, count(*) AS count, (SELECT count(DISTINCT {c}) FROM {source}) AS nunique "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}"
    )


@query("categorical_top10", _each(["segment", "signup_date", "full_name", "all_same"], lambda c: top_sql(c, SIGNUPS_SQL, 10)))
def categorical_top10(spark, sf):
    return profile.categorical_summary(signups(spark, sf))


@query(
    "text_top5",
    """WITH counts AS (SELECT text AS value, count(*) AS count FROM documents GROUP BY text),
    ranked AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rank FROM counts)
    SELECT 'text' AS name, rank, md5(value) AS value, count, (SELECT count(*) FROM counts) AS nunique FROM ranked WHERE rank <= 5""",
)
def text_top5(spark, sf):
    return profile.categorical_summary(table(spark, sf, "documents"), ["text"], 5).withColumn("value", F.md5("value"))


def _describe_sql():
    parts = []
    blank = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ["mean", "std", "min", "max", *profile.PERCENTILES])
    for c, t in COLUMNS["lineitem"].items():
        if kind_of(t) == "num":
            inner = numeric_sql(c, GAPPY_SQL)
            parts.append(
                'SELECT name, count, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, '
                f"CAST(NULL AS BIGINT) AS freq, mean, std, min, max, p05, p25, p50, p75, p95 FROM ({inner})"
            )
        else:
            parts.append(
                f"SELECT name, (SELECT count({c}) FROM {GAPPY_SQL}) AS count, nunique AS \"unique\", value AS top, "
                f"count AS freq, {blank} FROM ({top_sql(c, GAPPY_SQL, 1)})"
            )
    return " UNION ALL ".join(parts)


@query("describe_all", _describe_sql())
def describe_all(spark, sf):
    return profile.describe_all(gappy_lineitem(spark, sf))


PROFILE_COLUMNS = [
    "name", "pos", "dtype", "kind", "rows", "missing", "missing_pct", "nunique",
    "count", "mean", "std", "min", "max", *profile.PERCENTILES, "top_values",
]


def _profile_sql(name, source, columns, numeric):
    light = profile_sql(name, source, columns)
    numbers = _each(numeric, lambda c: numeric_sql(c, source))
    words = [c for c, t in columns.items() if kind_of(t) == "text"]
    tops = _each(words, lambda c: top_sql(c, source, 10))
    return f"""WITH light AS ({light}), numbers AS ({numbers}),
    tops AS (SELECT name, string_agg(value || '=' || count, ';' ORDER BY rank) AS top_values FROM ({tops}) GROUP BY name)
    SELECT l.name, pos, dtype, kind, rows, missing, round(missing * 100.0 / rows, 2) AS missing_pct, nunique,
    n.count, mean, std, min, max, p05, p25, p50, p75, p95, top_values
    FROM light l LEFT JOIN numbers n ON l.name = n.name LEFT JOIN tops t ON l.name = t.name"""


def flat_profile(df):
    """A profile with the top values as one text, for comparison by value."""
    pair = F.transform("top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string")))
    return profile.profile(df, promote=False).withColumn("top_values", F.array_join(pair, ";")).select(*PROFILE_COLUMNS)


@query("profile_lineitem", _profile_sql("lineitem", GAPPY_SQL, COLUMNS["lineitem"], LINE_NUMERIC))
def profile_lineitem(spark, sf):
    return flat_profile(gappy_lineitem(spark, sf))


@query("profile_events", _profile_sql("events", "events", COLUMNS["events"], EVENT_NUMERIC))
def profile_events(spark, sf):
    return flat_profile(table(spark, sf, "events"))


@query(
    "column_kind_counts",
    f"""SELECT "table", count(*) FILTER (dtype IN ('bigint', 'int', 'double', 'float')) AS numeric_columns,
    count(*) FILTER (dtype = 'string') AS categorical_columns, sum(missing)::BIGINT AS missing
    FROM ({CATALOG_SQL}) GROUP BY "table" """,
)
def column_kind_counts(spark, sf):
    return profile.kind_counts(profile.catalog_profile(catalog_tables(spark, sf)), ["table"])


# ---------------------------------------------------------------- chart data


@query(
    "histogram",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n
      FROM lineitem, s GROUP BY 1)
    SELECT CAST(b AS INTEGER) AS bin, round(lo + (b + 0.5) * ((hi - lo) / 30), 6) AS center, coalesce(n, 0) AS count
    FROM range(30) r(b) CROSS JOIN s LEFT JOIN c ON c.bin = r.b""",
)
def histogram(spark, sf):
    return charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)


@query(
    "box_stats",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT q1, median, q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
    max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM events, q GROUP BY q1, median, q3""",
)
def box_stats(spark, sf):
    return charts.box_stats(table(spark, sf, "events"), "value")


def _bucket(name, unit, code):
    sql = f"SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS bucket, count(*) AS count FROM events GROUP BY 1"
    query(name, sql)(lambda spark, sf: charts.time_bucket_counts(table(spark, sf, "events"), "ts", code))


_bucket("events_per_day", "day", "D")
_bucket("events_per_week", "week", "W")
_bucket("events_per_month", "month", "M")


@query(
    "top_k_categories",
    "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 20",
)
def top_k_categories(spark, sf):
    return charts.top_k(table(spark, sf, "part"), "p_brand", 20)


@query(
    "target_distribution",
    """SELECT CAST(quality AS VARCHAR) AS value, count(*) AS count, (SELECT count(DISTINCT quality) FROM labels) AS unique_values,
    (SELECT count(quality) FROM labels) AS samples FROM labels GROUP BY quality""",
)
def target_distribution(spark, sf):
    return charts.target_distribution(table(spark, sf, "labels"), "quality")


def _balance(name, source, col):
    sql = f"""WITH c AS (SELECT CAST({col} AS VARCHAR) AS label, count(*) AS count FROM {source} GROUP BY 1)
    SELECT label, count, round(max(count) OVER () / sum(count) OVER (), 6) AS majority_ratio,
    max(count) OVER () / sum(count) OVER () >= 0.8 AS is_imbalanced FROM c"""
    query(name, sql)(lambda spark, sf: charts.class_balance(table(spark, sf, source), col))


_balance("class_balance", "labels", "quality")
_balance("class_balance_orders", "orders", "o_orderstatus")


@query(
    "recommend_task",
    """SELECT 'l_extendedprice' AS target, count(DISTINCT l_extendedprice) AS unique_values, count(*) AS samples,
    CASE WHEN count(DISTINCT l_extendedprice) > 20 AND count(DISTINCT l_extendedprice) > 0.05 * count(*) THEN 'regression' ELSE 'classification' END AS task,
    CASE WHEN count(DISTINCT l_extendedprice) > 20 AND count(DISTINCT l_extendedprice) > 0.05 * count(*) THEN 'numeric_many_values' ELSE 'numeric_few_values' END AS reason
    FROM lineitem
    UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity), count(*), 'classification', 'numeric_few_values' FROM lineitem
    UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), count(*), 'classification', 'not_numeric' FROM lineitem""",
)
def recommend_task(spark, sf):
    df = table(spark, sf, "lineitem")
    parts = [
        charts.recommend_task(df, c).withColumn("target", F.lit(c))
        for c in ("l_extendedprice", "l_quantity", "l_returnflag")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])



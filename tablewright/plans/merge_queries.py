"""Registered queries: row selection, stacking and joining."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import merge, sampling
from tablewright.operators.profile import long_form
from tablewright.plans.tables import GAPPY_SQL, gappy_lineitem, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# ----------------------------------------------------------- row selection


@query("drop_columns", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
def drop_columns(spark, sf):
    return sampling.drop_columns(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate", "absent"])


@query(
    "drop_null_target",
    f"SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM {GAPPY_SQL} WHERE l_quantity IS NOT NULL",
)
def drop_null_target(spark, sf):
    df = sampling.drop_null_target(gappy_lineitem(spark, sf), "l_quantity")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")


@query(
    "keep_frequent_values",
    """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
    WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30)""",
)
def keep_frequent_values(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return sampling.keep_frequent(df, "l_partkey", 30)


@query("head_n", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def head_n(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    negative = df.withColumn("down", -F.col("o_totalprice"))
    return sampling.head(negative, 100, ["down", "o_orderkey"]).drop("down")


@query(
    "sample_exact",
    """SELECT least(count(*), 5000) AS rows, least(count(*), 5000) AS distinct_keys, least(count(*), 5000) AS known_keys FROM orders""",
)
def sample_exact(spark, sf):
    orders = table(spark, sf, "orders")
    sample = sampling.sample_rows(orders, 5000, key=["o_orderkey"])
    known = sample.join(orders.select("o_orderkey"), "o_orderkey", "left_semi")
    # Each is a single row.
    counts = sample.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("distinct_keys"))
    rows = [
        counts.select(F.lit("rows").alias("k"), F.col("rows").alias("v")),
        counts.select(F.lit("distinct_keys"), "distinct_keys"),
        known.agg(F.count(F.lit(1)).alias("v")).select(F.lit("known_keys"), "v"),
    ]
    long = rows[0].union(rows[1]).union(rows[2])
    return long.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("rows", "distinct_keys", "known_keys")])


@query(
    "eval_limit",
    "SELECT least(500, CAST(ceil(count(*) * 0.2) AS BIGINT)) AS rows, 'test' AS split FROM orders",
)
def eval_limit(spark, sf):
    split = sampling.train_test_split(table(spark, sf, "orders"), "o_totalprice", key=["o_orderkey"], stratify=False)
    limited = sampling.eval_limit(split.where(F.col("split") == "test"), 500, ["o_orderkey"])
    return limited.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stratified_split",
    """WITH c AS (SELECT o_orderpriority AS class, count(*) AS n FROM orders GROUP BY 1),
    t AS (SELECT sum(n) AS total, sum(n) - CAST(ceil(sum(n) * 0.2) AS BIGINT) AS n_train FROM c),
    s AS (SELECT class, n, n_train, floor(n * n_train / total) AS base, n * n_train / total - floor(n * n_train / total) AS rest FROM c, t),
    p AS (SELECT *, row_number() OVER (ORDER BY rest DESC, class) AS place, n_train - sum(base) OVER () AS missing FROM s)
    SELECT class, n, CAST(base + CASE WHEN place <= missing THEN 1 ELSE 0 END AS BIGINT) AS train,
    CAST(n - base - CASE WHEN place <= missing THEN 1 ELSE 0 END AS BIGINT) AS test FROM p""",
)
def stratified_split(spark, sf):
    split = sampling.train_test_split(table(spark, sf, "orders"), "o_orderpriority", key=["o_orderkey"])
    return split.groupBy(F.col("o_orderpriority").alias("class")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
    )


@query(
    "split_repeated_rows",
    """WITH t AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS test FROM lineitem)
    SELECT 'test' AS split, test AS rows FROM t UNION ALL SELECT 'train', n - test FROM t""",
)
def split_repeated_rows(spark, sf):
    """Few different rows, each many times, and no other key than the row."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    split = sampling.train_test_split(rows, "l_returnflag", stratify=False)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "folds_repeated_rows",
    """SELECT CAST(f AS INTEGER) AS fold, ((f + 1) * n) // 5 - (f * n) // 5 AS rows
    FROM (SELECT count(*) AS n FROM lineitem), range(5) AS r(f)""",
)
def folds_repeated_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return sampling.assign_folds(rows, 5).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "can_stratify",
    """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'l_partkey' AS target, count(*) AS classes, sum(n)::BIGINT AS rows, min(n) AS smallest,
      min(n) >= 2 AND floor(sum(n) * 0.2) >= count(*) AS possible FROM c
    UNION ALL SELECT 'o_orderstatus', count(*), sum(n)::BIGINT, min(n), min(n) >= 2 AND floor(sum(n) * 0.2) >= count(*) FROM d""",
)
def can_stratify(spark, sf):
    parts = []
    for name, target in (("lineitem", "l_partkey"), ("orders", "o_orderstatus")):
        counts = sampling.class_counts(table(spark, sf, name), target)
        totals = counts.df.agg(
            F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"), F.min("n").alias("smallest")
        )
        parts.append(
            totals.withColumns({"target": F.lit(target), "possible": F.lit(sampling.can_stratify(counts))})
        )
    return parts[0].unionByName(parts[1])


@query(
    "fold_counts",
    """SELECT o_orderpriority AS class, count(*) AS n, 5 AS folds, count(*) // 5 AS smallest, (count(*) + 4) // 5 AS largest
    FROM orders GROUP BY 1""",
)
def fold_counts(spark, sf):
    folds = sampling.assign_folds(table(spark, sf, "orders"), 5, "o_orderpriority", key=["o_orderkey"])
    sizes = folds.groupBy(F.col("o_orderpriority").alias("class"), "fold").agg(F.count(F.lit(1)).alias("c"))
    return sizes.groupBy("class").agg(
        F.sum("c").alias("n"),
        F.count(F.lit(1)).cast("int").alias("folds"),
        F.min("c").alias("smallest"),
        F.max("c").alias("largest"),
    )


# ------------------------------------------------------------------- merging


def _slices(spark, sf):
    """orders as three uploads, one per status, that share four columns."""
    orders = table(spark, sf, "orders")
    shared = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    return {
        "open.csv": orders.where(F.col("o_orderstatus") == "O").select(*shared, "o_orderpriority"),
        "filled.csv": orders.where(F.col("o_orderstatus") == "F").select("o_orderstatus", *shared),
        "pending.csv": orders.where(F.col("o_orderstatus") == "P").select(*reversed(shared)),
    }


@query(
    "vertical_stack",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
    CASE o_orderstatus WHEN 'O' THEN 'open.csv' WHEN 'F' THEN 'filled.csv' ELSE 'pending.csv' END AS _source_file FROM orders""",
)
def vertical_stack(spark, sf):
    return merge.vertical_stack(_slices(spark, sf))


_SHARED = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
_COLUMNS = {
    "open.csv": ("O", [*_SHARED, "o_orderpriority"]),
    "filled.csv": ("F", ["o_orderstatus", *_SHARED]),
    "pending.csv": ("P", _SHARED),
}


@query(
    "common_columns",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS name, {c in _SHARED} AS is_common, count({c}) AS present
        FROM orders WHERE o_orderstatus = '{status}'"""
        for t, (status, cols) in _COLUMNS.items()
        for c in cols
    ),
)
def common_columns(spark, sf):
    slices = _slices(spark, sf)
    shared = merge.common_columns(slices)
    parts = []
    for name, df in slices.items():
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        cells = {c: {"is_common": str(c in shared), "present": c} for c in df.columns}
        parts.append(long_form(counts, cells).withColumn("table", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _uploads(spark, sf, gaps: bool = False):
    """customer, orders and events as uploads that share ``custkey``."""
    customer, orders, events = (table(spark, sf, n) for n in ("customer", "orders", "events"))
    c, o = F.col("c_custkey"), F.col("o_custkey")
    if gaps:
        c, o = F.when(c % 11 != 0, c), F.when(F.col("o_orderkey") % 7 != 0, o)
    return {
        "data/customer.csv": customer.select("c_custkey", c.alias("custkey"), "c_name", "c_mktsegment"),
        "data/orders.csv": orders.select(o.alias("custkey"), "o_orderkey", "o_totalprice"),
        "data/events.csv": events.select(F.col("user_id").alias("custkey"), "event_id", "value"),
    }


ORDERS = {"data/customer.csv": ["c_custkey"], "data/orders.csv": ["o_orderkey"], "data/events.csv": ["event_id"]}


def _join_sql(how: str, gaps: bool = False) -> str:
    c = "CASE WHEN c_custkey % 11 <> 0 THEN c_custkey END" if gaps else "c_custkey"
    o = "CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END" if gaps else "o_custkey"
    word = {"outer": "FULL OUTER", "inner": "INNER", "left": "LEFT"}[how]

    def first(key, cols, source, order):
        return (
            f"(SELECT * EXCLUDE (rn) FROM (SELECT {key} AS k, {cols}, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1)"
        )

    a = first(c, "c_custkey, c_name, c_mktsegment", "customer", "c_custkey")
    b = first(o, "o_orderkey, o_totalprice", "orders", "o_orderkey")
    e = first("user_id", "event_id, value", "events", "event_id")
    key_ab, key = ("coalesce(a.k, b.k)", "coalesce(ab.k, e.k)") if how == "outer" else ("a.k", "ab.k")
    return f"""WITH a AS {a}, b AS {b}, e AS {e},
    ab AS (SELECT {key_ab} AS k, a.* EXCLUDE (k), b.* EXCLUDE (k) FROM a {word} JOIN b ON a.k IS NOT DISTINCT FROM b.k)
    SELECT {key} AS custkey, c_custkey AS customer__c_custkey, c_name AS customer__c_name, c_mktsegment AS customer__c_mktsegment,
    o_orderkey AS orders__o_orderkey, o_totalprice AS orders__o_totalprice, event_id AS events__event_id, value AS events__value
    FROM ab {word} JOIN e ON ab.k IS NOT DISTINCT FROM e.k"""


def _join(name, how, gaps=False):
    query(name, _join_sql(how, gaps))(
        lambda spark, sf: merge.horizontal_join(_uploads(spark, sf, gaps), how, order_by=ORDERS)
    )


_join("hjoin_inner", "inner")
_join("hjoin_left", "left")
_join("hjoin_outer", "outer")
_join("hjoin_outer_null_keys", "outer", True)


@query(
    "hjoin_repeated_keys",
    """WITH c AS (SELECT CASE WHEN c_custkey NOT IN (3, 103) THEN c_custkey END AS k, c_name FROM customer),
    o AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS k, o_orderkey FROM orders)
    SELECT coalesce(c.k, o.k) AS custkey, c_name, o_orderkey FROM c FULL OUTER JOIN o ON c.k IS NOT DISTINCT FROM o.k""",
)
def hjoin_repeated_keys(spark, sf):
    """Two customers have no key, at any size, so that the rows without one do not multiply."""
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    tables = {
        "customer": customer.select(F.when(~F.col("c_custkey").isin(3, 103), F.col("c_custkey")).alias("custkey"), "c_name"),
        "orders": orders.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("custkey"), "o_orderkey"),
    }
    return merge.horizontal_join(tables, "outer", prefix=False, dedupe=False)


@query(
    "dedupe_first",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_first(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return merge.dedupe_keys(df, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_extendedprice"])


@query(
    "duplicate_key_count",
    "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem",
)
def duplicate_key_count(spark, sf):
    return merge.duplicate_key_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])



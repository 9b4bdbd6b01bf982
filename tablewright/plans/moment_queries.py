"""Registered queries: correlations, principal components, lasso and hashed features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.hashing import bucket_sums, collisions
from tablewright.operators.importance import permutation_importance, permute_column
from tablewright.operators.moments import correlation_matrix, lasso_path, principal_components
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


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey")


def _pairs_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM {source}"
        for a in _NUMBERS for b in _NUMBERS
    )


@query("correlation_matrix", _pairs_sql(GAPPY_SQL))
def correlations(spark, sf):
    return correlation_matrix(gappy_lineitem(spark, sf), _NUMBERS).withColumn("corr", F.round("corr", 6))


_RANKS = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE END AS {c}" for c in _NUMBERS
)


@query("spearman_matrix", f"WITH r AS (SELECT {_RANKS} FROM {GAPPY_SQL}) {_pairs_sql('r')}")
def rank_correlations(spark, sf):
    return correlation_matrix(gappy_lineitem(spark, sf), _NUMBERS, "spearman").withColumn("corr", F.round("corr", 6))


@query(
    "pca_axes",
    f"""WITH t AS (SELECT l_quantity AS x, l_extendedprice / 1000.0::DOUBLE AS y FROM {GAPPY_SQL} WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
    c AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM t),
    v AS (SELECT 1 AS k, *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b ** 2) AS v FROM c
      UNION ALL SELECT 2, *, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b ** 2) FROM c),
    w AS (SELECT k, v, v / (a + d) AS share, b / sqrt(b ** 2 + (v - a) ** 2) AS x, (v - a) / sqrt(b ** 2 + (v - a) ** 2) AS y FROM v),
    s AS (SELECT *, CASE WHEN abs(round(x, 9)) >= abs(round(y, 9)) THEN sign(x) ELSE sign(y) END AS s FROM w)
    SELECT k::INTEGER AS component, 'l_quantity' AS "column", round(s * x, 6) AS weight, round(v, 4) AS variance, round(share, 6) AS share FROM s
    UNION ALL SELECT k, 'price', round(s * y, 6), round(v, 4), round(share, 6) FROM s""",
)
def pca_axes(spark, sf):
    rows = gappy_lineitem(spark, sf).withColumn("price", F.col("l_extendedprice") / 1000)
    found = principal_components(rows, ["l_quantity", "price"]).table(spark)
    return found.withColumns({"weight": F.round("weight", 6), "variance": F.round("variance", 4), "share": F.round("share", 6)})


#: Penalties as shares of the target's standard deviation.
_PENALTIES = (0.9, 0.4, 0.1, 0.001)


@query(
    "lasso_orthogonal",
    f"""WITH f AS (SELECT regr_slope(l_tax, l_quantity) AS m, regr_intercept(l_tax, l_quantity) AS i FROM lineitem),
    t AS (SELECT l_quantity AS a, l_tax - (m * l_quantity + i) AS b,
      l_extendedprice / 1000.0::DOUBLE + 2 * l_quantity + 300 * l_tax AS y FROM lineitem, f),
    s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(y) AS sy, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb,
      avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t),
    w AS (SELECT p, s.*, sign(ca) * greatest(abs(ca / sa) - p * sy, 0) / sa AS wa, sign(cb) * greatest(abs(cb / sb) - p * sy, 0) / sb AS wb
      FROM s, (VALUES {", ".join(f"({p}::DOUBLE)" for p in _PENALTIES)}) v(p))
    SELECT p AS share, round(wa, 6) + 0 AS quantity, round(wb, 4) + 0 AS rest, round(my - wa * ma - wb * mb, 5) AS intercept FROM w""",
)
def lasso_orthogonal(spark, sf):
    """Two columns without correlation: the second is what a line through the first leaves of the tax."""
    lines = table(spark, sf, "lineitem")
    y = F.col("l_extendedprice") / 1000 + 2 * F.col("l_quantity") + 300 * F.col("l_tax")
    fit = lines.agg(F.regr_slope("l_tax", "l_quantity"), F.regr_intercept("l_tax", "l_quantity"), F.stddev_pop(y)).first()
    rows = lines.select(
        F.col("l_quantity").alias("a"),
        (F.col("l_tax") - (F.lit(fit[0]) * F.col("l_quantity") + F.lit(fit[1]))).alias("b"),
        y.alias("y"),
    )
    path = lasso_path(rows, ["a", "b"], "y", [p * fit[2] for p in _PENALTIES])
    found = [
        (p, round(s.coefficients[0], 6) + 0.0, round(s.coefficients[1], 4) + 0.0, round(s.intercept, 5)) for p, s in zip(_PENALTIES, path, strict=True)
    ]
    return local_frame(spark, found, "share double, quantity double, rest double, intercept double")


_HASHED = ("c_name", "c_mktsegment", "c_nationkey")


def _hashed_sql(buckets: int) -> str:
    texts = " UNION ALL ".join(f"SELECT '{c}' AS name, '{c}=' || {c} AS token, {c} AS value, 1.0::DOUBLE AS amount, c_custkey FROM customer WHERE {c} IS NOT NULL" for c in _HASHED[:2])
    number = "SELECT 'c_nationkey', 'c_nationkey', NULL, c_nationkey::DOUBLE, c_custkey FROM customer WHERE c_nationkey IS NOT NULL"
    return f"""h AS (SELECT *, ('0x' || substr(md5(token), 1, 12))::BIGINT % {buckets} AS bucket,
      CASE WHEN ('0x' || substr(md5(token), 13, 1))::BIGINT < 8 THEN 1 ELSE -1 END * amount AS v FROM ({texts} UNION ALL {number}))"""


@query(
    "hashed_bucket_sums",
    f"""WITH {_hashed_sql(512)}, r AS (SELECT c_custkey, bucket, sum(v) AS v FROM h GROUP BY ALL HAVING sum(v) <> 0)
    SELECT bucket::INTEGER AS bucket, count(*) AS rows, sum(v) AS total FROM r GROUP BY bucket""",
)
def hashed_bucket_sums(spark, sf):
    return bucket_sums(table(spark, sf, "customer"), _HASHED, 512)


@query(
    "hashed_collisions",
    f"""WITH {_hashed_sql(512)}, k AS (SELECT DISTINCT name, value, bucket FROM h),
    c AS (SELECT bucket FROM k GROUP BY bucket HAVING count(*) > 1)
    SELECT name AS "column", count(*) AS "values", count(DISTINCT bucket) AS buckets,
      count(*) FILTER (WHERE bucket IN (SELECT bucket FROM c)) AS shared FROM k GROUP BY name""",
)
def hashed_collisions(spark, sf):
    return collisions(table(spark, sf, "customer"), _HASHED, 512)


@query(
    "permutation_importance",
    """SELECT * FROM (VALUES ('c_nationkey', 0.0::DOUBLE, 0.0::DOUBLE), ('flat', 0.0::DOUBLE, 0.0::DOUBLE)) v("column", importance, baseline)
    UNION ALL SELECT 'c_acctbal', 1.0, 0.0""",
)
def importance(spark, sf):
    """A rule that reads one column: that one counts, an unused and a constant one score exactly 0."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lit(1).alias("flat"), F.col("c_acctbal").alias("y"))

    def measure(df):
        return -df.agg(F.avg(F.abs(F.col("c_acctbal") + F.col("flat") - 1 - F.col("y")))).first()[0]

    found = permutation_importance(rows, ["c_nationkey", "flat", "c_acctbal"], measure, ["c_custkey"], repeats=1)
    # How much it counts depends on the permutation; that it does, does not.
    return found.select("column", F.signum(F.round("importance", 6)).alias("importance"), F.round(F.abs("baseline"), 6).alias("baseline"))


@query(
    "permuted_values",
    """SELECT c_nationkey AS value, count(*) AS rows FROM customer GROUP BY 1""",
)
def permuted_values(spark, sf):
    """A permuted column keeps its value counts."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return permute_column(rows, "c_nationkey", ["c_custkey"], 5).groupBy(F.col("c_nationkey").alias("value")).agg(F.count(F.lit(1)).alias("rows"))

"""Registered queries: categories encoded by the target."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.target_encoding import encode_out_of_fold, fit_target_means
from tablewright.plans.tables import GAPPY_SQL, gappy_lineitem

QUERIES, ORACLES = {}, {}

_CATEGORIES = ("l_returnflag", "l_linestatus", "l_suppkey")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _lines(spark, sf):
    """lineitem with gaps, a price in thousands that is missing now and then, and a fold by order."""
    price = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice") / 1000)
    return gappy_lineitem(spark, sf).withColumns({"price": price, "fold": F.col("l_orderkey") % 5})


_LINES_SQL = f"""t AS (SELECT *, l_orderkey % 5 AS fold,
      CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice / 1000.0::DOUBLE END AS price FROM {GAPPY_SQL})"""


def _other_folds(c: str) -> str:
    return f"""(SELECT c.c, f.fold, CASE WHEN c.n - coalesce(p.n, 0) > 0
        THEN (c.s - coalesce(p.s, 0) + 20 * f.prior) / (c.n - coalesce(p.n, 0) + 20) ELSE f.prior END AS v
      FROM (SELECT {c}::VARCHAR AS c, count(price) AS n, coalesce(sum(price), 0) AS s FROM t GROUP BY 1) c
      CROSS JOIN prior f
      LEFT JOIN (SELECT {c}::VARCHAR AS c, fold, count(price) AS n, coalesce(sum(price), 0) AS s FROM t GROUP BY 1, 2) p
        ON p.c IS NOT DISTINCT FROM c.c AND p.fold = f.fold)"""


_OUT_SQL = f"""WITH {_LINES_SQL},
    whole AS (SELECT count(price) AS n, sum(price) AS s FROM t),
    prior AS (SELECT fold, (any_value(whole.s) - sum(price)) / (any_value(whole.n) - count(price)) AS prior FROM t, whole GROUP BY fold)
    SELECT l_orderkey, l_linenumber, {", ".join(f"round({c[2:]}.v, 6) AS {c}_te" for c in _CATEGORIES)} FROM t
    {" ".join(f"JOIN {_other_folds(c)} {c[2:]} ON {c[2:]}.c IS NOT DISTINCT FROM t.{c}::VARCHAR AND {c[2:]}.fold = t.fold" for c in _CATEGORIES)}"""


@query("target_encoding_out_of_fold", _OUT_SQL)
def target_encoding_out_of_fold(spark, sf):
    out = encode_out_of_fold(_lines(spark, sf), _CATEGORIES, "price", "fold")
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"{c}_te", 6).alias(f"{c}_te") for c in _CATEGORIES])


@query(
    "target_means",
    f"""WITH {_LINES_SQL}, m AS (SELECT avg(price) AS m FROM t WHERE fold <> 0),
    {", ".join(f"c{i} AS (SELECT {c}::VARCHAR AS c, (sum(price) + 20 * any_value(m)) / (count(price) + 20) AS v FROM t, m WHERE fold <> 0 AND price IS NOT NULL GROUP BY 1)" for i, c in enumerate(_CATEGORIES))}
    SELECT l_orderkey, l_linenumber, {", ".join(f"round(coalesce(c{i}.v, m), 6) AS {c}_te" for i, c in enumerate(_CATEGORIES))}
    FROM t CROSS JOIN m {" ".join(f"LEFT JOIN c{i} ON c{i}.c IS NOT DISTINCT FROM t.{c}::VARCHAR" for i, c in enumerate(_CATEGORIES))}
    WHERE fold = 0""",
)
def target_means(spark, sf):
    """Means of four folds given to the fifth."""
    lines = _lines(spark, sf)
    model = fit_target_means(lines.where("fold <> 0"), _CATEGORIES, "price")
    out = model.transform(lines.where("fold = 0"))
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"{c}_te", 6).alias(f"{c}_te") for c in _CATEGORIES])

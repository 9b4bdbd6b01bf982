"""Registered queries: k-means, mixtures, indices of clusters and single linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.cluster import cluster_indices, elbow, fit_k_means, fit_mixture
from tablewright.operators.linkage import cluster_sizes, merge_heights, near_forest, single_linkage
from tablewright.plans.tables import table
from tablewright.session import local_frame

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _places(spark, sf):
    """customer as points in the plane, with the market segment as a given cluster."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_acctbal") / 1000).alias("x"),
        (F.col("c_custkey") * 7919 % 1009 / 100).alias("y"),
        F.col("c_mktsegment").alias("g"),
    )


_PLACES_SQL = """p AS (SELECT c_custkey AS id, c_acctbal / 1000.0::DOUBLE AS x, (c_custkey * 7919 % 1009) / 100.0::DOUBLE AS y,
      c_mktsegment AS g FROM customer)"""


@query(
    "cluster_indices",
    f"""WITH {_PLACES_SQL},
    d AS (SELECT a.id, a.g, b.g AS other, avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
    s AS (SELECT id, coalesce(max(gap) FILTER (WHERE other = g), 0) AS a, min(gap) FILTER (WHERE other <> g) AS b FROM d GROUP BY id),
    c AS (SELECT g, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY g),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM p),
    r AS (SELECT g, sum((x - cx) ** 2 + (y - cy) ** 2) AS w, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS gap FROM p JOIN c USING (g) GROUP BY g),
    db AS (SELECT i.g, max((ri.gap + rj.gap) / sqrt((i.cx - j.cx) ** 2 + (i.cy - j.cy) ** 2)) AS worst
      FROM c i JOIN c j ON i.g <> j.g JOIN r ri ON ri.g = i.g JOIN r rj ON rj.g = j.g GROUP BY i.g)
    SELECT m.n AS rows, (SELECT count(*) FROM c) AS clusters, round((SELECT sum(w) FROM r), 4) AS inertia,
      round((SELECT avg((b - a) / greatest(a, b)) FROM s), 6) AS silhouette,
      round((SELECT sum(c.n * ((cx - mx) ** 2 + (cy - my) ** 2)) FROM c) / ((SELECT count(*) FROM c) - 1)
        / ((SELECT sum(w) FROM r) / (m.n - (SELECT count(*) FROM c))), 6) AS calinski_harabasz,
      round((SELECT avg(worst) FROM db), 6) AS davies_bouldin FROM m""",
)
def indices(spark, sf):
    found = cluster_indices(_places(spark, sf), ["x", "y"], "g")
    rounded = {c: F.round(c, 4 if c == "inertia" else 6) for c in ("inertia", "silhouette", "calinski_harabasz", "davies_bouldin")}
    return found.withColumns(rounded)


#: Numbers of centres, and rounds.
_KS, _ROUNDS = (1, 2, 3, 4, 5), 4


def _k_means_sql() -> str:
    """Farthest-first starts and rounds written out, for each k: final centres in ``f<k>`` (n, x, y)."""
    gap = "(p.x - c.x) ** 2 + (p.y - c.y) ** 2"
    parts = [_PLACES_SQL, "c1 AS (SELECT x, y FROM p ORDER BY (x - (SELECT avg(x) FROM p)) ** 2 + (y - (SELECT avg(y) FROM p)) ** 2, x DESC, y DESC LIMIT 1)"]
    for k in range(2, max(_KS) + 1):
        before = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(1, k))
        parts.append(
            f"c{k} AS (SELECT x, y FROM (SELECT p.id, p.x, p.y, min({gap}) AS d FROM p CROSS JOIN ({before}) c GROUP BY ALL) ORDER BY d DESC, x DESC, y DESC LIMIT 1)"
        )
    for k in _KS:
        first = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(1, k + 1))
        parts.append(f"r{k}_0 AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS n, x, y FROM ({first}))")
        for r in range(1, _ROUNDS + 1):
            near = f"SELECT p.id, p.x, p.y, c.n FROM p CROSS JOIN r{k}_{r - 1} c QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {gap}, c.n) = 1"
            parts.append(f"r{k}_{r} AS (SELECT o.n, coalesce(avg(a.x), any_value(o.x)) AS x, coalesce(avg(a.y), any_value(o.y)) AS y FROM r{k}_{r - 1} o LEFT JOIN ({near}) a ON a.n = o.n GROUP BY o.n)")
        parts.append(f"i{k} AS (SELECT {k} AS k, sum(d) AS inertia FROM (SELECT p.id, min({gap}) AS d FROM p CROSS JOIN r{k}_{_ROUNDS} c GROUP BY p.id))")
    return ", ".join(parts)


_ALL_K = " UNION ALL ".join(f"SELECT * FROM i{k}" for k in _KS)
_ENDS = "first_value(inertia) OVER w AS high, last_value(inertia) OVER w AS low"


@query(
    "kmeans_elbow",
    f"""WITH {_k_means_sql()},
    b AS (SELECT *, 1 - (k - {_KS[0]}) / {_KS[-1] - _KS[0]}.0::DOUBLE - (inertia - low) / (high - low) AS bend
      FROM (SELECT k, inertia, {_ENDS} FROM ({_ALL_K})
        WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
    SELECT k::INTEGER AS k, round(inertia, 4) AS inertia, round(bend, 6) AS bend, k = arg_max(k, bend) OVER () AS chosen FROM b""",
)
def kmeans_elbow(spark, sf):
    found = elbow(_places(spark, sf), ["x", "y"], _KS, rounds=_ROUNDS)
    return found.select("k", F.round("inertia", 4).alias("inertia"), F.round("bend", 6).alias("bend"), "chosen")


@query(
    "kmeans_centres",
    f"""WITH {_k_means_sql()},
    a AS (SELECT p.id, c.n, (p.x - c.x) ** 2 + (p.y - c.y) ** 2 AS d FROM p CROSS JOIN r4_{_ROUNDS} c
      QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d, c.n) = 1)
    SELECT c.n::INTEGER AS cluster, round(c.x, 6) AS x, round(c.y, 6) AS y, count(a.id) AS rows, round(sum(d), 4) AS inertia
    FROM r4_{_ROUNDS} c LEFT JOIN a USING (n) GROUP BY ALL""",
)
def kmeans_centres(spark, sf):
    """Centres, and the sizes of the clusters by the labels given to the rows."""
    places = _places(spark, sf)
    model = fit_k_means(places, ["x", "y"], 4, rounds=_ROUNDS)
    centres = local_frame(spark, [(i, *c) for i, c in enumerate(model.centres)], "cluster int, cx double, cy double")
    gap = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    labelled = model.transform(places).join(F.broadcast(centres), "cluster")  # four centres
    return labelled.groupBy("cluster").agg(
        F.round(F.first("cx"), 6).alias("x"), F.round(F.first("cy"), 6).alias("y"), F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(gap), 4).alias("inertia"),
    )


#: Starting means of the two components, and rounds.
_STARTS, _EM_ROUNDS = (2.0, 7.0), 4


def _mixture_sql() -> str:
    """Rounds of expectation maximisation in one dimension written out; the parameters after round r are ``m<r>`` (k, w, m, v)."""
    density = "w * exp(-0.5 * (x - m) ** 2 / v) / sqrt(2 * pi() * v)"
    starts = " UNION ALL ".join(f"SELECT {k} AS k, {1 / len(_STARTS)}::DOUBLE AS w, {m}::DOUBLE AS m, v + 1e-6 * v AS v FROM t" for k, m in enumerate(_STARTS))
    parts = [_PLACES_SQL, "t AS (SELECT var_pop(x) AS v FROM p)", f"m0 AS ({starts})"]
    for r in range(1, _EM_ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT id, x, k, m, {density} AS d FROM p CROSS JOIN m{r - 1})")
        parts.append(f"s{r} AS (SELECT *, d / sum(d) OVER (PARTITION BY id) AS s FROM d{r})")
        parts.append(
            f"m{r} AS (SELECT k, sum(s) / (SELECT count(*) FROM p) AS w, sum(s * x) / sum(s) AS m, "
            f"sum(s * (x - m) ** 2) / sum(s) - (sum(s * (x - m)) / sum(s)) ** 2 + 1e-6 * (SELECT v FROM t) AS v FROM s{r} GROUP BY k)"
        )
        parts.append(f"l{r} AS (SELECT avg(l) AS l FROM (SELECT id, ln(sum(d)) AS l FROM d{r} GROUP BY id))")
    return ", ".join(parts)


@query(
    "mixture_components",
    f"""WITH {_mixture_sql()}
    SELECT k::INTEGER AS component, round(w, 6) AS weight, round(m, 6) AS mean, round(v, 6) AS variance, round(l, 6) AS log_likelihood
    FROM m{_EM_ROUNDS}, l{_EM_ROUNDS}""",
)
def mixture_components(spark, sf):
    """Parameters after the rounds, and the mean log-likelihood before the last of them."""
    fitted = fit_mixture(_places(spark, sf), ["x"], 2, rounds=_EM_ROUNDS, tol=0.0, means=[[m] for m in _STARTS])
    rows = [
        (i, round(float(w), 6), round(float(m[0]), 6), round(float(c[0, 0]), 6), round(fitted.log_likelihood[-1], 6))
        for i, (w, m, c) in enumerate(zip(fitted.weights, fitted.means, fitted.covariances, strict=True))
    ]
    return local_frame(spark, rows, "component int, weight double, mean double, variance double, log_likelihood double")


@query(
    "linkage_heights",
    f"""WITH {_PLACES_SQL}, g AS (SELECT x - lag(x) OVER (ORDER BY x, id) AS gap FROM p)
    SELECT row_number() OVER (ORDER BY round(gap, 6)) AS step, round(gap, 6) AS height FROM g WHERE gap <= 0.5""",
)
def linkage_heights(spark, sf):
    """The dendrogram over one column: on a line, single linkage merges across the gaps."""
    forest = near_forest(_places(spark, sf), "id", ["x"], 0.5)
    return merge_heights(forest).select("step", F.round("weight", 6).alias("height"))


_REACH = """link AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.2),
    reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    labels AS (SELECT id, least(id, coalesce(min(b), id)) AS cluster FROM p LEFT JOIN reach ON a = id GROUP BY id)"""


@query("linkage_clusters", f"WITH RECURSIVE {_PLACES_SQL}, {_REACH} SELECT id, cluster FROM labels")
def linkage_clusters(spark, sf):
    return single_linkage(_places(spark, sf), "id", ["x", "y"], 0.2)


@query(
    "linkage_sizes",
    f"""WITH RECURSIVE {_PLACES_SQL}, {_REACH}, s AS (SELECT count(*) AS size FROM labels GROUP BY cluster)
    SELECT size, count(*) AS clusters FROM s GROUP BY size""",
)
def linkage_sizes(spark, sf):
    return cluster_sizes(single_linkage(_places(spark, sf), "id", ["x", "y"], 0.2))

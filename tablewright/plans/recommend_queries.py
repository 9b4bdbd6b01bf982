"""Registered queries: interactions of users with items, and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.metrics import regression_scores
from tablewright.operators.recommend import (
    active_users,
    cold_start,
    fit_als,
    fit_biases,
    interactions,
    leave_last_out,
    popularity,
    predict_biases,
    predict_ratings,
    ranking_scores,
    sparsity,
    top_k,
    unseen,
    user_ranking_scores,
)
from tablewright.plans.tables import table

QUERIES, ORACLES = {}, {}

#: Rows of each user that are held out, and the length of a list.
HELD_OUT, LENGTH = 5, 10


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _events(spark, sf):
    """events, with the number in props as the item."""
    return table(spark, sf, "events").withColumn("item_id", F.regexp_extract("props", r"(\d+)", 1).cast("long"))


_EVENTS_SQL = r"""e AS (SELECT *, regexp_extract(props, '(\d+)', 1)::BIGINT AS item_id FROM events)"""


@query(
    "interaction_sparsity",
    f"""WITH {_EVENTS_SQL}, p AS (SELECT user_id, item_id, count(*) AS n FROM e WHERE user_id IS NOT NULL GROUP BY ALL),
    u AS (SELECT user_id, sum(n) AS n FROM p GROUP BY user_id)
    SELECT (SELECT sum(n)::BIGINT FROM p) AS rows, (SELECT count(*) FROM u) AS users, count(DISTINCT item_id) AS items,
      count(*) AS pairs, 1 - count(*) / ((SELECT count(*) FROM u)::DOUBLE * count(DISTINCT item_id)) AS sparsity,
      (SELECT sum(n)::DOUBLE / count(*) FROM u) AS rows_per_user, (SELECT max(n)::BIGINT FROM u) AS most_rows FROM p""",
)
def interaction_sparsity(spark, sf):
    return sparsity(_events(spark, sf), "user_id", "item_id")


@query(
    "active_users",
    """WITH u AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
    SELECT CASE WHEN n >= 100 THEN 100 WHEN n >= 50 THEN 50 WHEN n >= 20 THEN 20 WHEN n >= 10 THEN 10 WHEN n >= 5 THEN 5
      WHEN n >= 2 THEN 2 ELSE 1 END::BIGINT AS from_rows, count(*) AS users, sum(n)::BIGINT AS rows FROM u GROUP BY 1""",
)
def active_user_steps(spark, sf):
    return active_users(table(spark, sf, "events"), "user_id")


@query(
    "cold_start_daily",
    f"""WITH {_EVENTS_SQL},
    d AS (SELECT user_id, item_id, date_trunc('day', ts) AS day FROM e),
    f AS (SELECT day, day = min(day) OVER (PARTITION BY user_id) AS u, day = min(day) OVER (PARTITION BY item_id) AS i,
      day = min(day) OVER (PARTITION BY user_id, item_id) AS p FROM d)
    SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (WHERE u) / count(*)::DOUBLE AS cold_users,
      count(*) FILTER (WHERE i) / count(*)::DOUBLE AS cold_items, count(*) FILTER (WHERE p) / count(*)::DOUBLE AS cold_pairs
    FROM f GROUP BY day""",
)
def cold_start_daily(spark, sf):
    found = cold_start(_events(spark, sf), "user_id", "item_id", "ts")
    return found.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), "rows", "cold_users", "cold_items", "cold_pairs")


def _held_out(spark, sf):
    """(ratings of the training rows, ratings of the held-out rows): the mean value of each pair."""
    train, test = leave_last_out(_events(spark, sf), "user_id", ["ts", "event_id"], HELD_OUT)
    return interactions(train, "user_id", "item_id", "value"), interactions(test, "user_id", "item_id", "value")


_HELD_SQL = f"""{_EVENTS_SQL},
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM e),
    train AS (SELECT user_id AS "user", item_id AS item, avg(value) AS rating FROM o WHERE back > {HELD_OUT} GROUP BY ALL),
    test AS (SELECT user_id AS "user", item_id AS item, avg(value) AS rating FROM o WHERE back <= {HELD_OUT} GROUP BY ALL)"""

_POPULAR_SQL = f"""{_HELD_SQL},
    pop AS (SELECT item, count(*)::DOUBLE AS score FROM train GROUP BY item),
    ranking AS (
      SELECT u."user", row_number() OVER (PARTITION BY u."user" ORDER BY score DESC, p.item) AS rank, p.item, score
      FROM (SELECT DISTINCT "user" FROM train) u CROSS JOIN pop p
      WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s."user" = u."user" AND s.item = p.item)
      QUALIFY rank <= {LENGTH})"""


@query("popular_top_k", f'WITH {_POPULAR_SQL} SELECT "user", rank::INTEGER AS rank, item, score FROM ranking')
def popular_top_k(spark, sf):
    train, _ = _held_out(spark, sf)
    return top_k(popularity(train, train), LENGTH, seen=train)


_SCORES_SQL = f"""{_POPULAR_SQL},
    relevant AS (SELECT "user", item FROM test EXCEPT SELECT "user", item FROM train),
    hit AS (SELECT r."user", rank, row_number() OVER (PARTITION BY r."user" ORDER BY rank) AS so_far
      FROM ranking r JOIN relevant USING ("user", item)),
    g AS (SELECT "user", count(*) AS hits, sum(so_far / rank::DOUBLE) AS gain, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first
      FROM hit GROUP BY "user"),
    n AS (SELECT "user", count(*) AS n FROM relevant GROUP BY "user"),
    per_user AS (
      SELECT "user", n AS n_relevant, coalesce(hits, 0) AS hits, coalesce(gain / least(n, {LENGTH}), 0) AS ap,
        coalesce(dcg / list_sum([1 / log2(i + 1) for i in range(1, least(n, {LENGTH}) + 1)]), 0) AS ndcg,
        coalesce(hits / {LENGTH}.0::DOUBLE, 0) AS precision, coalesce(hits / n::DOUBLE, 0) AS recall, coalesce(1 / first::DOUBLE, 0) AS rr
      FROM n LEFT JOIN g USING ("user"))"""


@query("user_ranking_measures", f"WITH {_SCORES_SQL} SELECT * FROM per_user")
def user_ranking_measures(spark, sf):
    train, test = _held_out(spark, sf)
    return user_ranking_scores(top_k(popularity(train, train), LENGTH, seen=train), unseen(test, train), LENGTH)


@query(
    "ranking_measures",
    f"""WITH {_SCORES_SQL} SELECT count(*) AS users, avg(ap) AS map, avg(ndcg) AS ndcg, avg(precision) AS precision,
    avg(recall) AS recall, avg(rr) AS mrr, avg((hits > 0)::INT::DOUBLE) AS hit_rate FROM per_user""",
)
def ranking_measures(spark, sf):
    train, test = _held_out(spark, sf)
    return ranking_scores(top_k(popularity(train, train), LENGTH, seen=train), unseen(test, train), LENGTH)


@query(
    "rating_baseline",
    f"""WITH {_HELD_SQL},
    mu AS (SELECT avg(rating) AS mu FROM train),
    i AS (SELECT item, sum(rating - mu) / (10 + count(*)) AS bi FROM train, mu GROUP BY item),
    u AS (SELECT "user", sum(rating - mu - bi) / (10 + count(*)) AS bu FROM train JOIN i USING (item), mu GROUP BY "user"),
    p AS (SELECT rating, mu + coalesce(bi, 0) + coalesce(bu, 0) AS p FROM test LEFT JOIN i USING (item) LEFT JOIN u USING ("user"), mu)
    SELECT sqrt(avg((rating - p) ** 2)) AS rmse, avg(abs(rating - p)) AS mae,
      1 - sum((rating - p) ** 2) / (var_pop(rating) * count(*)) AS r2 FROM p""",
)
def rating_baseline(spark, sf):
    train, test = _held_out(spark, sf)
    return regression_scores(predict_biases(test, fit_biases(train)), "rating", "prediction")


@query("als_measures")
def als_measures(spark, sf):
    """Held-out errors and ranking of factors fitted to what the mean and the deviations leave over.

    Starting values are random numbers, so there is no SQL; tests recompute the measures
    in SQL from the stored predictions and lists.
    """
    train, test = _held_out(spark, sf)
    biases = fit_biases(train)
    rest = predict_biases(train, biases).select("user", "item", (F.col("rating") - F.col("prediction")).alias("rating"))
    factors = fit_als(rest, rank=4, reg=0.5, iterations=5, seed=1)
    told = predict_ratings(predict_biases(test, biases, "base"), factors)
    told = told.withColumn("prediction", F.col("base") + F.coalesce("prediction", F.lit(0.0)))
    ranking = top_k(factors, LENGTH, seen=train)
    # One row each.
    return regression_scores(told, "rating", "prediction").crossJoin(ranking_scores(ranking, unseen(test, train), LENGTH))

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.operators.metrics import regression_scores
from tablewright.operators.recommend import (
    Factors,
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


def test_interactions_combine_and_leave_out(spark, rows):
    data = [("u", 1, 2.0), ("u", 1, 4.0), ("u", 2, None), ("v", 2, float("nan")), (None, 1, 1.0), ("v", None, 1.0), ("v", 1, 3.0)]
    df = spark.createDataFrame(data, "who string, what int, v double")
    assert rows(interactions(df, "who", "what", "v")) == [("u", 1, 3.0), ("v", 1, 3.0)]
    assert rows(interactions(df, "who", "what", "v", "sum")) == [("u", 1, 6.0), ("v", 1, 3.0)]
    assert rows(interactions(df, "who", "what")) == [("u", 1, 2.0), ("u", 2, 1.0), ("v", 1, 1.0), ("v", 2, 1.0)]
    assert interactions(df.limit(0), "who", "what", "v").count() == 0
    with pytest.raises(ValueError, match="combine"):
        interactions(df, "who", "what", "v", "median")


def test_sparsity_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "user int, item int")
    assert tuple(sparsity(empty, "user", "item").first()) == (0, 0, 0, 0, None, None, None)
    data = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (None, 5), (3, None)], "user int, item int")
    assert tuple(sparsity(data, "user", "item").first()) == (4, 2, 2, 3, 0.25, 2.0, 3)


def test_cold_start_counts_the_whole_first_day(spark, rows):
    data = [(1, 1, "2024-01-01 10:00"), (1, 1, "2024-01-01 11:00"), (1, 2, "2024-01-02 01:00"), (2, 1, "2024-01-02 02:00"), (2, 1, "2024-01-03 02:00")]
    data += [(None, 1, "2024-01-03 03:00"), (1, 1, None)]
    df = spark.createDataFrame(data, "user int, item int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    found = cold_start(df, "user", "item", "ts").withColumn("bucket", F.dayofmonth("bucket"))
    assert rows(found) == [(1, 2, 1.0, 1.0, 1.0), (2, 2, 0.5, 0.5, 1.0), (3, 1, 0.0, 0.0, 0.0)]


def test_leave_last_out(spark, rows):
    data = [("a", i, i * 10) for i in range(6)] + [("b", 1, 5), ("b", 2, 5), ("c", 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(data, "user string, t int, item int").repartition(3)
    train, test = leave_last_out(df, "user", ["t"], 2)
    assert rows(train) == [("a", i, i * 10) for i in range(4)]
    assert rows(test) == [("a", 4, 40), ("a", 5, 50), ("b", 1, 5), ("b", 2, 5), ("c", 1, 1)]


@pytest.mark.parametrize(("user_block", "item_block"), [(1024, 4096), (3, 5)])
def test_top_k_against_brute_force(spark, user_block, item_block):
    rng = random.Random(3)
    users = {f"u{i}": [rng.randrange(-2, 3) * 1.0 for _ in range(3)] for i in range(17)}
    items = {i: [rng.randrange(-2, 3) * 1.0 for _ in range(3)] for i in range(23)}
    seen = [(u, i) for u in users for i in items if rng.random() < 0.4] + [("u0", i) for i in items] + [("ghost", 1), ("u1", 999)]
    factors = Factors(
        spark.createDataFrame([*users.items(), ("null", None), ("other", [1.0])], "user string, vector array<double>"),
        spark.createDataFrame([*items.items(), (98, None), (99, [1.0])], "item int, vector array<double>"),
    )
    pairs = spark.createDataFrame(seen * 2, "user string, item int")
    found = top_k(factors, 4, pairs, user_block, item_block).collect()
    want = [("other", 1, 99, 1.0)]
    gone = set(seen)
    for u, v in users.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in items.items() if (u, i) not in gone)
        want += [(u, r, i, -s) for r, (s, i) in enumerate(scored[:4], 1)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert top_k(factors, 4, None, user_block, item_block).where("user = 'u0'").count() == 4


def brute_scores(ranking, relevant, k):
    out = []
    for user, wanted in relevant.items():
        listed = [i for r, i in sorted(ranking.get(user, [])) if r <= k]
        hits = [r for r, i in enumerate(listed, 1) if i in wanted]
        n = min(len(wanted), k)
        ap = sum((j + 1) / r for j, r in enumerate(hits)) / n
        ndcg = sum(1 / math.log2(r + 1) for r in hits) / sum(1 / math.log2(r + 1) for r in range(1, n + 1))
        out.append((user, ap, ndcg, len(hits) / k, len(hits) / len(wanted), 1 / hits[0] if hits else 0.0))
    return out


def test_ranking_scores_against_brute_force(spark):
    rng = random.Random(4)
    ranking = {u: [(r + 1, i) for r, i in enumerate(rng.sample(range(30), 12))] for u in range(40)}
    relevant = {u: set(rng.sample(range(30), rng.randrange(1, 15))) for u in range(3, 45)}
    ranked = spark.createDataFrame([(u, r, i) for u, x in ranking.items() for r, i in x], "user int, rank int, item int")
    wanted = spark.createDataFrame([(u, i) for u, x in relevant.items() for i in x] * 2 + [(None, 1), (5, None)], "user int, item int")
    want = brute_scores(ranking, relevant, 5)
    got = {r.user: r for r in user_ranking_scores(ranked, wanted, 5).collect()}
    assert set(got) == set(relevant)
    for u, *values in want:
        r = got[u]
        assert [r.ap, r.ndcg, r.precision, r.recall, r.rr] == pytest.approx(values)
    total = ranking_scores(ranked, wanted, 5).first()
    assert total.users == len(relevant)
    assert total["map"] == pytest.approx(sum(w[1] for w in want) / len(want))
    assert ranking_scores(ranked, wanted.limit(0), 5).first()["map"] is None


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings of rank two with little noise; popular items are not the liked ones."""
    rng = random.Random(5)
    users = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(60)]
    items = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(50)]
    data = [
        (f"user {u}", 10**12 + i, 3 + sum(a * b for a, b in zip(x, y)) + rng.gauss(0, 0.05), rng.random())
        for u, x in enumerate(users) for i, y in enumerate(items) if rng.random() < 0.5
    ]
    df = spark.createDataFrame(data, "user string, item long, rating double, t double")
    return [x.cache() for x in leave_last_out(df, "user", ["t"], 6)]


def test_als_finds_planted_factors_and_sql_agrees(spark, planted, tmp_path):
    train, test = planted
    biases = fit_biases(train)
    rest = predict_biases(train, biases).select("user", "item", (F.col("rating") - F.col("prediction")).alias("rating"))
    factors = fit_als(rest, rank=3, reg=0.05, iterations=12)
    told = predict_ratings(predict_biases(test, biases, "base"), factors)
    told = told.withColumn("prediction", F.col("base") + F.coalesce("prediction", F.lit(0.0)))
    told.write.parquet(f"{tmp_path}/told")
    ranking = top_k(factors, 10, train)
    ranking.write.parquet(f"{tmp_path}/ranking")
    liked = unseen(test.where("rating > 3.5"), train)
    liked.write.parquet(f"{tmp_path}/liked")
    stored = spark.read.parquet(f"{tmp_path}/told")
    scores = regression_scores(stored, "rating", "prediction").first()
    found = ranking_scores(spark.read.parquet(f"{tmp_path}/ranking"), spark.read.parquet(f"{tmp_path}/liked"), 10).first()
    rmse, ap, ndcg = duckdb.sql(f"""
        WITH r AS (FROM '{tmp_path}/ranking/*.parquet'), l AS (FROM '{tmp_path}/liked/*.parquet'),
        h AS (SELECT "user", rank, row_number() OVER (PARTITION BY "user" ORDER BY rank) AS k FROM r JOIN l USING ("user", item)),
        n AS (SELECT "user", least(count(*), 10) AS n FROM l GROUP BY "user"),
        s AS (SELECT n."user", coalesce(sum(k / rank::DOUBLE), 0) / any_value(n) AS ap,
                coalesce(sum(1 / log2(rank + 1)), 0) / any_value(list_sum([1 / log2(i + 1) for i in range(1, n + 1)])) AS ndcg
              FROM n LEFT JOIN h USING ("user") GROUP BY n."user")
        SELECT (SELECT sqrt(avg((rating - prediction) ** 2)) FROM '{tmp_path}/told/*.parquet'), avg(ap), avg(ndcg) FROM s""").fetchall()[0]
    assert scores.rmse == pytest.approx(rmse) and found["map"] == pytest.approx(ap) and found.ndcg == pytest.approx(ndcg)
    # A hundredth of the variance is left, and the list beats the popular items.
    assert scores.rmse < 0.35 and scores.r2 > 0.9
    popular = ranking_scores(top_k(popularity(train, train), 10, train), liked, 10).first()
    assert found["map"] > 2 * popular["map"] and found.ndcg > popular.ndcg


def test_als_without_ratings_and_unknown_pairs(spark, planted):
    train, _ = planted
    none = fit_als(train.limit(0))
    assert none.users.count() == none.items.count() == 0
    factors = fit_als(train, rank=2, iterations=2)
    pairs = spark.createDataFrame([("nobody", 10**12), ("user 1", 5), ("user 1", 10**12)], "user string, item long")
    told = [r.prediction for r in predict_ratings(pairs, factors).orderBy("user", "item").collect()]
    assert [t is None for t in told] == [True, True, False]

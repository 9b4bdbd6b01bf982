"""Recommending items to users: interactions, holdout, factors, top-k lists and ranking measures.

Top-k lists come from blocks of users against blocks of items: a task holds one block of
each, and a user leaves it with k items at most. No users x items table exists.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.missing import quoted
from tablewright.operators.joins import lookup_join, materialize, skewed_anti_join, skewed_inner_join
from tablewright.operators.ordering import global_index
from tablewright.session import checkpoint_ready, durable

#: Users and items of a block; their scores are the largest thing a task holds.
USER_BLOCK, ITEM_BLOCK = 1024, 4096
#: Spark ML's ALS numbers users and items by 32-bit integers.
MOST_CODES = 2**31 - 1

_COMBINED = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def interactions(df: DataFrame, user: str, item: str, value: str | None = None, combine: str = "mean") -> DataFrame:
    """user, item and rating: one row per pair, its values combined, or counted without ``value``.

    Rows without user or item are left out, as are values that are null or NaN; a pair
    without any value is left out too. An empty table gives an empty result.
    """
    pairs = df.select(quoted(user).alias("user"), quoted(item).alias("item"), *([quoted(value).cast("double").alias("v")] if value else []))
    pairs = pairs.where("user is not null and item is not null")
    if value is None:
        return pairs.groupBy("user", "item").agg(F.count(F.lit(1)).cast("double").alias("rating"))
    if combine not in _COMBINED:
        raise ValueError(f"combine is one of {sorted(_COMBINED)}, not {combine!r}")
    known = pairs.where("v is not null and not isnan(v)")
    return known.groupBy("user", "item").agg(_COMBINED[combine]("v").alias("rating"))


def sparsity(df: DataFrame, user: str, item: str) -> DataFrame:
    """One row: rows, users, items, pairs (distinct), sparsity (share of users x items never met), rows_per_user and most_rows.

    Rows without user or item do not count. Without any row the shares are null.
    """
    pairs = df.select(quoted(user).alias("user"), quoted(item).alias("item")).where("user is not null and item is not null")
    per_pair = pairs.groupBy("user", "item").agg(F.count(F.lit(1)).alias("n"))
    per_user = per_pair.groupBy("user").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    users = per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("users"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.max("n").alias("most_rows"),
    )
    items = pairs.select("item").distinct().agg(F.count(F.lit(1)).alias("items"))
    cells = F.nullif(F.col("users").cast("double") * F.col("items"), F.lit(0.0))
    return users.crossJoin(items).select(  # one row each
        "rows", "users", "items", "pairs", (1 - F.col("pairs") / cells).alias("sparsity"),
        (F.col("rows") / F.nullif(F.col("users").cast("double"), F.lit(0.0))).alias("rows_per_user"), "most_rows",
    )


def active_users(df: DataFrame, user: str, bounds: Sequence[int] = (1, 2, 5, 10, 20, 50, 100)) -> DataFrame:
    """How many users have how many rows: from_rows, users and rows of each step of ``bounds``."""
    per_user = df.where(quoted(user).isNotNull()).groupBy(quoted(user)).agg(F.count(F.lit(1)).alias("n"))
    step = F.greatest(*[F.when(F.col("n") >= b, b) for b in bounds], F.lit(0))
    return per_user.groupBy(step.cast("long").alias("from_rows")).agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("rows"))


def cold_start(df: DataFrame, user: str, item: str, time: str, bucket: str = "day") -> DataFrame:
    """For each day (or other unit) the share of its rows whose user, item or pair was never met before it.

    Returns bucket, rows, cold_users, cold_items, cold_pairs (shares). What is first met on
    a day is cold all that day: an as-of join of each row with the day its key was first
    seen. Rows without user, item or time do not count.
    """
    rows = df.select(quoted(user).alias("user"), quoted(item).alias("item"), F.date_trunc(bucket, quoted(time)).alias("bucket"))
    rows = rows.where("user is not null and item is not null and bucket is not null")
    # A day's rows of a pair are one row from here on, which also bounds what a hot user moves.
    pairs = rows.groupBy("user", "item", "bucket").agg(F.count(F.lit(1)).alias("n"))
    for name, keys in (("user", ["user"]), ("item", ["item"]), ("pair", ["user", "item"])):
        first = materialize(rows.groupBy(*keys).agg(F.min("bucket").alias(f"first_{name}")))
        pairs = lookup_join(pairs, first, keys)
    rows_of = F.sum("n")

    def share(name: str) -> Column:
        return (F.sum(F.when(F.col(f"first_{name}") == F.col("bucket"), F.col("n")).otherwise(0)) / rows_of).alias(f"cold_{name}s")

    return pairs.groupBy("bucket").agg(rows_of.alias("rows"), share("user"), share("item"), share("pair"))


def leave_last_out(df: DataFrame, user: str, order_by: Sequence[str], n: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last ``n`` rows of each user by ``order_by`` are held out, all rows of a user with no more.

    ``order_by`` should tell a user's rows apart; of rows with equal order all behind
    the n-th last are held out with it, copies of a row included. Rows without user are
    in neither part. Only n rows of each user meet in a task.
    """
    order = F.struct(*[quoted(c) for c in order_by])
    known = df.where(quoted(user).isNotNull())
    ranked = known.select(quoted(user).alias(user), order.alias("__order"))
    latest = Window.partitionBy(quoted(user)).orderBy(F.desc("__order"))
    last = ranked.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= n)
    cuts = materialize(last.groupBy(quoted(user)).agg(F.min("__order").alias("__cut")))
    marked = lookup_join(known.withColumn("__order", order), cuts, [user])
    columns = [quoted(c) for c in df.columns]
    return marked.where("__order < __cut").select(*columns), marked.where("__order >= __cut").select(*columns)


@dataclass(frozen=True)
class Factors:
    """users (user, vector) and items (item, vector); the product of two vectors is a rating."""

    users: DataFrame
    items: DataFrame


def _codes(pairs: DataFrame, key: str) -> DataFrame:
    values = durable(pairs.select(key).distinct())
    n = values.count()
    if n > MOST_CODES:
        raise ValueError(f"{n} values of {key}; at most {MOST_CODES} can be numbered")
    return global_index(values, [key], f"{key}_code", n)


def fit_als(
    ratings: DataFrame,
    rank: int = 8,
    reg: float = 0.1,
    iterations: int = 10,
    implicit: bool = False,
    alpha: float = 1.0,
    nonnegative: bool = False,
    seed: int = 0,
) -> Factors:
    """Factors by alternating least squares from (user, item, rating).

    Users and items may be of any type that sorts. Explicit ratings are taken as they
    are (subtract a baseline first if wanted); ``implicit`` takes them as strength of a
    preference. Pairs should occur once (see ``interactions``). Without ratings there
    are no factors.
    """
    spark = ratings.sparkSession
    checkpoint_ready(spark)
    held = durable(ratings.select("user", "item", F.col("rating").cast("float").alias("rating")).where("rating is not null"))
    users, items = durable(_codes(held, "user")), durable(_codes(held, "item"))
    kinds = {k: held.schema[k].dataType.simpleString() for k in ("user", "item")}
    if held.isEmpty():
        return Factors(*[spark.createDataFrame([], f"{k} {kinds[k]}, vector array<double>") for k in ("user", "item")])
    coded = lookup_join(lookup_join(held, materialize(users), ["user"]), materialize(items), ["item"])
    coded = coded.select(F.col("user_code").cast("int"), F.col("item_code").cast("int"), "rating")
    als = ALS(
        rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=implicit, alpha=alpha, nonnegative=nonnegative, seed=seed,
        userCol="user_code", itemCol="item_code", ratingCol="rating", coldStartStrategy="nan", checkpointInterval=5,
    )
    model = als.fit(coded)

    def named(factors: DataFrame, codes: DataFrame, key: str) -> DataFrame:
        vectors = factors.select(F.col("id").cast("long").alias(f"{key}_code"), F.col("features").cast("array<double>").alias("vector"))
        return durable(codes.join(vectors, f"{key}_code").select(key, "vector"))

    return Factors(named(model.userFactors, users, "user"), named(model.itemFactors, items, "item"))


def predict_ratings(pairs: DataFrame, factors: Factors) -> DataFrame:
    """``pairs`` with prediction; null where the user or the item has no factors."""
    users = factors.users.withColumnRenamed("vector", "__u")
    items = factors.items.withColumnRenamed("vector", "__i")
    both = lookup_join(lookup_join(pairs, materialize(users), ["user"]), materialize(items), ["item"])
    product = F.aggregate(F.zip_with("__u", "__i", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    known = F.col("__u").isNotNull() & F.col("__i").isNotNull()
    return both.withColumn("prediction", F.when(known, product)).drop("__u", "__i")


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def top_k(
    factors: Factors, k: int = 10, seen: DataFrame | None = None, user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK
) -> DataFrame:
    """The ``k`` items of each user with the largest product of vectors: user, rank, item, score.

    Ties go to the smaller item. Pairs in ``seen`` (user, item) are not recommended; a
    user who has seen all items gets none. A user's seen items reach a task only as those
    of its block of items, so they are bounded however many a user has seen. Users and items
    should occur once; those without a vector, or with one of another length, are left out.
    """
    users, items = durable(factors.users.where("vector is not null")), durable(factors.items.where("vector is not null"))
    n_users, n_items = _blocks(users.count(), user_block), _blocks(items.count(), item_block)
    place = F.pmod(F.xxhash64("item"), F.lit(n_items)).cast("int")
    left = users.withColumn("ub", F.pmod(F.xxhash64("user"), F.lit(n_users)).cast("int"))
    left = left.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))))
    if seen is None:
        kind = items.schema["item"].dataType.simpleString()
        left = left.withColumn("seen", F.expr(f"cast(array() as array<{kind}>)"))
    else:
        listed = seen.select("user", "item").distinct().groupBy("user", place.alias("ib")).agg(F.collect_list("item").alias("seen"))
        left = left.join(listed, ["user", "ib"], "left")
    right = items.withColumn("ib", place).withColumn("ub", F.explode(F.sequence(F.lit(0), F.lit(n_users - 1))))
    schema = f"user {users.schema['user'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, score double"
    tile = ["ub", "ib"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(lambda a, b: _best_items(a, b, k), schema)
    best = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("user", "rank", "item", "score")


def _best_items(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best items of each user of one block, from one block of items."""
    who, what, score = [], [], []
    right = right.take(pc.sort_indices(right["item"])) if right.num_rows else right
    place = {v: i for i, v in enumerate(right["item"].to_pylist())}
    by_length: dict[int, tuple[list, list]] = {}
    for side, table in enumerate((left, right)):
        for i, n in enumerate(pc.list_value_length(table["vector"]).to_pylist()):
            by_length.setdefault(n, ([], []))[side].append(i)
    lists = left["seen"].to_pylist()
    for u, i in by_length.values():
        if not u or not i:
            continue
        a, b = (np.array(t["vector"].take(pa.array(x)).to_pylist(), float) for t, x in ((left, u), (right, i)))
        products, at = a @ b.T, np.array(i)
        back = {v: n for n, v in enumerate(i)}
        for row, user in zip(products, u, strict=True):
            # Rows are in item order, so a stable sort breaks ties by item.
            gone = [back[place[x]] for x in lists[user] or () if place.get(x) in back]
            open_ = np.delete(np.arange(len(row)), gone) if gone else np.arange(len(row))
            if len(open_) > k:
                least = np.partition(row[open_], len(open_) - k)[len(open_) - k]
                open_ = open_[row[open_] >= least]
            first = open_[np.argsort(-row[open_], kind="stable")[:k]]
            who += [user] * len(first)
            what += at[first].tolist()
            score += row[first].tolist()
    users, items = left["user"].take(pa.array(who, pa.int64())), right["item"].take(pa.array(what, pa.int64()))
    return pa.table({"user": users, "item": items, "score": pa.array(score, pa.float64())})


def popularity(ratings: DataFrame, users: DataFrame) -> Factors:
    """Factors that score an item by its number of users, alike for all ``users`` (user): a baseline to beat."""
    one = F.array(F.lit(1.0)).alias("vector")
    count = F.array(F.count(F.lit(1)).cast("double")).alias("vector")
    return Factors(users.select("user").distinct().select("user", one), ratings.groupBy("item").agg(count))


def user_ranking_scores(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """For each user with relevant items: n_relevant, hits, ap, ndcg, precision, recall and rr at ``k``.

    ``ranking`` has user, rank (from 1) and item; ``relevant`` user and item. ap is the
    sum of hits-so-far / rank over the hits, divided by min(n_relevant, k); ndcg the sum
    of 1 / log2(rank + 1) over the hits, divided by its largest value; rr the
    reciprocal rank of the first hit. A user without recommendations scores 0; users
    without relevant items are left out, as repeated pairs and nulls are.
    """
    wanted = relevant.select("user", "item").where("user is not null and item is not null").distinct()
    listed = ranking.where(F.col("rank") <= k).select("user", "item", "rank").groupBy("user", "item").agg(F.min("rank").alias("rank"))
    hits = skewed_inner_join(listed, wanted, ["user", "item"])
    so_far = F.row_number().over(Window.partitionBy("user").orderBy("rank"))
    per_hit = hits.withColumn("so_far", so_far)
    scored = per_hit.groupBy("user").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(F.col("so_far") / F.col("rank")).alias("gain"),
        F.sum(1 / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"),
        F.min("rank").alias("first"),
    )
    n, zero = F.least(F.col("n_relevant"), F.lit(k)), F.lit(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), n.cast("int")), zero, lambda s, r: s + 1 / F.log2(r + F.lit(1.0)))
    per_user = wanted.groupBy("user").agg(F.count(F.lit(1)).alias("n_relevant")).join(scored, "user", "left")
    return per_user.select(
        "user",
        "n_relevant",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce(F.col("gain") / n, zero).alias("ap"),
        F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"),
        F.coalesce(F.col("hits") / F.lit(float(k)), zero).alias("precision"),
        F.coalesce(F.col("hits") / F.col("n_relevant"), zero).alias("recall"),
        F.coalesce(1 / F.col("first"), zero).alias("rr"),
    )


def ranking_scores(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: users, map, ndcg, precision, recall, mrr and hit_rate at ``k``, as means over ``user_ranking_scores``."""
    per_user = user_ranking_scores(ranking, relevant, k)
    return per_user.agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("ap").alias("map"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("rr").alias("mrr"),
        F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"),
    )


def unseen(test: DataFrame, train: DataFrame) -> DataFrame:
    """The distinct (user, item) pairs of ``test`` that ``train`` does not hold: what a recommender can be asked for."""
    return skewed_anti_join(test.select("user", "item").distinct(), train.select("user", "item"), ["user", "item"])


@dataclass(frozen=True)
class Biases:
    """The mean rating, and how far users (user, bias) and items (item, bias) lie from it."""

    mean: float | None
    users: DataFrame
    items: DataFrame


def fit_biases(ratings: DataFrame, shrink: float = 10.0) -> Biases:
    """Item deviations from the mean, then user deviations from both, each divided by its count plus ``shrink``."""
    held = durable(ratings.select("user", "item", "rating").where("rating is not null"))
    mean = held.agg(F.avg("rating")).first()[0]
    part = F.lit(float(shrink)) + F.count(F.lit(1))
    items = durable(held.groupBy("item").agg((F.sum(F.col("rating") - F.lit(mean)) / part).alias("bias")))
    near = lookup_join(held, materialize(items), ["item"])
    rest = F.col("rating") - F.lit(mean) - F.col("bias")
    users = durable(near.groupBy("user").agg((F.sum(rest) / part).alias("bias")))
    return Biases(mean, users, items)


def predict_biases(pairs: DataFrame, model: Biases, name: str = "prediction") -> DataFrame:
    """``pairs`` with the mean plus both deviations; an unknown user or item deviates by nothing."""
    out = pairs
    for key, table in (("user", model.users), ("item", model.items)):
        out = lookup_join(out, materialize(table.withColumnRenamed("bias", f"__{key}")), [key])
    zero = F.lit(0.0)
    value = F.lit(model.mean).cast("double") + F.coalesce("__item", zero) + F.coalesce("__user", zero)
    return out.withColumn(name, value).drop("__user", "__item")

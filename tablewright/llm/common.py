"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.session import durable

#: A key is hot when it holds more than one part in HOT_PARTS of all rows, so at most HOT_PARTS keys are.
HOT_PARTS = 1000


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null as empty) and a number for each row; other columns go.

    The row number tells repeated rows apart. It holds for one reading only, so
    callers keep it in a checkpoint.
    """
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def attach(facts: DataFrame, classes: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Inner join of many rows with one row per key, when ``rows`` says how many facts a key has.

    ``classes`` is read three times, so it should be a checkpoint. Hot keys, at
    most HOT_PARTS of them by their counted share, are broadcast and their facts
    stay where they are; the facts of all other keys are shuffled, and none of
    those keys is large.
    """
    total = classes.agg(F.sum(rows)).first()[0] or 0
    limit = total // HOT_PARTS
    hot = classes.where(F.col(rows) > limit)
    cold = classes.where(F.col(rows) <= limit)
    near = facts.join(F.broadcast(hot), keys)
    far = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    return near.unionByName(far)


def even_sample(rows: DataFrame, by: str, per_value: int, most: int) -> DataFrame:
    """About ``per_value`` rows of each value of ``by`` and ``most`` in all, by the hash of ``id``.

    Every value keeps the share of the hash range that its count calls for, so no
    value is gathered in one task. Of more values than ``most`` the most frequent
    are kept. The same ids give the same sample, however the rows are dealt.
    """
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(most)
    order = F.xxhash64("id")
    # A tenth more, so that a value seldom falls short of its number.
    share = F.lit(1.1 * per_value) / F.col("n")
    place = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
    drawn = rows.join(F.broadcast(counts), by).where(place < share).drop("n")
    return drawn.orderBy(order, "id").limit(most)


def first_id(id_col: str, row_col: str) -> Column:
    """The smallest id of a group with its row; rows without an id come last."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row_col).alias("row")))


def last_id(id_col: str, row_col: str) -> Column:
    """The largest id of a group with its row; rows without an id come last."""
    return F.max(
        F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"), (-F.col(row_col)).alias("row"))
    )


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps, with all their columns.

    ``decided`` has a row per row of ``docs``: doc_id, text_hash (see
    ``text_hash``) and kept. Of rows that repeat both, one stays if one is kept.
    """
    id_key = F.coalesce(docs["doc_id"].cast("long"), F.lit(0))
    keys = ["__tw_id", "__tw_none", "__tw_hash"]
    wanted = decided.where("kept").select(
        F.coalesce(F.col("doc_id"), F.lit(0)).alias(keys[0]),
        F.col("doc_id").isNull().alias(keys[1]),
        F.col("text_hash").alias(keys[2]),
    )
    marked = docs.select(
        "*", id_key.alias(keys[0]), docs["doc_id"].isNull().alias(keys[1]), text_hash(docs["text"]).alias(keys[2])
    )
    # Rows of one key are together after the join, so counting them moves nothing.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    found = marked.join(wanted.distinct(), keys, "left_semi")
    return found.withColumn("__tw_n", number).where("__tw_n = 1").select(*[found[c] for c in docs.columns])


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps removed.

    Spark removes them when the driver collects the plans they belong to, which a
    driver with memory to spare may put off until the disks of the executors are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


__all__ = ["HOT_PARTS", "attach", "durable", "even_sample", "first_id", "id_and_text", "keep_rows", "last_id", "release", "text_hash"]

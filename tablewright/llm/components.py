"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import attach, durable


def _least_neighbours(pairs: DataFrame) -> DataFrame:
    """a, least (of a and its b) and the number of rows of each a."""
    found = pairs.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
    return durable(found.withColumn("least", F.least("a", "least")))


def _links(df: DataFrame) -> DataFrame:
    """Distinct links of two different nodes, the larger one as a."""
    return durable(df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of ``links`` (a, b).

    A round connects each node's larger neighbours, then its smaller ones, to the
    smallest neighbour. Rounds end when nothing changes: every node then hangs on
    its root. The number of rounds grows with the logarithm of the longest path, not
    with the data. A node with a third of all links is never gathered: minima are
    combined before the shuffle, and ``attach`` keeps its links where they are.
    Nodes are longs; null nodes and links of a node with itself are left out.
    """
    held = _links(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null"))
    before = _mark(held)
    while before[0]:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = attach(both, _least_neighbours(both), ["a"], "n")
        held = _links(large.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))
        small = attach(held, _least_neighbours(held), ["a"], "n")
        held = _links(
            small.select("b", "least").union(small.select("a", "least")).toDF("a", "b")
        )
        after = _mark(held)
        if after == before:
            break
        before = after
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

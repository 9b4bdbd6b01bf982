"""Exact duplicates: a tree merge of sorted digest runs.

Every partition of the input is a run: one row per digest, sorted, with the
identifier that stays and the number of rows. Runs are merged in rounds. In round
r a run exchanges with the runs whose number differs from its own in digit r, and
afterwards holds the digests whose own digit r is that of the run: the binomial
exchange, ``fan`` runs at a time. After the last round each digest lies in one run.
A digest that is in a third of all rows is one row of each run from the start, so
no task ever sees more than ``fan`` rows of it.

Equality is by SHA-256, verified at every level: a row also carries the length in
bytes and an independent 64-bit hash, and rows merge only if all three agree.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import attach, durable, first_id, id_and_text, last_id, text_hash

FAN = 8
_KEYS = ["digest", "n_bytes", "witness"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document, with the number of its run."""
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        "row_no",
        F.spark_partition_id().alias("run"),
        text_hash(F.col("text")).alias("text_hash"),
        ascii_lower(F.col("text")).alias("norm"),
    )
    return rows.select(
        "doc_id",
        "row_no",
        "run",
        "text_hash",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("witness"),
    )


def merge_runs(rows: DataFrame, keep: str, fan: int = FAN) -> DataFrame:
    """One row per digest: best (a struct with id and row) and n_rows."""
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    rounds, width = 1, fan
    while width < runs:
        rounds, width = rounds + 1, width * fan
    pick = last_id("doc_id", "row_no") if keep == "largest" else first_id("doc_id", "row_no")
    merged = rows.withColumn("target", F.pmod(F.col("witness"), F.lit(width)).cast("int"))
    for r in range(rounds):
        place = fan**r
        own = F.floor(F.col("run") / place).cast("int") % fan
        wanted = F.floor(F.col("target") / place).cast("int") % fan
        merged = merged.withColumn("run", F.col("run") + (wanted - own) * place)
        best = pick if r == 0 else (F.max("best") if keep == "largest" else F.min("best"))
        count = F.count(F.lit(1)) if r == 0 else F.sum("n_rows")
        merged = merged.groupBy("run", *_KEYS, "target").agg(best.alias("best"), count.alias("n_rows"))
    return merged.drop("run", "target")


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", fan: int = FAN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of equal texts; equal means identical after lower-casing A-Z.

    Returns a row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 (of the lower-cased text), text_hash (xxhash64 of the text as it is).

    * null text counts as empty; all empty texts are one group;
    * of equal texts the ``keep`` ("smallest" or "largest") doc_id stays; rows
      without doc_id stay only where no row of the group has one;
    * of rows that repeat the doc_id that stays, exactly one is kept;
    * an empty table gives an empty result; further columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r}")
    rows = durable(digest_rows(docs, id_col, text_col))
    classes = durable(merge_runs(rows, keep, fan))
    row = F.col("best.row") if keep == "smallest" else -F.col("best.row")
    joined = attach(rows, classes, _KEYS, "n_rows")
    return joined.select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("n_rows").alias("group_size"),
        (F.col("row_no") == row).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )

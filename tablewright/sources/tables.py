"""Reading and writing tables: CSV and Parquet in, CSV, Parquet and JSON out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW_ORDER = "_row_order"


def read_table(
    spark: SparkSession,
    path: str,
    max_rows: int | None = None,
    schema: StructType | str | None = None,
    row_order: bool = False,
) -> DataFrame:
    """Parquet by suffix, else CSV with a header.

    A CSV without ``schema`` costs one more pass to infer it. ``row_order`` adds
    a sortable file position, which the operators that keep a "first" row need.
    """
    parquet = path.lower().endswith(".parquet")
    if parquet:
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        df = reader.csv(path)
    if row_order:
        place = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
        start = F.lit(0).cast("bigint") if parquet else F.col("_metadata.file_block_start")
        df = df.select("*", F.struct(F.col("_metadata.file_path"), start.alias("start"), place.alias("row")).alias(ROW_ORDER))
    return df.limit(max_rows) if max_rows else df


def read_many(spark: SparkSession, paths: Sequence[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Read each file; what cannot be read is reported and left out.

    A table is called by its file name; files of the same name get as many of their
    folders as tell them apart. A path given twice is read once.
    """
    tables, failures = {}, {}
    paths = list(dict.fromkeys(p.rstrip("/") for p in paths))
    for path in paths:
        try:
            tables[short_name(path, paths)] = read_table(spark, path)
        except (PySparkException, Py4JJavaError) as error:
            failures[path] = str(error)
    return tables, failures


def short_name(path: str, paths: Sequence[str]) -> str:
    """The shortest end of a path, in whole parts, that no other path has."""
    parts = path.split("/")
    others = [p.split("/") for p in paths if p != path]
    for n in range(1, len(parts)):
        if all(o[-n:] != parts[-n:] for o in others):
            return "/".join(parts[-n:])
    return path


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def free_name(spark: SparkSession, folder: str, base: str) -> str:
    """``base``, or ``base_2``, ``base_3`` and so on while the name is taken."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stem, dot, suffix = base.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot else (base, "")
    name, i = base, 1
    while fs.exists(jvm.org.apache.hadoop.fs.Path(root, name)):
        i += 1
        name = f"{stem}_{i}{suffix}"
    return name


def write_merged(df: DataFrame, folder: str, base: str = "merged_common.csv") -> str:
    """Write a merged table as CSV under a name that is still free; returns the path."""
    path = f"{folder.rstrip('/')}/{free_name(df.sparkSession, folder, base)}"
    df.write.option("header", True).mode("errorifexists").csv(path)
    return path


def write_leaderboard(runs: DataFrame, path: str, append: bool = False) -> None:
    """CSV for a single leaderboard; ``append`` adds to a Parquet run log."""
    if append:
        runs.write.mode("append").parquet(path)
    else:
        runs.write.option("header", True).mode("overwrite").csv(path)


def plan_to_json(plan: DataFrame) -> DataFrame:
    """One JSON text per plan row."""
    return plan.select(F.to_json(F.struct(*plan.columns)).alias("plan"))


def write_plan(plan: DataFrame, path: str) -> None:
    plan.write.mode("overwrite").json(path)


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> Mapping[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}

"""Session defaults and the reliable-checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_DEFAULTS)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure a reliable checkpoint folder is set.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only a local
    master may fall back to a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | StructType) -> DataFrame:
    """A few driver-side rows as a local relation, so that no Python tasks run for them."""
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(typed)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=typed)


SMALL_INPUT_BYTES = 256 * 1024 * 1024


@contextmanager
def small_in_memory(df: DataFrame) -> Iterator[DataFrame]:
    """A cached copy over all cores while several passes read a small table.

    The size is Spark's own estimate from the input files. A small file is often
    a single split, which would keep all but one core idle in every pass. Larger
    tables are passed through and scanned in place.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_INPUT_BYTES:
        yield df
        return
    held = df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        yield held
    finally:
        held.unpersist()


def local_copy(df: DataFrame) -> DataFrame:
    """Compute a result of a few rows now and keep it as a local relation."""
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)

"""Fitted steps on a stream.

Casts, date parsing, masking, clipping, filling and date expansion are plain
projections once their constants are fitted on a batch table, so they run on a
streaming frame as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame], DataFrame]


def apply_steps(stream: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        stream = step(stream)
    return stream


def write_cleaned(stream: DataFrame, steps: Sequence[Step], path: str, checkpoint: str) -> StreamingQuery:
    """Append the cleaned rows of what is there now to Parquet, then stop."""
    writer = apply_steps(stream, steps).writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

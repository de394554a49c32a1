"""Pipelines over streaming tables.

Row-wise stages compile to the same columns on a stream as on a table.  A
``$group`` over a stream needs an event-time window and a watermark, which
``windowed_group`` adds; the other stages need the whole input and are refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.functions.accum import accumulate
from tarn.functions.expr import compile_expression
from tarn.functions.types import PipelineError
from tarn.operators.stages import ROW_WISE, Catalog, Frame, run

STREAMABLE = (*ROW_WISE, "$unwind", "$lookup", "$unionWith")


def stream_pipeline(df: DataFrame, pipeline: Sequence[dict[str, Any]], catalog: Catalog | None = None) -> DataFrame:
    """A stateless pipeline on a stream; a ``$lookup`` must be unwound, so that it is a stream-table join."""
    for i, s in enumerate(pipeline):
        name = next(iter(s))
        if df.isStreaming and name not in STREAMABLE:
            raise PipelineError(f"stage {i}: {name} needs the whole input; use windowed_group on a stream")
        if df.isStreaming and name == "$lookup" and not (i + 1 < len(pipeline) and "$unwind" in pipeline[i + 1]):
            raise PipelineError(f"stage {i}: $lookup on a stream must be followed by $unwind of its result")
    return run(Frame(df, catalog=catalog), pipeline).df


def windowed_group(df: DataFrame, time: str, spec: dict[str, Any], length: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """``$group`` per event-time window; rows later than ``lateness`` behind the stream are dropped."""
    key = compile_expression(spec.get("_id"), df.schema)
    aggs = [accumulate(a, df.schema, (), n).col.alias(n) for n, a in spec.items() if n != "_id"]
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = df.withWatermark(time, lateness).groupBy(window, key.col.cast("string").alias("_id") if spec.get("_id") is None else key.col.alias("_id"))
    return grouped.agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "_id", *[n for n in spec if n != "_id"])


def session_group(df: DataFrame, time: str, keys: Sequence[str], gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a stream: start, end of the window and number of events per key, closed by ``gap`` of silence."""
    return (
        df.withWatermark(time, lateness)
        .groupBy(*keys, F.session_window(time, gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events")
    )


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet table, exactly once per checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()

"""Event-time aggregates that run alike on a table and on a stream.

A table needs no watermark.  On a stream a window is emitted once the
watermark has passed its end, and later rows of it are dropped, as the caller
asks for by ``late``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream gets its watermark, which takes instants only."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if df.isStreaming else df


def _rollup(df: DataFrame, ts: str, keys: list[str], span: Column, late: str, value: str) -> DataFrame:
    kind = df.schema[ts].dataType
    rolled = _timed(df, ts, late).groupBy(*keys, span.alias("__w")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("amount"))
    return rolled.select(*keys, F.col("__w.start").cast(kind).alias("since"), F.col("__w.end").cast(kind).alias("until"), "n", "amount")


def tumbling(df: DataFrame, ts: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum for each window; windows overlap if ``slide`` is shorter than ``size``."""
    return _rollup(df, ts, keys, F.window(ts, size, slide) if slide else F.window(ts, size), late, value)


def sessions(df: DataFrame, ts: str, keys: list[str], value: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Count and sum for each run of events with pauses shorter than ``gap``; a session ends a gap after its last event."""
    return _rollup(df, ts, keys, F.session_window(ts, gap), late, value)


def deduplicated(df: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once; a stream forgets a key when the watermark has passed it."""
    return _timed(df, ts, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])

"""Event streams: tumbling, sliding and session windows with a watermark, the same on batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, keys: list[str], window: Column, late: str | None = None, **aggregates: Column) -> DataFrame:
    """``keys, window_start, window_end`` and aggregates; rows later than ``late`` are dropped by streams.

    Works on streams and on batches, where nothing is late. Rows without time are left out.
    """
    rows = df.where(F.col(time).isNotNull())
    if late:
        rows = rows.withWatermark(time, late)
    grouped = rows.groupBy(window.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggregates)


def tumbling(time: str, width: str) -> Column:
    return F.window(time, width)


def sliding(time: str, width: str, step: str) -> Column:
    return F.window(time, width, step)


def sessions(time: str, gap: str) -> Column:
    return F.session_window(time, gap)

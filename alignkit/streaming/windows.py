"""Weighted means on a fixed grid over a stream.

The batch grid takes its anchor from all data; a stream cannot, so anchor and length are given. Rows
later than the watermark are dropped, and a window is emitted once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, finite_or_zero, noise_weight


def stream_group_means(rows: DataFrame, time: str, by: list[str], value: str, noise: str | None, length: str, start: str | None = None, late: str = "1 hour") -> DataFrame:
    """``window_start, by, value, weight`` per window of ``length``; windows begin at multiples of the
    length since 1970, moved by ``start``. ``time`` is a timestamp column."""
    weight = F.when(finite(F.col(value)), noise_weight(None if noise is None else F.col(noise))).otherwise(F.lit(0.0))
    window = F.window(time, length, startTime=start) if start else F.window(time, length)
    sums = rows.withWatermark(time, late).groupBy(window, *by).agg(F.sum(weight * finite_or_zero(F.col(value))).alias("_num"), F.sum(weight).alias("weight"))
    return sums.select(F.col("window.start").alias("window_start"), *by, F.when(F.col("weight") > 0, F.col("_num") / F.col("weight")).otherwise(F.lit(0.0)).alias("value"), "weight")

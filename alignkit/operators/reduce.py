"""Noise-weighted means over groups of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, finite_or_zero, noise_weight


def weighted_group_mean(cells: DataFrame, by: list[str], value: str, noise: str | None = None) -> DataFrame:
    """``by, value, weight``: sum(w d) / sum(w) with w = 1 / noise^2; cells that are not finite have no
    weight, and a group without weight has the value 0, not null.

    One aggregation with map-side combining; a hot group arrives as one partial row per task.
    """
    weight = F.when(finite(F.col(value)), noise_weight(None if noise is None else F.col(noise))).otherwise(F.lit(0.0))
    sums = cells.groupBy(*by).agg(F.sum(weight * finite_or_zero(F.col(value))).alias("_num"), F.sum(weight).alias("weight"))
    return sums.select(*by, F.when(F.col("weight") > 0, F.col("_num") / F.col("weight")).otherwise(F.lit(0.0)).alias("value"), "weight")


def zero_weight_cells(means: DataFrame) -> DataFrame:
    """One row: how many groups have no weight."""
    return means.agg(F.count_if(~(F.col("weight") > 0)).alias("zero_weight_cells"))

"""Fold a signed axis and flatten cubes to matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positive_axis(delays: DataFrame, band: str) -> DataFrame:
    """``band, dly_idx, dly, dly_pos``: strictly positive delays, numbered in ascending order."""
    order = Window.partitionBy(band).orderBy("dly", "dly_idx")
    return delays.where("dly > 0").select(band, "dly_idx", "dly", (F.row_number().over(order) - 1).alias("dly_pos"))


def mirror_index(delays: DataFrame, band: str) -> DataFrame:
    """``band, dly_pos, dly, pos_idx, neg_idx``: for each positive delay the index whose delay is nearest
    to its negative (the lowest index of equals).

    Delays and the wanted negatives are put in one order per band; the nearest is the last delay before
    or the first one after a wanted place. No delay is compared with all others of its band.
    """
    positive = positive_axis(delays, band)
    wanted = positive.select(band, (-F.col("dly")).alias("_at"), F.lit(None).cast(delays.schema["dly_idx"].dataType).alias("_idx"), "dly_idx", "dly", "dly_pos")
    there = delays.groupBy(band, F.col("dly").alias("_at")).agg(F.min("dly_idx").alias("_idx"))
    both = there.unionByName(wanted, allowMissingColumns=True)
    delay = F.when(F.col("_idx").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_idx").alias("idx")))
    order = Window.partitionBy(band).orderBy("_at")
    near = both.select("*", F.last(delay, True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("_below"), F.first(delay, True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("_above"))
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["at"] + F.col("dly")).alias("d"), F.col(c)["idx"].alias("idx")))
    return near.where("dly_pos IS NOT NULL").select(band, "dly_pos", "dly", F.col("dly_idx").alias("pos_idx"), F.least(away("_below"), away("_above"))["idx"].alias("neg_idx"))


def fold_axis(cells: DataFrame, delays: DataFrame, band: str, by: list[str], value: str = "value") -> DataFrame:
    """``band, by, dly_pos, value``: half the sum of the values at a positive delay and at its mirror.

    Each cell is sent to the positions it takes part in, and those are summed: one shuffle, and cells
    are read once. The delays are a small dimension, which Spark broadcasts by its size.
    """
    mirror = mirror_index(delays, band)
    parts = mirror.select(band, "dly_pos", F.explode(F.array("pos_idx", "neg_idx")).alias("dly_idx"))
    return cells.join(parts, [band, "dly_idx"]).groupBy(band, *by, "dly_pos").agg((F.sum(value) / 2.0).alias(value))


def flatten_features(folded: DataFrame, band: str, group: str = "group_id", position: str = "dly_pos") -> DataFrame:
    """Adds ``feature`` = group * positions of the band + position (row-major)."""
    width = folded.groupBy(band).agg((F.max(position) + 1).alias("_width"))
    return folded.join(width, band).withColumn("feature", F.col(group) * F.col("_width") + F.col(position)).drop("_width")


def to_matrix(cells: DataFrame, by: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """One dense row vector per ``by``, ordered by feature."""
    rows = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(feature, value))).alias("_cells"))
    return rows.select(*by, F.transform("_cells", lambda c: c[value]).alias("vector"))


def with_coordinates(folded: DataFrame, coordinates: DataFrame | None, on: list[str]) -> DataFrame:
    """``kpara`` from a supplied dimension (NaN where it is missing) and ``kperp``, always NaN."""
    nan = F.lit(float("nan"))
    out = folded.withColumn("kpara", nan) if coordinates is None else folded.join(coordinates, on, "left").withColumn("kpara", F.coalesce("kpara", nan))
    return out.withColumn("kperp", nan)

"""Keep what can be aligned: live keys, unambiguous rows, windows that every key covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SECONDS_PER_DAY


def select_bands(rows: DataFrame, band: str, bands: list | None = None, pol: str | None = None, code=None) -> DataFrame:
    """Rows of the listed bands (none listed: all) and of one polarisation code. Both are plain
    conditions on stored columns, so they prune partitions and reach the scan."""
    out = rows if not bands else rows.where(F.col(band).isin(bands))
    return out if pol is None else out.where(F.col(pol) == code)


# Polarisation names and their numbers; a pair's code is made of both numbers, 20 added to each.
POLARISATIONS = {"pI": 1, "pQ": 2, "pU": 3, "pV": 4, "xx": -5, "yy": -6, "xy": -7, "yx": -8}


def polpair_code(first: str, second: str | None = None) -> int:
    """Code of a pair of polarisations by name (one name: both halves of the pair)."""
    names = (first, first if second is None else second)
    if unknown := [n for n in names if n not in POLARISATIONS]:
        raise ValueError(f"unknown polarisation {unknown[0]}; known are {', '.join(POLARISATIONS)}")
    a, b = (POLARISATIONS[n] + 20 for n in names)
    return 100 * a + b


def select_polarisation(rows: DataFrame, pol: str, column: str = "polpair") -> DataFrame:
    """Rows of one polarisation pair, named by ``pol``; a pair that no row has is an error."""
    out = rows.where(F.col(column) == polpair_code(pol))
    if out.isEmpty():
        raise ValueError(f"no rows of polarisation {pol}")
    return out


def keep_first_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first ``n`` keys in ascending order (0 or less: all)."""
    if n <= 0:
        return rows
    return rows.join(rows.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def dead_keys(rows: DataFrame, key: str, re: str, im: str | None = None) -> DataFrame:
    """Keys whose cells are all zero; NaN counts as non-zero, null as zero. Give the rows of the first
    selected band and polarisation."""
    alive = F.col(re) != 0
    alive = alive if im is None else alive | (F.col(im) != 0)
    return rows.groupBy(key).agg(F.max(F.when(alive, 1).otherwise(0)).alias("_alive")).where("_alive = 0").select(key)


def drop_dead_keys(rows: DataFrame, key: str, re: str, im: str | None = None, probe: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not dead in ``probe`` (default: in ``rows``)."""
    return rows.join(dead_keys(rows if probe is None else probe, key, re, im), key, "left_anti")


def drop_ambiguous_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows that are the only one of their key in their window; of several, all go.

    Counted by an aggregation and joined back: a window that holds very many rows of a key is reduced
    before the shuffle instead of being sorted whole.
    """
    single = rows.groupBy(key, "wid").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(key, "wid")
    return rows.join(single, [key, "wid"], "left_semi")


def common_windows(rows: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``wid, time_pos``: windows that every key has, numbered in order.

    ``keys``: the keys that count (default: those of ``rows``). Give the live keys from before
    ambiguous rows were dropped: a key that lost all its rows then leaves no window in common.
    """
    wanted = (rows if keys is None else keys).agg(F.count_distinct(key).alias("_wanted"))
    held = rows.select(key, "wid").distinct().groupBy("wid").agg(F.count(F.lit(1)).alias("_held"))
    common = held.crossJoin(F.broadcast(wanted)).where("_held = _wanted").select("wid")
    return common.select("wid", (F.dense_rank().over(Window.orderBy("wid")) - 1).alias("time_pos"))


def align_rows(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Rows in common windows with their ``time_pos``."""
    return rows.join(common, "wid")


def misaligned(aligned: DataFrame, key: str) -> DataFrame:
    """(key, window) pairs with other than one row; empty for aligned rows."""
    return aligned.groupBy(key, "time_pos").agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def centroid_spread(aligned: DataFrame, time: str) -> DataFrame:
    """One row: the largest spread of times inside a window, in seconds."""
    spread = aligned.groupBy("wid").agg((F.max(time) - F.min(time)).alias("_spread"))
    return spread.agg((F.max("_spread") * SECONDS_PER_DAY).alias("max_spread_seconds"))


def window_coordinate(aligned: DataFrame, key: str, value: str) -> DataFrame:
    """A coordinate per window, taken from the lowest key that has it."""
    return aligned.groupBy("time_pos").agg(F.min_by(value, key).alias(value))

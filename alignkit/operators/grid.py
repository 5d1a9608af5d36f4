"""The window grid: infer its length and anchor from the data, and assign rows to windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SECONDS_PER_DAY
from .align import keep_first_keys
from .ordered import carried, exact_medians

#: Gaps at or above this many seconds between distinct times are not integration steps.
INTEGRATION_LIMIT = 30.0
#: Keys that the window length is inferred from.
SAMPLE_KEYS = 50
#: Days that the anchor lies before the first integration, so that its start never falls on an edge.
MARGIN = 1e-8


@dataclass(frozen=True)
class Grid:
    """The window grid: start of window 0 and length in days, null for a single infinite window."""

    anchor: float | None
    window_days: float | None


def steps(rows: DataFrame, by: list[str], time: str) -> DataFrame:
    """``by, step``: differences between consecutive times of each group, in days."""
    before = carried(rows.select(*by, F.col(time).alias("t")).where("t IS NOT NULL"), by, [F.col("t")], {"_before": F.col("t")})
    return before.where("_before IS NOT NULL").select(*by, (F.col("t") - F.col("_before")).alias("step"))


def infer_window(rows: DataFrame, key: str, time: str, seconds: float = -1.0, sample_keys: int | None = SAMPLE_KEYS) -> DataFrame:
    """One row: ``window_days``, null for a single infinite window.

    ``seconds`` > 0 is the length itself, 0 asks for one window, below 0 the exact median of the time
    steps of each of the first ``sample_keys`` keys (None: all). Fewer than two distinct times, or no
    step at all, give an infinite window.
    """
    spark = rows.sparkSession
    if seconds == 0:
        return spark.range(1).select(F.lit(None).cast("double").alias("window_days"))
    distinct = rows.agg((F.min(time) < F.max(time)).alias("several"))
    if seconds > 0:
        length = F.lit(seconds / SECONDS_PER_DAY)
        return distinct.select(F.when(F.col("several"), length).alias("window_days"))
    sampled = rows if sample_keys is None else keep_first_keys(rows, key, sample_keys)
    middle = exact_medians(steps(sampled, [key], time), [], "step").agg(F.max("median").alias("m"))
    return middle.crossJoin(distinct).select(F.when(F.col("several"), F.col("m")).alias("window_days"))


def infer_integration(rows: DataFrame, time: str) -> DataFrame:
    """One row: ``integration_seconds``, the median gap under 30 s between distinct times, else 0.

    A gap under the limit joins a time to one of its own cell of 30 s or of the cell before, so times
    are ordered inside cells only, and a cell's first time meets the last one of the cell before.
    """
    times = rows.select(F.col(time).alias("t"), F.floor(F.col(time) * (SECONDS_PER_DAY / INTEGRATION_LIMIT)).alias("_cell")).where("t IS NOT NULL").distinct()
    order = Window.partitionBy("_cell").orderBy("t")
    inside = times.select(F.col("t"), F.lag("t").over(order).alias("_before")).where("_before IS NOT NULL")
    ends = times.groupBy("_cell").agg(F.min("t").alias("t"), F.max("t").alias("_last"))
    across = ends.select("_cell", "t").join(ends.select((F.col("_cell") + 1).alias("_cell"), F.col("_last").alias("_before")), "_cell").select("t", "_before")
    gaps = inside.unionAll(across).select(((F.col("t") - F.col("_before")) * SECONDS_PER_DAY).alias("gap")).where(F.col("gap") < INTEGRATION_LIMIT)
    return bounded_median(gaps, "gap", 0.0, INTEGRATION_LIMIT).select(F.coalesce("median", F.lit(0.0)).alias("integration_seconds"))


def bounded_median(values: DataFrame, value: str, low: float, high: float, cells: int = 4096) -> DataFrame:
    """One row: ``median`` of a column with values in [low, high); null if there is none.

    Equal values are counted first. The counts per cell tell which cell holds the middle, and only
    that cell's values are put in order, so no task holds all values.
    """
    counts = values.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.floor((F.col("_v") - low) * (cells / (high - low))))
    sums = counts.groupBy("_cell").agg(F.sum("_n").alias("_n"))
    running = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = sums.select("_cell", (F.sum("_n").over(running) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    first, second = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    own = counts.join(F.broadcast(placed), "_cell")
    order = Window.partitionBy("_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = own.withColumn("_end", F.col("_before") + F.sum("_n").over(order))
    at = lambda k: F.max(F.when((k < F.col("_end")) & (k >= F.col("_end") - F.col("_n")), F.col("_v")))
    return ranked.agg(((at(first) + at(second)) / 2.0).alias("median"))


def window_grid(rows: DataFrame, key: str, time: str, seconds: float = -1.0, sample_keys: int | None = SAMPLE_KEYS) -> DataFrame:
    """One row: ``anchor, window_days``."""
    start = rows.agg(F.min(time).alias("first"))
    integration = infer_integration(rows, time)
    anchor = F.col("first") - F.col("integration_seconds") / SECONDS_PER_DAY / 2.0 - MARGIN
    return start.crossJoin(integration).crossJoin(infer_window(rows, key, time, seconds, sample_keys)).select(anchor.alias("anchor"), "window_days")


def settled(grid: DataFrame) -> Grid:
    """The grid's one row, taken once: as literals it keeps every later plan to one scan of its rows."""
    row = grid.first()
    return Grid(row.anchor, row.window_days)


def assign_windows(rows: DataFrame, grid: DataFrame | Grid, time: str) -> DataFrame:
    """``rows`` with ``wid`` and ``centre``: floor((t - anchor) / length) and the middle of that window;
    an infinite window has the id 0 and the centre 0."""
    if isinstance(grid, Grid):
        anchor, length = F.lit(grid.anchor).cast("double"), F.lit(grid.window_days).cast("double")
        wid = F.lit(0).cast("long") if grid.window_days is None else F.floor((F.col(time) - anchor) / length)
        centre = F.lit(0.0) if grid.window_days is None else anchor + (F.col("wid") + 0.5) * length
        return rows.withColumn("wid", wid).withColumn("centre", centre)
    wid = F.when(F.col("window_days").isNull(), F.lit(0).cast("long")).otherwise(F.floor((F.col(time) - F.col("anchor")) / F.col("window_days")))
    centre = F.when(F.col("window_days").isNull(), F.lit(0.0)).otherwise(F.col("anchor") + (F.col("wid") + 0.5) * F.col("window_days"))
    return rows.crossJoin(F.broadcast(grid)).withColumn("wid", wid).withColumn("centre", centre).drop("anchor", "window_days")

"""Neighbours in order and exact medians, for groups of any size: no task sorts or holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise

#: Cells that a range of values is cut into, to tell which one holds a rank, and how many values may be put in
#: order at the end.
CELLS, FEW = 1024, 4096


def dealt_in_order(rows: DataFrame, by: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """``rows`` stored in ranges of (``by``, ``order``), with the number of each row's range as ``_part``."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "in-order")


def carried(rows: DataFrame, by: list[str], order: list[Column], values: dict[str, Column], itself: bool = False, parts: int | None = None) -> DataFrame:
    """``rows`` with, for each of ``values``, its last non-null value in the rows of the group before this one
    in order (``itself``: up to this one), null if there is none.

    Rows are dealt out in ranges, in which the values are carried; what goes over a border is the last
    value of a group in a range, a row for each group and range that holds some of it. ``order`` must
    tell the rows of a group apart, or those that it doesn't must have equal values.
    """
    table = dealt_in_order(rows, by, order, parts)
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    found = table.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_in_{n}") for n, v in values.items()])
    over = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = table.select("_part", *by, *[F.last(v, ignorenulls=True).over(over).alias(f"_end_{n}") for n, v in values.items()]).distinct()
    ranges = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in by], *[F.last(f"_end_{n}", ignorenulls=True).over(ranges).alias(f"_before_{n}") for n in values])
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return found.join(before, same).select(*rows.columns, *[F.coalesce(f"_in_{n}", f"_before_{n}").alias(n) for n in values])


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "at", parts: int | None = None, weight: Column | None = None) -> DataFrame:
    """``rows`` with their place in the group in order, from 0: the place in a range, and the group's rows in the
    ranges before. ``order`` must tell the rows of a group apart. ``weight``: the sum over the rows before, not their
    number."""
    table = dealt_in_order(rows, by, order, parts)
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    placed = table.withColumn("_in", F.row_number().over(inside) - 1 if weight is None else F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - weight)
    counts = table.groupBy("_part", *by).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    ranges = Window.partitionBy(*by).orderBy("_part")
    before = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in by], (F.sum("_n").over(ranges) - F.col("_n")).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return placed.join(before, same).select(*rows.columns, (F.col("_before") + F.col("_in")).alias(name))


def exact_medians(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, median`` of each group's values that are neither null nor NaN; groups without any are left out.

    Selection by counts, as by digits: values are counted by power of two and sign, then by ``CELLS`` equal
    cells of the range that holds the middle, until that range is one value or has at most ``FEW``, which
    are put in order. A round hands on a count, the least and the largest value for each group and cell;
    what is stored between rounds is a row for each group. No round depends on known limits, and none
    gathers a group.
    """
    x = F.col("_v")
    held = materialise(values.select(*by, F.col(value).cast("double").alias("_v")).where(x.isNotNull() & ~F.isnan("_v")), "median-values")
    size = F.floor(F.log2(F.abs(x)))
    power = F.when(x == 0, 0).when(F.abs(x) == float("inf"), F.signum(x) * 5000).otherwise(F.signum(x) * (size + 2000))
    on = lambda names: [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names]
    joined = lambda state: held.join(state, _all(on(by))) if by else held.crossJoin(F.broadcast(state))

    def chosen(counted: DataFrame, rank: Column) -> DataFrame:
        """Of each group the cell that holds the wanted rank."""
        running = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("_end", F.sum("_n").over(running)).withColumn("_rank", rank)
        kept = placed.where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
        return kept.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_low", "_high", (F.col("_rank") - F.col("_end") + F.col("_n")).alias("_rank"), "_n")

    parts = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    first = held.groupBy(*by, power.cast("int").alias("_cell")).agg(*parts)
    whole = F.floor((F.sum("_n").over(Window.partitionBy(*by)) - 1) / 2)
    state = materialise(chosen(first, whole), "median")
    wide = (F.col("_low") < F.col("_high")) & (F.col("_n") > FEW)
    while not state.where(wide).isEmpty():
        share = (x - F.col("_low")) / (F.col("_high") - F.col("_low")) * CELLS
        near = joined(state.where(wide).drop("_n")).where(x.between(F.col("_low"), F.col("_high")))
        counted = near.groupBy(*by, F.least(F.floor(share), F.lit(CELLS - 1)).alias("_cell"), F.col("_rank").alias("_wanted")).agg(*parts)
        last, state = state, materialise(chosen(counted, F.col("_wanted")).unionByName(state.where(~wide)), "median")
        discard(last)
    # The range that holds the lower of the middle values is one value, or few; the other is the next one.
    inside = x.between(F.col("_low"), F.col("_high"))
    last = joined(state.drop("_n")).groupBy(*by, "_low", "_high", "_rank").agg(F.count(F.lit(1)).alias("_n"), F.count_if(x <= F.col("_high")).alias("_upto"), F.min(F.when(x > F.col("_high"), x)).alias("_next"), F.sort_array(F.collect_list(F.when(inside & (F.col("_low") < F.col("_high")), x))).alias("_few"))
    at = lambda k: F.coalesce(F.get("_few", k.cast("int")), F.col("_low"))
    low = at(F.col("_rank"))
    inner = F.when(F.floor(F.col("_n") / 2) < F.col("_upto"), at(F.col("_rank") + 1)).otherwise(F.col("_next"))
    high = F.when(F.col("_n") % 2 == 1, low).otherwise(inner)
    return last.select(*by, F.when(low == high, low).otherwise((low + high) / 2.0).alias("median"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out

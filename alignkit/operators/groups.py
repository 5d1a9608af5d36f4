"""Redundant groups: keys whose lengths agree within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise
from .ordered import carried, numbered


def tolerance_groups(keys: DataFrame, key: str, value: str, tol: float) -> DataFrame:
    """``key, value, group_id``: a new group begins where the next larger value is over ``tol`` away.

    Works on the key dimension, a row per key. A key's value is spread over coarse cells of ``tol``
    width first, so the running order is taken over distinct cells and not over all keys.
    """
    cell = F.floor(F.col(value) / tol)
    cells = keys.groupBy(cell.alias("_cell")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    # Inside a cell neighbours are within tol; a group can only begin at a cell's least value.
    order = Window.orderBy("_cell")
    begins = F.when(F.lag("_high").over(order).isNull() | (F.col("_low") - F.lag("_high").over(order) > tol), 1).otherwise(0)
    numbered = cells.withColumn("_new", begins).withColumn("group_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return keys.withColumn("_cell", cell).join(numbered.select("_cell", "group_id"), "_cell").select(key, value, "group_id")


def anchored_groups(keys: DataFrame, key: str, value: str, tol: float, parts: int | None = None) -> DataFrame:
    """``key, value, group_id``: a group holds the values up to ``tol`` above its first one, its anchor; the next
    larger value opens the next group. Keys without a value are in no group.

    Which value opens a group depends on all before it, but not on the way there: each distinct value's
    successor is the first value over ``tol`` above it, and the anchors are what is reached from a value
    with no other within ``tol`` below it. The reached values and the successors' jumps are doubled in
    turn, so the rounds are as the logarithm of the groups in the longest chain, each round a join.
    """
    held = keys.where(F.col(value).isNotNull())
    places = held.select(F.col(value).cast("double").alias("v")).distinct()
    wanted = places.select((F.col("v") + F.lit(float(tol))).alias("at"), F.col("v").alias("of")).unionByName(places.select(F.col("v").alias("at")), allowMissingColumns=True)
    # In falling order a value that equals a wanted place comes after it, as it is not over the tolerance away.
    order = [F.desc("at"), F.col("of").isNull().asc(), F.desc("of")]
    after = carried(wanted, [], order, {"next": F.when(F.col("of").isNull(), F.col("at"))}, parts=parts).where("of IS NOT NULL").select("of", "next")
    after = materialise(after, "successors")
    below = carried(places, [], [F.col("v")], {"before": F.col("v")}, parts=parts)
    reached = materialise(below.where(F.col("before").isNull() | (F.col("v") > F.col("before") + F.lit(float(tol)))).select("v"), "anchors")
    jump = after.where("next IS NOT NULL")
    while True:
        more = reached.join(jump, F.col("v") == F.col("of")).select(F.col("next").alias("v")).join(reached, "v", "left_anti")
        grown = materialise(reached.unionAll(more).distinct(), "anchors")
        on = jump.select(F.col("of").alias("next"), F.col("next").alias("_then"))
        further = materialise(jump.join(on, "next").select("of", F.col("_then").alias("next")), "jumps")
        last, reached, jump = (reached, jump), grown, further
        for old in last:
            discard(old)
        if jump.isEmpty():
            break
    # With no jump left, the last round has reached what there is. Anchors are numbered by ranges.
    found = numbered(reached, [], [F.col("v")], "group_id", parts)
    opened = carried(places.join(found, "v", "left"), [], [F.col("v")], {"own": F.col("group_id")}, itself=True, parts=parts)
    return held.join(opened.select(F.col("v").alias("_v"), F.col("own").alias("group_id")), F.col(value).cast("double") == F.col("_v")).select(key, value, "group_id")


def restrict_groups(members: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Members that are live, with groups that become empty gone and the rest renumbered in order."""
    kept = members.join(live.select(key).distinct(), key, "left_semi")
    numbers = kept.select("group_id").distinct().select("group_id", (F.dense_rank().over(Window.orderBy("group_id")) - 1).alias("_dense"))
    return kept.join(numbers, "group_id").drop("group_id").withColumnRenamed("_dense", "group_id")


def group_summary(members: DataFrame, key: str, value: str) -> DataFrame:
    """``group_id, group_len, group_rep, n_keys``: length and key of each group's first member."""
    first = F.struct(value, key)
    return members.groupBy("group_id").agg(F.min(first).alias("_f"), F.count(F.lit(1)).alias("n_keys")).select("group_id", F.col("_f")[value].alias("group_len"), F.col("_f")[key].alias("group_rep"), "n_keys")

"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    lower = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(lower, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(lower.select("a", F.col("m").alias("b"))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node, component`` (smallest node that can be reached) for each node of ``pairs(a, b)``.

    Each step's minimum per node is an aggregation with map-side combining, and the join that hands
    it back is a plain equi-join that Spark may split where a star's centre is hot. Each round is
    written to the shared folder; the rounds end when the edges stop changing. Pairs of a node with
    itself and repeated pairs do no harm; no pairs give no rows.
    """
    edges = materialise(pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        digest = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if digest == seen or not digest[0]:
            break
        seen, last, edges = digest, edges, materialise(_stars(edges), "edges")
        discard(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Inventory of data products: censuses, histograms, joins of metadata, and manifest comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_kind(identifier: Column) -> Column:
    """``auto`` if both halves of ``a_b`` agree, else ``cross``."""
    return F.when(F.get(F.split(identifier, "_"), 0).eqNullSafe(F.get(F.split(identifier, "_"), 1)), "auto").otherwise("cross")


def file_census(listing: DataFrame, has_spectrum: Column) -> DataFrame:
    """One row of counts over a listing with ``identifier``: all files, those with a spectrum, autos,
    cross, and cross without a spectrum."""
    cross = file_kind(F.col("identifier")) == "cross"
    return listing.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(has_spectrum).alias("n_spectra"),
        F.count_if(~cross).alias("n_autos"),
        F.count_if(cross).alias("n_cross"),
        F.count_if(cross & ~has_spectrum).alias("n_cross_without_spectrum"),
    )


def missing_products(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` without a partner in ``found``."""
    return wanted.join(found.select(key), key, "left_anti")


def dir_counts(listing: DataFrame) -> DataFrame:
    return listing.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"))


def size_by_family(listing: DataFrame, family: str, length: str) -> DataFrame:
    return listing.groupBy(family).agg(F.sum(length).alias("total_bytes"))


def name_histogram(names: DataFrame, name: Column, prefix: str = "zen\\.", tail: str = "\\.[0-9].*$") -> DataFrame:
    """How many names share a stem: what comes up to ``prefix`` and from the first digit after a full
    stop on is cut off."""
    stem = F.regexp_replace(F.regexp_replace(name, f"^.*?{prefix}", ""), tail, "")
    return names.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n"))


def stage_topk(names: DataFrame, stage: Column, k: int = 12) -> DataFrame:
    """The ``k`` most frequent stages; equals in order of name."""
    return names.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stage").limit(k)


def join_metadata(products: DataFrame, metadata: DataFrame, label: str = "meta_label") -> DataFrame:
    """Every product with the metadata record of its label; none gives nulls."""
    meta = metadata.withColumnRenamed("label", "_label")
    return products.join(meta, F.col(label) == F.col("_label"), "left").drop("_label")


def diff_manifests(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, change`` (added, removed or changed) and the names of the columns that differ."""
    values = [c for c in old.columns if c != key]
    # A null key is a key like any other: presence is told by a mark.
    a, b = old.select(F.lit(True).alias("_in_old"), F.col(key).alias("_old"), *[F.col(c).alias(f"_a_{c}") for c in values]), new.select(F.lit(True).alias("_in_new"), F.col(key).alias("_new"), *[F.col(c).alias(f"_b_{c}") for c in values])
    both = a.join(b, F.col("_old").eqNullSafe(F.col("_new")), "full")
    names = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in values]))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.size(names) > 0, "changed")
    out = both.select(F.coalesce("_old", "_new").alias(key), change.alias("change"), F.when(change == "changed", F.concat_ws(",", names)).alias("columns"))
    return out.where("change IS NOT NULL")

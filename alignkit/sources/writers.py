"""Sinks: sample sets, decomposition tables, provenance, summaries and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the manifest as CSV, in order.
MANIFEST_COLUMNS = ("product_id", "role", "path", "file_format", "n_files", "sky_components", "corruptions", "generator")


def write_samples(run, root: str) -> None:
    """A run's samples and its coordinates, each by branch: ``samples`` also by band, with its rows in
    order of time; ``times`` (time, LST), ``groups`` (length, representative), ``delays`` (delay and wave
    numbers, kperp always NaN)."""
    dealt = run.samples.repartitionByRange("branch", "spw", "time_pos", "feature")
    dealt.sortWithinPartitions("branch", "spw", "time_pos", "feature").write.partitionBy("branch", "spw").parquet(f"{root}/samples")
    for name in ("times", "groups", "delays"):
        getattr(run, name).write.partitionBy("branch").parquet(f"{root}/{name}")


def write_decomposition(run, root: str, label: str, threshold: float, aligned=None) -> None:
    """``mean, spectrum, components, scores`` and ``needed`` of a run, each by label and band; with the
    aligned run it came from, also its coordinates beside."""
    for name in ("mean", "spectrum", "components", "scores", "needed"):
        table = getattr(run, name)
        if name == "needed":
            table = table.withColumn("variance_threshold", F.lit(threshold))
        table.withColumn("label", F.lit(label)).write.partitionBy("label", "spw").parquet(f"{root}/{name}")
    if aligned is not None:
        for name in ("times", "groups", "delays"):
            getattr(aligned, name).withColumn("label", F.lit(label)).write.partitionBy("label").parquet(f"{root}/{name}")


def summary_document(summary: DataFrame, label: str) -> DataFrame:
    """One row: label and the bands' records in order."""
    record = F.struct(*[c for c in summary.columns])
    return summary.agg(F.sort_array(F.collect_list(record)).alias("spws")).select(F.lit(label).alias("label"), "spws")


def write_json(document: DataFrame, path: str, pretty: bool = False) -> None:
    """JSON lines, or indented documents of two spaces."""
    if pretty:
        document.select(F.to_json(F.struct(*document.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)
    else:
        document.write.option("ignoreNullFields", False).json(path)


def manifest_document(products: DataFrame, facts: dict[str, str], sizes: DataFrame | None = None) -> DataFrame:
    """One nested row: header facts, total bytes per directory, and all products in order of id."""
    packed = products.agg(F.sort_array(F.collect_list(F.struct("product_id", *[c for c in products.columns if c != "product_id"]))).alias("products"), F.count(F.lit(1)).alias("n_products"))
    if sizes is not None:
        packed = packed.crossJoin(sizes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dir", "total_bytes")))).alias("total_sizes")))
    return packed.select(*[F.lit(v).alias(k) for k, v in facts.items()], *[c for c in ("total_sizes",) if sizes is not None], "n_products", "products")


def write_manifest_parts(products: DataFrame, facts: dict[str, str], path: str, key: str = "product_id") -> None:
    """The manifest document as text over many files: read in order of their names they are one JSON document, the
    facts first, then a line for each product in order of ``key``.

    Lines are dealt out by ranges of the key, so no task holds the products; a line knows by the least key
    whether a comma goes before it.
    """
    first = products.agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    line = F.to_json(F.struct(*products.columns), {"ignoreNullFields": "false"})
    mark = F.when(F.col(key).eqNullSafe(F.col("_first")), F.lit("")).otherwise(F.lit(","))
    body = products.crossJoin(F.broadcast(first)).select(F.lit(1).alias("_part"), F.col(key).alias("_key"), F.concat(mark, line).alias("value"))
    given = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in facts.items()])) if facts else F.lit("{}")
    opened = F.concat(F.regexp_replace(given, r"\}$", ""), F.lit(", " if facts else ""), F.lit('"n_products": '), F.col("_n").cast("string"), F.lit(', "products": ['))
    none = F.lit(None).cast(products.schema[key].dataType)
    ends = first.select(F.lit(0).alias("_part"), none.alias("_key"), opened.alias("value")).unionAll(first.select(F.lit(2).alias("_part"), none.alias("_key"), F.lit("]}").alias("value")))
    body.unionAll(ends).repartitionByRange("_part", "_key").sortWithinPartitions("_part", "_key").select("value").write.text(path)


def read_manifest_parts(lines: DataFrame, schema: str) -> DataFrame:
    """The products of a document that ``write_manifest_parts`` made, from its lines ``value``."""
    return lines.where(F.trim("value").rlike(r'^,?\{"') & ~F.col("value").endswith("[")).select(F.from_json(F.ltrim("value", F.lit(",")), schema).alias("p")).select("p.*")


def write_manifest_csv(products: DataFrame, path: str) -> None:
    """The manifest's columns in order with a header; null is an empty field."""
    products.select(*[c for c in MANIFEST_COLUMNS if c in products.columns]).coalesce(1).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)

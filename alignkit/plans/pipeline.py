"""Whole runs: align spectra to samples, decompose them, contrast two branches, build an inventory."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import logged_at
from ..operators import align, catalog, decompose, grid, groups, match, reduce, reshape
from ..sources import writers
from ..sources.scratch import file_facts, materialise, observed

VERSION = "0.2"


@dataclass(frozen=True)
class AlignParams:
    """Parameters of one alignment; ``window_seconds`` below 0 infers the length, 0 means one window."""

    window_seconds: float = -1.0
    max_keys: int = 0
    bands: tuple[int, ...] = ()
    length_tol: float = 1.0
    pol: str | None = None
    check_spread: bool = True


@dataclass(frozen=True)
class Aligned:
    """``samples(branch, spw, time_pos, group_id, dly_pos, feature, value)`` with its coordinates ``times(branch,
    time_pos, time_jd, lst_rad)``, ``groups(branch, group_id, group_len, group_rep, n_keys)``, ``delays(branch, spw,
    dly_pos, dly, kpara)``, the ``counters`` of the run (one row), and its parameters and seconds."""

    samples: DataFrame
    times: DataFrame
    groups: DataFrame
    delays: DataFrame
    counters: DataFrame
    parameters: dict = field(default_factory=dict)
    seconds: float = 0.0


def align_samples(cells: DataFrame, delays: DataFrame, lengths: DataFrame, params: AlignParams = AlignParams(), branch: str = "all", kparas: DataFrame | None = None) -> Aligned:
    """Align cells ``spw, blpair, time_jd, lst_rad, dly_idx, value`` (``noise`` and ``polpair`` optional) on common
    windows, average redundant groups and fold the delay axis.

    Keys and times are aligned on the narrow table of (key, time) pairs first; only its rows, joined
    back, select the wide cells. The pairs, the aligned pairs and the samples are written once to the
    shared folder, so each step's plan starts from a table. An empty result raises ``ValueError``, as
    do a spread over the window length and a polarisation that no cell has.
    """
    began, spark = time.perf_counter(), cells.sparkSession
    count = F.count(F.lit(1))
    cells = align.select_bands(cells, "spw", list(params.bands))
    if params.pol is not None:
        cells = align.select_polarisation(cells, params.pol).drop("polpair")
    cells = align.keep_first_keys(cells, "blpair", params.max_keys)
    grouped = "noise" in cells.columns
    first = cells.agg(F.min("spw").alias("_spw"))
    probed = F.when(F.col("spw") == F.col("_spw"), F.when(F.col("value") != 0, 1).otherwise(0))
    place = F.struct("time_jd", "lst_rad")
    keys = cells.crossJoin(F.broadcast(first)).groupBy("blpair").agg(F.coalesce(F.max(probed), F.lit(1)).alias("_alive"), F.min(place).alias("_first"))  # the broadcast is one row
    pairs = cells.select("blpair", "time_jd", "lst_rad").distinct().join(keys, "blpair").withColumn("_new", place == F.col("_first")).drop("_first")
    live, dead = F.col("_alive") == 1, F.col("_alive") == 0
    times, seen = observed(pairs, "align-times", live_pairs=F.count_if(live), live_keys=F.count_if(live & F.col("_new")), dead_keys=F.count_if(dead & F.col("_new")))
    alive = times.where(live).select("blpair", "time_jd", "lst_rad")
    # One row decides the grid; as literals it keeps every later plan short.
    found = grid.settled(grid.window_grid(alive, "blpair", "time_jd", params.window_seconds))
    assigned = grid.assign_windows(alive, found, "time_jd")
    single, kept = observed(align.drop_ambiguous_rows(assigned, "blpair"), "align-single", pairs=count)
    common = align.common_windows(single, "blpair", alive)
    aligned = materialise(align.align_rows(single, common), "align-rows")
    spread = (F.max("time_jd") - F.min("time_jd")).alias("_spread")
    centres = aligned.groupBy("time_pos").agg(F.min("centre").alias("time_jd"), F.min_by("lst_rad", "blpair").alias("lst_rad"), spread)
    centres, windows = observed(centres, "align-centres", n=count, widest=F.max("_spread"))
    if not windows["n"]:
        raise ValueError("no window is common to all keys")
    widest = windows["widest"] * 86400.0
    if params.check_spread and found.window_days is not None and widest > found.window_days * 86400.0:
        raise ValueError("times inside a window spread over more than its length")
    members = groups.restrict_groups(groups.tolerance_groups(lengths, "blpair", "length_m", params.length_tol), aligned, "blpair")
    wide = cells.join(aligned.select("blpair", "time_jd", "time_pos"), ["blpair", "time_jd"]).join(members.select("blpair", "group_id"), "blpair")
    means = reduce.weighted_group_mean(wide, ["spw", "time_pos", "group_id", "dly_idx"], "value", "noise" if grouped else None)
    means, weightless = observed(means, "align-means", cells=F.count_if(~(F.col("weight") > 0)))
    folded = reshape.flatten_features(reshape.fold_axis(means, delays, "spw", ["time_pos", "group_id"]), "spw")
    samples = materialise(folded.withColumn("branch", F.lit(branch)), "align-samples")
    summary, grouped_keys = observed(groups.group_summary(members, "blpair", "length_m").withColumn("branch", F.lit(branch)), "align-groups", n=count, keys=F.sum("n_keys"))
    axis = reshape.with_coordinates(reshape.positive_axis(delays, "spw"), kparas, ["spw", "dly_idx"]).select("spw", "dly_pos", "dly", "kpara", "kperp").withColumn("branch", F.lit(branch))
    counters = spark.range(1).select(
        F.lit(seen["dead_keys"]).cast("long").alias("dropped_dead_keys"), F.lit(windows["n"]).cast("long").alias("n_common_windows"), F.lit(grouped_keys["n"]).cast("long").alias("n_groups"),
        F.lit(grouped_keys["keys"]).cast("long").alias("n_live_keys"), F.lit(weightless["cells"]).cast("long").alias("zero_weight_cells"), F.lit(found.anchor).cast("double").alias("anchor"),
        F.lit(found.window_days).cast("double").alias("window_days"), F.lit(widest).alias("max_spread_seconds"), F.lit(seen["live_pairs"] - kept["pairs"]).cast("long").alias("dropped_ambiguous_rows"),
    )
    parameters = asdict(params) | {"branch": branch, "weights": "1 / noise^2" if grouped else "uniform"}
    return Aligned(samples, centres.drop("_spread").withColumn("branch", F.lit(branch)), summary, axis, counters, parameters, time.perf_counter() - began)


def provenance(run: Aligned, inputs: dict[str, str], command: str) -> DataFrame:
    """One nested row about a run: each input's path, time of modification and size, parameters, counters,
    the shape of each band, version, command, seconds and the time of logging."""
    spark = run.samples.sparkSession
    facts = [(name, path, *file_facts(spark, path)) for name, path in sorted(inputs.items())]
    given = spark.createDataFrame([(facts, json.dumps(run.parameters, sort_keys=True), VERSION, command, float(run.seconds))], "inputs array<struct<name: string, path: string, mtime: double, size: long>>, parameters string, version string, command string, runtime_sec double")
    extents = run.samples.groupBy("spw").agg(*[F.count_distinct(c).alias(n) for c, n in (("time_pos", "n_times"), ("group_id", "n_groups"), ("dly_pos", "n_delays"))])
    shape = extents.agg(F.sort_array(F.collect_list(F.struct("spw", "n_times", "n_groups", "n_delays"))).alias("spws"))
    kinds = ", ".join(f"{k}: {'array<int>' if isinstance(v, (list, tuple)) else {bool: 'boolean', int: 'int', float: 'double'}.get(type(v), 'string')}" for k, v in sorted(run.parameters.items()))
    return given.withColumn("parameters", F.from_json("parameters", f"struct<{kinds}>")).withColumn("logged_at", logged_at()).crossJoin(run.counters.select(F.struct("*").alias("counters"))).crossJoin(shape)


def with_features(aligned: Aligned) -> DataFrame:
    """``spw, time, time_pos, feature, value`` of aligned samples."""
    times = aligned.times.select("time_pos", F.col("time_jd").alias("time"))
    return aligned.samples.join(times, "time_pos").select("spw", "time", "time_pos", "feature", "value")


def with_coordinates(loadings: DataFrame, aligned: Aligned) -> DataFrame:
    """``loadings(spw, feature, ...)`` with the group's length and representative and the delay and
    wave numbers of each feature (kperp is never known)."""
    width = aligned.delays.groupBy("spw").agg((F.max("dly_pos") + 1).alias("_width"))
    placed = loadings.join(width, "spw").withColumn("group_id", F.floor(F.col("feature") / F.col("_width"))).withColumn("dly_pos", (F.col("feature") % F.col("_width")).cast("int"))
    out = placed.join(aligned.groups.select("group_id", "group_len", "group_rep"), "group_id", "left").join(aligned.delays.select("spw", "dly_pos", "dly", "kpara", "kperp"), ["spw", "dly_pos"], "left")
    return out.drop("_width")


def decompose_samples(cells: DataFrame, threshold: float = decompose.THRESHOLD, stored: int = decompose.STORED, band: str | list[str] = "spw") -> decompose.Decomposition:
    """Decomposition of cells, which are written once with what is not finite replaced by 0; ``n_replaced`` of
    the result is how many were, counted in that write."""
    kept, seen = observed(decompose.zero_nonfinite(cells), "decompose-cells", replaced=F.count_if("replaced"))
    run = decompose.Decomposition(kept.drop("replaced"), band, stored, threshold, store=materialise)
    run.n_replaced = seen["replaced"]
    return run


def contrast_samples(left: DataFrame, right: DataFrame, tol_seconds: float = 60.0) -> DataFrame:
    """``spw, time, time_pos, feature, value``: left minus right at matched times, renumbered.

    Bands without a partner are skipped; differing feature counts or no match raise ``ValueError``. One
    row per band and side is looked at for that; the matched times are written once.
    """
    shape = match.pair_branches(left, right).collect()
    if any(r.left_features != r.right_features for r in shape):
        raise ValueError("feature counts differ between the branches")
    bands = [r[0] for r in shape]
    times = lambda df: df.where(F.col("spw").isin(bands)).select("spw", "time").distinct()
    pairs = match.tolerance_match(times(left), times(right), ["spw"], tol_seconds / 86400.0)
    order = Window.partitionBy("spw").orderBy("left_time")
    pairs = materialise(pairs.withColumn("time_pos", F.row_number().over(order) - 1), "contrast-pairs")
    if pairs.isEmpty():
        raise ValueError("no times match within the tolerance")
    numbers = pairs.select("spw", F.col("left_time").alias("time"), "time_pos")
    return match.contrast(left, right, pairs.drop("time_pos"), ["spw", "feature"]).join(numbers, ["spw", "time"]).select("spw", "time", "time_pos", "feature", "value")


def run_branches(left: Aligned, right: Aligned, tol_seconds: float = 60.0) -> dict[str, decompose.Decomposition]:
    """Decompositions of both branches and of their contrast, in one plan keyed by run and band; the
    contrast runs only if both have."""
    a, b = with_features(left), with_features(right)
    parts = {"left": a, "right": b, "contrast": contrast_samples(a, b, tol_seconds)}
    both = None
    for name, part in parts.items():
        own = part.withColumn("run", F.lit(name)).withColumn("time_pos", F.col("time_pos").cast("long"))
        both = own if both is None else both.unionByName(own)
    whole = decompose_samples(both, band=["run", "spw"])
    return {name: whole.of(run=name) for name in parts}


def build_inventory(listing: DataFrame, products: DataFrame, metadata: DataFrame, facts: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Counts and sizes of a listing ``dir, name, length``; products (their ``path`` is a directory of the
    listing) with their counted files and metadata; products without metadata (``missing``); and the manifest
    document of them all. Where the listing also has ``identifier`` and ``has_spectrum``, the census of its
    files, which the manifest then holds, and the counts of its name stems."""
    counts, sizes = catalog.dir_counts(listing), catalog.size_by_family(listing, "dir", "length")
    joined = catalog.join_metadata(products, metadata)
    if "path" in products.columns:
        joined = joined.drop("n_files").join(counts.withColumnRenamed("dir", "path"), "path", "left")
    missing = catalog.missing_products(products, metadata.withColumnRenamed("label", "meta_label"), "meta_label")
    parts = {"counts": counts, "sizes": sizes, "products": joined, "missing": missing}
    manifest = writers.manifest_document(joined, facts or {}, sizes)
    if "identifier" in listing.columns:
        parts["census"] = catalog.file_census(listing, F.col("has_spectrum"))
        parts["stems"] = catalog.name_histogram(listing, F.col("name"))
        manifest = manifest.crossJoin(F.broadcast(parts["census"].select(F.struct("*").alias("census"))))  # one row each
    return parts | {"manifest": manifest}

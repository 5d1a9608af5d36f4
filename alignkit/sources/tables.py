"""Scans: spectra, samples, product dimension, listings, JSON lines and header tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import exact_medians

PRODUCT_SCHEMA = (
    "product_id string, role string, path string, file_format string, n_files int, filename_convention string, sky_components string, "
    "corruptions string, generator string, meta_label string, sample_metadata map<string,string>"
)
#: What a metadata line may hold; absent keys are null.
METADATA_SCHEMA = (
    "label string, path string, status string, error string, Ntimes int, Nfreqs int, Nbls int, Nblts int, Npols int, Nants_data int, telescope_name string, instrument string, "
    "vis_units string, phase_type string, freq_range_hz array<double>, time_range_jd array<double>, lst_range_rad array<double>, integration_time_s double, "
    "channel_width_hz double, polarization_array array<int>, history_head string, data_datasets map<string,array<int>>, root_keys array<string>, pspec string"
)


def read_spectra(spark: SparkSession, root: str, group: str = "stokespol", spectrum: str = "interleave_averaged") -> DataFrame:
    """One power-spectrum table; both conditions reach the scan."""
    return spark.read.parquet(root).where((F.col("grp") == group) & (F.col("spectrum") == spectrum))


def describe_spectra(spectra: DataFrame) -> DataFrame:
    """One row: ``n_spws, n_keys, n_rows, n_times``."""
    return spectra.agg(
        F.count_distinct("spw").alias("n_spws"),
        F.count_distinct("blpair").alias("n_keys"),
        F.count_distinct("blpair", "time_jd").alias("n_rows"),
        F.count_distinct("time_jd").alias("n_times"),
    )


def explode_cells(spectra: DataFrame) -> DataFrame:
    """One row per delay: the real part is the value, ``pn_abs`` the noise (null if there is none)."""
    cells = spectra.select("branch", "spw", "blpair", "time_jd", "lst_rad", "pn_abs", F.posexplode("data_re").alias("dly_idx", "value"))
    return cells.withColumn("noise", F.get("pn_abs", F.col("dly_idx"))).drop("pn_abs")


def read_samples(spark: SparkSession, root: str, branch: str | None = None) -> dict[str, DataFrame]:
    """``samples, times, groups, delays`` of sample sets stored by branch and band; a branch without
    files is an error."""
    out = {}
    for name in ("samples", "times", "groups", "delays"):
        table = spark.read.parquet(f"{root}/{name}")
        out[name] = table if branch is None else table.where(F.col("branch") == branch)
    if out["samples"].limit(1).isEmpty():
        raise FileNotFoundError(f"no samples for {branch or 'any branch'} under {root}")
    return out


def band_of_file(path) -> F.Column:
    """Band number from a name that ends in spwNN and an extension; null if there is none."""
    found = F.regexp_extract(path, r"spw(\d+)\.[A-Za-z0-9]+$", 1)
    return F.when(found != "", found.cast("int"))


def read_metadata_jsonl(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    """Metadata records by label; lines that do not start with ``{`` are skipped, and of several records
    with a label the last line wins. Lines are read in splits; one's place is its file, the split's
    offset there and its turn in the split."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn")).alias("at"))
    return last_record_wins(lines, "line", "at", schema)


def last_record_wins(lines: DataFrame, text: str, at: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    records = lines.where(F.col(text).startswith("{")).select(F.from_json(text, schema).alias("record"), F.col(at).alias("_at"))
    last = records.groupBy(F.col("record.label").alias("_label")).agg(F.max_by("record", "_at").alias("record"))
    return last.select("record.*")


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, length`` of regular files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """The curated product dimension, with an explicit schema."""
    if not path.endswith(".csv"):
        return spark.read.schema(PRODUCT_SCHEMA).parquet(path)
    # CSV has no maps: there the sample metadata is JSON.
    flat = spark.read.schema(PRODUCT_SCHEMA.replace("map<string,string>", "string")).option("header", True).option("escape", '"').csv(path)
    return flat.withColumn("sample_metadata", F.from_json("sample_metadata", "map<string,string>"))


# Suffixes of file names and the header profile that each calls for, in order.
PROFILE_KINDS = ((".pspec.h5", "pspec"), (".skyh5", "skymodel"))


def profile_kind(path) -> F.Column:
    """Which header profile a file calls for; the longer suffix is tried first."""
    out = F
    for suffix, kind in PROFILE_KINDS:
        out = out.when(path.endswith(suffix), kind)
    return out.otherwise("visibility")


# Header keys of both profiles that are copied as they are.
VISIBILITY_KEYS = ("Ntimes", "Nfreqs", "Nbls", "Nblts", "Npols", "Nants_data", "telescope_name", "instrument", "vis_units", "phase_type")
SKY_KEYS = ("Ncomponents", "Nfreqs", "component_type", "nside", "units", "spectral_type")
#: Array keys whose [min, max] a profile tells, and under which name.
RANGES = {"freq_array": "freq_range_hz", "time_array": "time_range_jd", "lst_array": "lst_range_rad"}
HISTORY_HEAD = 600


def profile_headers(headers: DataFrame, scalars=VISIBILITY_KEYS, ranges: dict[str, str] | None = None, medians: dict[str, str] | None = None, lists: dict[str, str] | None = None, root_always: bool = False) -> DataFrame:
    """One row per file from long headers ``file, part, key, at, value`` (value as text; part ``Header`` or
    ``Data``; ``at`` the place of an array's element, 0 of a scalar):

    present scalars as a map, ``[min, max]`` of array keys, medians of others (a scalar's is itself),
    lists of integers in their order, the history's first 600 characters, of data sets their shapes as a
    map. A file without ``Header`` rows has the sorted names at its root instead (``root_keys``; rows of part
    ``Root``) and nothing else; with ``root_always`` these come with the rest. Absent keys are null.
    """
    number, header = F.expr("try_cast(value AS double)"), F.col("part") == "Header"
    has = F.max(F.when(header, 1))
    own = lambda key, what: F.when(header & (F.col("key") == key), what)
    aggs = [F.map_from_entries(F.sort_array(F.collect_set(F.when(header & F.col("key").isin(*scalars), F.struct("key", "value"))))).alias("scalars")]
    for key, name in (RANGES if ranges is None else ranges).items():
        value = own(key, number)
        aggs.append(F.when(F.count(value) > 0, F.array(F.min(value), F.max(value))).alias(name))
    for key, name in ({"polarization_array": "polarization_array"} if lists is None else lists).items():
        items = F.sort_array(F.collect_list(own(key, F.struct("at", number.cast("int").alias("v")))))
        aggs.append(F.when(F.size(items) > 0, F.transform(items, lambda x: x["v"])).alias(name))
    aggs.append(F.substring(F.min_by(own("history", F.col("value")), own("history", F.col("at"))), 1, HISTORY_HEAD).alias("history_head"))
    axes = F.sort_array(F.collect_list(F.when(F.col("part") == "Data", F.struct("key", "at", number.cast("int").alias("v")))))
    shapes = F.transform(F.array_distinct(F.transform(axes, lambda x: x["key"])), lambda k: F.struct(k.alias("key"), F.transform(F.filter(axes, lambda x: x["key"] == k), lambda x: x["v"]).alias("value")))
    aggs.append(F.when(F.size(axes) > 0, F.map_from_entries(shapes)).alias("data_datasets"))
    aggs.append(F.array_sort(F.collect_set(F.when(F.col("part") == "Root", F.col("key")))).alias("_root"))
    out = headers.groupBy("file").agg(*aggs, has.alias("_has"))
    middles = {"integration_time": "integration_time_s", "channel_width": "channel_width_hz"} if medians is None else medians
    if middles:
        # An array's median is selected by counts, so no task holds a file's whole array.
        cells = headers.where(header & F.col("key").isin(*middles)).select("file", "key", number.alias("v"))
        found = exact_medians(cells, ["file", "key"], "v").groupBy(F.col("file").alias("_file")).agg(*[F.max(F.when(F.col("key") == k, F.col("median"))).alias(n) for k, n in middles.items()])
        out = out.join(found, F.col("file").eqNullSafe(F.col("_file")), "left").drop("_file")
    there = F.lit(True) if root_always else F.col("_has") == 1
    rest = [F.when(there, F.col(c)).alias(c) for c in out.columns if c not in ("file", "_root", "_has")]
    root = F.when((F.size("_root") > 0) & (F.lit(True) if root_always else F.col("_has").isNull()), F.col("_root"))
    return out.select("file", *rest, root.alias("root_keys"))


def profile_sky(headers: DataFrame) -> DataFrame:
    """The profile of sky models: their scalars, frequency range, shapes and root keys."""
    return profile_headers(headers, SKY_KEYS, {"freq_array": "freq_range_hz"}, {}, {}, root_always=True).drop("history_head")


def root_names(headers: DataFrame) -> DataFrame:
    """``file, root_keys``: the sorted names at the root of each file (rows of part ``Root``)."""
    return headers.where("part = 'Root'").groupBy("file").agg(F.array_sort(F.collect_set("key")).alias("root_keys"))


def profile_containers(entries: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Spectrum containers ``file, grp, spectrum, spw, freq``: groups of each file, and the spectra of its
    first group and the frequency range per band of that group's first spectrum only; with ``headers`` also
    the names at the file's root.

    Where ``entries`` also has ``polpair, blpair, time, dly, units, vis_units, taper, norm, history``, of the
    same first spectrum: counts of bands, polarisations, pairs, rows and times, the polarisation codes in
    order, the delays of the first band, and those texts (of the history the first 600 characters).
    """
    listed = entries.groupBy("file").agg(F.array_sort(F.collect_set("grp")).alias("groups"), F.min(F.struct("grp", "spectrum")).alias("_first"), F.array_sort(F.collect_set(F.struct("grp", "spectrum"))).alias("_all"))
    spectra = F.transform(F.filter("_all", lambda x: x["grp"] == F.col("_first.grp")), lambda x: x["spectrum"])
    own = entries.join(listed, "file").where((F.col("grp") == F.col("_first.grp")) & (F.col("spectrum") == F.col("_first.spectrum")))
    bands = own.groupBy("file", "spw").agg(F.array(F.min("freq"), F.max("freq")).alias("freq_range"))
    packed = bands.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("spw", "freq_range"))).alias("spw_ranges"), F.count(F.lit(1)).alias("n_spws"))
    out = listed.select("file", "groups", F.col("_first.grp").alias("first_group"), F.col("_first.spectrum").alias("first_spectrum"), spectra.alias("spectra")).join(packed, "file", "left")
    if headers is not None:
        out = out.join(root_names(headers), "file", "left")
    if "polpair" not in entries.columns:
        return out
    distinct = lambda *c: F.count_distinct(*c)
    facts = own.groupBy("file").agg(
        F.array_sort(F.collect_set("polpair")).alias("polpair_array"), distinct("polpair").alias("n_pols"), distinct("blpair").alias("n_blpairs"), distinct("blpair", "time").alias("n_bltpairs"),
        distinct("time").alias("n_times"), *[F.min(c).alias(c) for c in ("units", "vis_units", "taper", "norm")], F.substring(F.min("history"), 1, HISTORY_HEAD).alias("history_head"),
    )
    zero = own.groupBy("file").agg(F.min("spw").alias("spw"))
    delays = own.join(zero, ["file", "spw"]).groupBy("file").agg(distinct("dly").alias("n_delays"))
    return out.join(facts, "file", "left").join(delays, "file", "left")


def profile_by_kind(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per file: its suffix tells whether it is profiled as a container, a sky model or
    visibilities; what a kind does not have is null."""
    kind = profile_kind(F.col("file"))
    parts = {"visibility": profile_headers(headers.where(kind == "visibility")), "skymodel": profile_sky(headers.where(kind == "skymodel")), "pspec": profile_containers(entries.where(kind == "pspec"), headers.where(kind == "pspec"))}
    out = None
    for name, part in parts.items():
        own = part.withColumn("kind", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def with_status(records: DataFrame, text: str, schema: T.StructType | str) -> DataFrame:
    """Parse a JSON column; each record carries ``status`` ok or error and ``error``, and a bad one
    keeps its other columns."""
    parsed = F.from_json(F.col(text), schema if isinstance(schema, str) else schema.simpleString())
    bad = F.expr(f"try_parse_json(`{text}`)").isNull() | F.col(text).isNull()
    return records.select(
        "*",
        F.when(~bad, parsed).alias("record"),
        F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(bad, F.concat(F.lit("ValueError: cannot parse "), F.coalesce(F.substring(text, 1, 40), F.lit("null")))).alias("error"),
    )


def first_names(listing: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` names of each directory, in order."""
    order = Window.partitionBy("dir").orderBy("name")
    return listing.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

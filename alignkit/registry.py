"""The library's registered queries over the given tables, and the SQL that states their results.

The tables stand in for spectra: ``events`` for irregular series, ``lineitem`` for a dense panel with
noise, ``embeddings`` for matrices, ``supplier`` for baselines, ``documents``, ``pages`` and
``conversations`` for listings and records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import band_label, days, head, key_subset, number_text, rounded, series_code, to_days, to_seconds, to_text
from .operators import align, catalog, decompose, grid, groups, match, ordered, records, reduce, reshape
from .plans import pipeline
from .sources import sample_files, tables, writers
from .sources.scratch import materialise, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MINUTES_20 = 1200.0
DAYS_30 = 30 * 86400.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, *keep) -> DataFrame:
    return _read(spark, sf_dir, "events").select(*keep, days(F.col("ts")).alias("t"))


def _panel(spark, sf_dir) -> DataFrame:
    """The lineitem panel: series, band, time in days, value and noise."""
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("series"), F.col("l_returnflag").alias("band"), days(F.col("l_shipdate")).alias("t"), F.col("l_extendedprice").alias("value"), F.col("l_tax").alias("noise")
    )


_T = "epoch_us(ts) / 86400000000.0::DOUBLE"
_W20 = "1200.0::DOUBLE / 86400.0::DOUBLE"
_INTEGRATION = f"""
  SELECT coalesce(median(gap), 0) AS sec FROM (
    SELECT (t - lag(t) OVER (ORDER BY t)) * 86400.0::DOUBLE AS gap FROM (SELECT DISTINCT {_T} AS t FROM events)) WHERE gap < 30.0"""
_ASSIGNED = f"""
a AS (SELECT (SELECT min({_T}) FROM events) - ({_INTEGRATION}) / 86400.0::DOUBLE / 2.0::DOUBLE - 1e-8::DOUBLE AS anchor),
w AS (SELECT event_id, event_type, {_T} AS t, floor(({_T} - anchor) / ({_W20}))::BIGINT AS wid,
             anchor + (floor(({_T} - anchor) / ({_W20})) + 0.5::DOUBLE) * ({_W20}) AS centre FROM events, a)"""
_SINGLE = f"{_ASSIGNED}, s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY event_type, wid) AS n FROM w) WHERE n = 1)"
_COMMON = f"""{_SINGLE}, c AS (SELECT wid, (dense_rank() OVER (ORDER BY wid) - 1)::INT AS time_pos FROM (
  SELECT wid FROM s GROUP BY wid HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM w)))"""


def _assigned(spark, sf_dir) -> DataFrame:
    rows = _events(spark, sf_dir, "event_id", "event_type")
    return grid.assign_windows(rows, grid.settled(grid.window_grid(rows, "event_type", "t", MINUTES_20)), "t")


def _aligned(spark, sf_dir) -> DataFrame:
    assigned = _assigned(spark, sf_dir)
    single = align.drop_ambiguous_rows(assigned, "event_type")
    return align.align_rows(single, align.common_windows(single, "event_type", assigned))


@query(f"""
WITH e AS (SELECT user_id AS k, {_T} AS t FROM events), f AS (SELECT DISTINCT k FROM e ORDER BY k LIMIT 50)
SELECT round(median(step), 9) AS window_days FROM (SELECT t - lag(t) OVER (PARTITION BY k ORDER BY t) AS step FROM e WHERE k IN (SELECT k FROM f))
""")
def infer_window(spark, sf_dir):
    """A1: median step of the first 50 users."""
    return grid.infer_window(_events(spark, sf_dir, "user_id"), "user_id", "t").select(F.round("window_days", 9).alias("window_days"))


@query(f"SELECT round(sec, 6) AS integration_seconds FROM ({_INTEGRATION})")
def infer_integration(spark, sf_dir):
    """A2: median gap between distinct times."""
    return grid.infer_integration(_events(spark, sf_dir), "t").select(F.round("integration_seconds", 6).alias("integration_seconds"))


@query(f"WITH {_ASSIGNED} SELECT event_id, wid, round(centre, 6) AS centre FROM w")
def assign_windows(spark, sf_dir):
    """A3, A4: events in windows of 20 minutes."""
    return _assigned(spark, sf_dir).select("event_id", "wid", F.round("centre", 6).alias("centre"))


@query(f"WITH {_SINGLE} SELECT event_id, event_type, wid FROM s")
def drop_ambiguous_rows(spark, sf_dir):
    """Events that are the only one of their type in their window."""
    return align.drop_ambiguous_rows(_assigned(spark, sf_dir), "event_type").select("event_id", "event_type", "wid")


@query(f"WITH {_COMMON} SELECT wid, time_pos FROM c")
def common_windows(spark, sf_dir):
    """Windows that every event type covers."""
    assigned = _assigned(spark, sf_dir)
    return align.common_windows(align.drop_ambiguous_rows(assigned, "event_type"), "event_type", assigned)


@query(f"WITH {_COMMON} SELECT event_id, event_type, wid, time_pos FROM s JOIN c USING (wid)")
def align_rows(spark, sf_dir):
    """Events in common windows."""
    return _aligned(spark, sf_dir).select("event_id", "event_type", "wid", "time_pos")


@query(f"WITH {_COMMON} SELECT event_type, time_pos, count(*) AS n FROM s JOIN c USING (wid) GROUP BY ALL HAVING count(*) <> 1")
def misaligned_rows(spark, sf_dir):
    """J2's assertion: (key, window) pairs with other than one row."""
    return align.misaligned(_aligned(spark, sf_dir), "event_type")


@query(f"WITH {_COMMON} SELECT round(max(d) * 86400.0, 4) AS max_spread_seconds FROM (SELECT max(t) - min(t) AS d FROM s JOIN c USING (wid) GROUP BY wid)")
def centroid_spread(spark, sf_dir):
    """The largest spread of times inside a window."""
    return align.centroid_spread(_aligned(spark, sf_dir), "t").select(F.round("max_spread_seconds", 4).alias("max_spread_seconds"))


@query(f"WITH {_COMMON} SELECT time_pos, arg_min(event_id, event_type) AS event_id FROM s JOIN c USING (wid) GROUP BY time_pos")
def window_coordinate(spark, sf_dir):
    """A coordinate per window from its lowest key."""
    return align.window_coordinate(_aligned(spark, sf_dir), "event_type", "event_id")


@query("""
SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_discount END AS x FROM lineitem)
WHERE l_suppkey NOT IN (SELECT l_suppkey FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_discount END AS x FROM lineitem) GROUP BY 1 HAVING max(CASE WHEN x <> 0 THEN 1 ELSE 0 END) = 0)
GROUP BY 1
""")
def drop_dead_keys(spark, sf_dir):
    """Suppliers whose cells are not all zero, with their rows counted."""
    rows = _read(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, 0.0).otherwise(F.col("l_discount")).alias("x"))
    return align.drop_dead_keys(rows, "l_suppkey", "x").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 50)")
def keep_first_keys(spark, sf_dir):
    """Orders of the first 50 customers in order of key."""
    return align.keep_first_keys(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 50)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_linenumber IN (1, 3, 5) AND l_returnflag = 'R'")
def select_bands(spark, sf_dir):
    """Listed bands and one polarisation code; both conditions reach the scan."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return align.select_bands(rows, "l_linenumber", [1, 3, 5], "l_returnflag", "R")


_PANEL = """
p AS (SELECT l_linenumber AS series, l_returnflag AS band, epoch_us(l_shipdate) / 86400000000.0::DOUBLE AS t, l_extendedprice AS value, l_tax AS noise FROM lineitem),
pw AS (SELECT *, floor((t - ((SELECT min(t) FROM p) - 1e-8::DOUBLE)) / 30.0::DOUBLE)::BIGINT AS wid FROM p),
pc AS (SELECT wid FROM pw GROUP BY wid HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM p)),
pm AS (SELECT band, wid, series, sum(x * value) AS num, sum(x) AS weight FROM (SELECT *, CASE WHEN noise > 0 THEN 1 / (noise * noise) ELSE 0 END AS x FROM pw JOIN pc USING (wid)) GROUP BY ALL),
pv AS (SELECT band, wid, series, CASE WHEN weight > 0 THEN num / weight ELSE 0 END AS value, weight FROM pm)"""


def _panel_means(spark, sf_dir) -> DataFrame:
    rows = _panel(spark, sf_dir)
    assigned = grid.assign_windows(rows, grid.settled(grid.window_grid(rows.select("series", "t"), "series", "t", DAYS_30)), "t")
    kept = align.align_rows(assigned, align.common_windows(assigned, "series"))
    return reduce.weighted_group_mean(kept, ["band", "wid", "series"], "value", "noise")


@query(f"WITH {_PANEL} SELECT band, wid, series, round(value, 4) AS value, round(weight, 3) AS weight FROM pv")
def weighted_group_mean(spark, sf_dir):
    """Noise-weighted means per band, window and series."""
    return _panel_means(spark, sf_dir).select("band", "wid", "series", F.round("value", 4).alias("value"), F.round("weight", 3).alias("weight"))


@query(f"WITH {_PANEL} SELECT count(*) FILTER (WHERE NOT weight > 0) AS zero_weight_cells FROM pv")
def zero_weight_cells(spark, sf_dir):
    """Groups without weight."""
    return reduce.zero_weight_cells(_panel_means(spark, sf_dir))


_GROUPS = """
g AS (SELECT s_suppkey, s_acctbal, sum(b) OVER (ORDER BY s_acctbal, s_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS group_id
      FROM (SELECT *, CASE WHEN s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) <= 50 THEN 0 ELSE 1 END AS b FROM supplier))"""


@query(f"WITH {_GROUPS} SELECT s_suppkey, s_acctbal, group_id FROM g")
def tolerance_groups(spark, sf_dir):
    """Suppliers chained by balances within 50."""
    return groups.tolerance_groups(_read(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 50.0)


@query(f"""WITH {_GROUPS}, k AS (SELECT * FROM g WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)), d AS (SELECT *, dense_rank() OVER (ORDER BY group_id) - 1 AS dense FROM k)
SELECT dense::INT AS group_id, min(s_acctbal) AS group_len, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS group_rep, count(*) AS n_keys FROM d GROUP BY dense""")
def group_summary(spark, sf_dir):
    """Groups of the live suppliers (those with a line item), with length and representative."""
    suppliers = _read(spark, sf_dir, "supplier")
    live = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    members = groups.tolerance_groups(suppliers, "s_suppkey", "s_acctbal", 50.0)
    return groups.group_summary(groups.restrict_groups(members, live, "s_suppkey"), "s_suppkey", "s_acctbal")


_AXIS = """
x AS (SELECT DISTINCT l_returnflag AS spw, l_linenumber - 1 AS dly_idx, (l_linenumber - 4)::DOUBLE AS dly FROM lineitem),
xp AS (SELECT *, row_number() OVER (PARTITION BY spw ORDER BY dly) - 1 AS dly_pos FROM x WHERE dly > 0),
xm AS (SELECT * FROM (SELECT p.spw, p.dly_pos, p.dly, p.dly_idx AS pos_idx, x.dly_idx AS neg_idx,
       row_number() OVER (PARTITION BY p.spw, p.dly_pos ORDER BY abs(x.dly + p.dly), x.dly_idx) AS r FROM xp p JOIN x USING (spw)) WHERE r = 1),
xc AS (SELECT l_returnflag AS spw, l_linenumber - 1 AS dly_idx, l_suppkey % 10 AS group_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
xf AS (SELECT m.spw, c.group_id, m.dly_pos, sum(c.value) / 2 AS value FROM (SELECT spw, dly_pos, pos_idx AS i FROM xm UNION ALL SELECT spw, dly_pos, neg_idx FROM xm) m JOIN xc c ON c.spw = m.spw AND c.dly_idx = m.i GROUP BY ALL)"""


def _axis(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("spw"), (F.col("l_linenumber") - 1).alias("dly_idx"), (F.col("l_linenumber") - 4).cast("double").alias("dly")).distinct()


def _folded(spark, sf_dir) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem")
    cells = items.groupBy(F.col("l_returnflag").alias("spw"), (F.col("l_linenumber") - 1).alias("dly_idx"), (F.col("l_suppkey") % 10).alias("group_id")).agg(F.sum("l_quantity").alias("value"))
    return reshape.fold_axis(cells, _axis(spark, sf_dir), "spw", ["group_id"])


@query(f"WITH {_AXIS} SELECT spw, dly_pos::INT AS dly_pos, dly, pos_idx, neg_idx FROM xm")
def mirror_index(spark, sf_dir):
    """The nearest mirror of each positive delay."""
    return reshape.mirror_index(_axis(spark, sf_dir), "spw")


@query(f"WITH {_AXIS} SELECT spw, group_id, dly_pos::INT AS dly_pos, value FROM xf")
def mirror_fold(spark, sf_dir):
    """Values folded over the signed axis."""
    return _folded(spark, sf_dir)


@query(f"WITH {_AXIS} SELECT spw, group_id * (max(dly_pos) OVER (PARTITION BY spw) + 1) + dly_pos AS feature, value FROM xf")
def flatten_features(spark, sf_dir):
    """R2: row-major feature numbers."""
    return reshape.flatten_features(_folded(spark, sf_dir), "spw").select("spw", "feature", "value")


@query(f"WITH {_AXIS}, f AS (SELECT spw, group_id * (max(dly_pos) OVER (PARTITION BY spw) + 1) + dly_pos AS feature, value FROM xf) SELECT spw, string_agg((value * 2)::BIGINT::VARCHAR, ',' ORDER BY feature) AS vector FROM f GROUP BY spw")
def dense_rows(spark, sf_dir):
    """R2: one dense row vector per band, its doubled values shown as text."""
    rows = reshape.to_matrix(reshape.flatten_features(_folded(spark, sf_dir), "spw"), ["spw"])
    return rows.select("spw", F.concat_ws(",", F.transform("vector", lambda v: (v * 2).cast("long").cast("string"))).alias("vector"))


@query(f"WITH {_AXIS} SELECT spw, group_id, dly_pos::INT AS dly_pos, CASE WHEN dly_pos < 2 THEN dly_pos * 0.5::DOUBLE ELSE 'nan'::DOUBLE END AS kpara, 'nan'::DOUBLE AS kperp FROM xf")
def feature_coordinates(spark, sf_dir):
    """Supplied coordinates, NaN where there are none."""
    folded = _folded(spark, sf_dir)
    known = folded.where("dly_pos < 2").select("spw", "dly_pos").distinct().withColumn("kpara", F.col("dly_pos") * 0.5)
    return reshape.with_coordinates(folded, known, ["spw", "dly_pos"]).select("spw", "group_id", "dly_pos", "kpara", "kperp")


_HOURS = "SELECT DISTINCT floor(epoch_us(ts) / 3600000000) * 3600.0::DOUBLE + {shift} AS time FROM events WHERE event_type = '{kind}'"


def _hours(spark, sf_dir, kind: str, shift: float) -> DataFrame:
    events = _read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    return events.select(F.lit(0).alias("spw"), (F.floor(micros / 3600000000) * 3600.0 + shift).alias("time")).distinct()


@query(f"SELECT 0 AS spw, a.time AS left_time, b.time AS right_time FROM ({_HOURS.format(kind='click', shift='0')}) a JOIN ({_HOURS.format(kind='view', shift='600')}) b ON abs(b.time - a.time) <= 900")
def tolerance_match_wide(spark, sf_dir):
    """J5's fast path: hourly grids within 15 minutes."""
    return match.tolerance_match_wide(_hours(spark, sf_dir, "click", 0.0), _hours(spark, sf_dir, "view", 600.0), ["spw"], 900.0)


_OF_USER = "SELECT user_id, {t} * 86400.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY {t}) AS {n} FROM events WHERE event_type = '{kind}'"


@query(f"""
WITH RECURSIVE l AS ({_OF_USER.format(t=_T, n='i', kind='click')}), r AS ({_OF_USER.format(t=_T, n='j', kind='view')}),
g AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS j, NULL::DOUBLE AS left_time, NULL::DOUBLE AS right_time FROM l
  UNION ALL
  SELECT g.user_id, l.i, coalesce(min(r.j), g.j), l.t, min(r.t)
  FROM g JOIN l ON l.user_id = g.user_id AND l.i = g.i + 1 LEFT JOIN r ON r.user_id = g.user_id AND r.j > g.j AND r.t >= l.t - 3600 AND abs(r.t - l.t) <= 3600
  GROUP BY g.user_id, l.i, g.j, l.t)
SELECT user_id, left_time, right_time FROM g WHERE right_time IS NOT NULL
""")
def tolerance_match_greedy(spark, sf_dir):
    """Clicks and views of each user, greedily one to one within an hour."""
    of = lambda kind: _read(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", (days(F.col("ts")) * 86400.0).alias("time"))
    return match.tolerance_match(of("click"), of("view"), ["user_id"], 3600.0)


def _branch(means: DataFrame, band: str) -> DataFrame:
    return means.where(F.col("band") == band).select(F.lit(0).alias("spw"), F.col("wid").cast("double").alias("time"), F.col("series").alias("feature"), "value")


@query(f"WITH {_PANEL} SELECT 0 AS spw, a.series AS feature, a.wid::DOUBLE AS time, round(a.value - b.value, 4) AS value FROM pv a JOIN pv b ON a.wid = b.wid AND a.series = b.series WHERE a.band = 'A' AND b.band = 'R'")
def contrast(spark, sf_dir):
    """One branch minus the other at matched windows."""
    means = _panel_means(spark, sf_dir)
    left, right = _branch(means, "A"), _branch(means, "R")
    times = lambda df: df.select("spw", "time").distinct()
    pairs = match.tolerance_match(times(left), times(right), ["spw"], 0.25)
    return match.contrast(left, right, pairs, ["spw", "feature"]).select("spw", "feature", "time", F.round("value", 4).alias("value"))


@query(f"WITH {_PANEL} SELECT 0 AS spw, count(DISTINCT series) FILTER (WHERE band = 'A') AS left_features, count(DISTINCT series) FILTER (WHERE band = 'R') AS right_features FROM pv")
def pair_branches(spark, sf_dir):
    """Feature counts of the bands that both branches have."""
    means = _panel_means(spark, sf_dir)
    return match.pair_branches(_branch(means, "A"), _branch(means, "R"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 OR l_tax = 0 THEN 0 ELSE 1 / l_discount END AS value, l_discount = 0 OR l_tax = 0 AS replaced FROM lineitem
""")
def zero_nonfinite(spark, sf_dir):
    """NaN and infinite cells become 0 and are marked."""
    bad = F.when(F.col("l_discount") == 0, float("nan")).when(F.col("l_tax") == 0, float("inf")).otherwise(1 / F.col("l_discount"))
    return decompose.zero_nonfinite(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bad.alias("value")))


def _vectors(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("spw"), F.col("vec_id").alias("time_pos"), F.posexplode("embedding").alias("feature", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


_LONG = """
v AS (SELECT label AS spw, vec_id AS time_pos, unnest(range(len(embedding)))::INT AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings),
vm AS (SELECT spw, feature, avg(value) AS mean FROM v GROUP BY ALL),
vc AS (SELECT spw, feature, time_pos, value - mean AS value FROM v JOIN vm USING (spw, feature))"""


@query(f"WITH {_LONG} SELECT spw, feature, round(mean, 8) AS mean FROM vm")
def column_mean(spark, sf_dir):
    """A10: mean of each column per band."""
    return decompose.column_mean(_vectors(spark, sf_dir)).select("spw", "feature", F.round("mean", 8).alias("mean"))


@query(f"WITH {_LONG} SELECT spw, time_pos, feature, round(value, 8) + 0.0 AS value FROM vc")
def centre_columns(spark, sf_dir):
    """Columns minus their means."""
    return decompose.centre_columns(_vectors(spark, sf_dir)).select("spw", "time_pos", "feature", (F.round("value", 8) + 0.0).alias("value"))


@query(f"WITH {_LONG} SELECT a.spw, a.time_pos AS i, b.time_pos AS j, round(sum(a.value * b.value), 6) + 0.0 AS g FROM vc a JOIN vc b ON a.spw = b.spw AND a.feature = b.feature AND a.time_pos <= b.time_pos GROUP BY ALL")
def gram_matrix(spark, sf_dir):
    """D3: sums of products over sharded features."""
    return decompose.gram_matrix(decompose.centre_columns(_vectors(spark, sf_dir), store=materialise)).select("spw", "i", "j", rounded(F.col("g"), 6).alias("g"))


@query(f"WITH {_LONG} SELECT spw, round(sum(value * value), 6) AS total FROM vc GROUP BY spw")
def pca_total_variance(spark, sf_dir):
    """Squared singular values sum to the total variance."""
    return decompose.Decomposition(_vectors(spark, sf_dir)).spectrum.groupBy("spw").agg(F.round(F.sum(F.col("singular_value") * F.col("singular_value")), 6).alias("total"))


@query()
def pca_spectrum(spark, sf_dir):
    """Singular values with their cumulative share; tested against a dense decomposition."""
    return decompose.Decomposition(_vectors(spark, sf_dir)).spectrum


@query()
def pca_scores(spark, sf_dir):
    """Scores of the stored components."""
    return decompose.Decomposition(_vectors(spark, sf_dir)).scores


@query()
def pca_components(spark, sf_dir):
    """Loadings of the stored components."""
    return decompose.Decomposition(_vectors(spark, sf_dir)).components


@query(f"WITH {_LONG} SELECT spw, count(DISTINCT time_pos) AS n_samples, count(DISTINCT feature) AS n_features FROM v GROUP BY spw")
def pca_shape(spark, sf_dir):
    """One summary row per band, made in one plan for all bands."""
    return decompose.Decomposition(_vectors(spark, sf_dir)).summary.select("spw", "n_samples", "n_features")


@query()
def pca_summary(spark, sf_dir):
    """The summary document over all bands."""
    return writers.summary_document(decompose.Decomposition(_vectors(spark, sf_dir)).summary, "embeddings")


_PATH = "regexp_extract(url, '^https?://([^/?#]+)', 1) AS dir, regexp_replace(regexp_replace(url, '^https?://[^/]+/?', ''), '[?#].*$', '') AS name"


def _listing(spark, sf_dir) -> DataFrame:
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("dir"), F.regexp_replace(F.regexp_replace(url, "^https?://[^/]+/?", ""), "[?#].*$", "").alias("name"), F.length("html").cast("long").alias("length"))


@query("""
SELECT count(*) AS n_files, count(*) FILTER (WHERE s) AS n_spectra, count(*) FILTER (WHERE a = b) AS n_autos, count(*) FILTER (WHERE a <> b) AS n_cross, count(*) FILTER (WHERE a <> b AND NOT s) AS n_cross_without_spectrum
FROM (SELECT page_id % 7 AS a, page_id % 5 AS b, url LIKE 'https%' AS s FROM pages)
""")
def file_census(spark, sf_dir):
    """Autos, cross and cross without a spectrum."""
    pages = _read(spark, sf_dir, "pages").select(F.concat_ws("_", F.col("page_id") % 7, F.col("page_id") % 5).alias("identifier"), "url")
    return catalog.file_census(pages, F.col("url").startswith("https"))


@query(f"SELECT dir, count(*) AS n_files FROM (SELECT {_PATH} FROM pages) GROUP BY dir")
def dir_counts(spark, sf_dir):
    """Files per directory."""
    return catalog.dir_counts(_listing(spark, sf_dir))


@query(f"SELECT dir, name, rank::INT AS rank FROM (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY name) AS rank FROM (SELECT DISTINCT {_PATH} FROM pages)) WHERE rank <= 3")
def dir_heads(spark, sf_dir):
    """The first three names of each directory."""
    return tables.first_names(_listing(spark, sf_dir).select("dir", "name").distinct())


@query("SELECT regexp_replace(regexp_replace(url, '^.*?//', ''), '/[0-9].*$', '') AS stem, count(*) AS n FROM pages GROUP BY 1")
def name_histogram(spark, sf_dir):
    """Stems of names between a prefix and the first number."""
    return catalog.name_histogram(_read(spark, sf_dir, "pages"), F.col("url"), "//", "/[0-9].*$")


@query("SELECT regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[0-9]+', '') AS stage, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, stage LIMIT 12")
def stage_topk(spark, sf_dir):
    """The twelve most frequent stages."""
    stage = F.expr("regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '^([^0-9]*)[0-9]+', '$1')")
    return catalog.stage_topk(_read(spark, sf_dir, "pages"), stage)


@query("SELECT source, sum(n_chars)::BIGINT AS total_bytes FROM documents GROUP BY source")
def size_by_family(spark, sf_dir):
    """Bytes per family."""
    return catalog.size_by_family(_read(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_products(spark, sf_dir):
    """Products without a record."""
    return catalog.missing_products(_read(spark, sf_dir, "documents").select("doc_id", "source"), _read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id AS product_id, d.source AS role, d.lang AS file_format, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def product_manifest(spark, sf_dir):
    """Every product with the metadata of its label."""
    products = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), F.col("source").alias("role"), F.col("lang").alias("file_format"), F.col("doc_id").alias("meta_label"))
    return catalog.join_metadata(products, _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label")).drop("meta_label")


@query("SELECT doc_id, CASE WHEN lang IS NOT NULL THEN lang END AS lang, NULL::VARCHAR AS colour, 2 AS n_keys FROM documents")
def metadata_keys(spark, sf_dir):
    """The listed keys that a record has; absent ones stay absent."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("size"), F.col("n_chars").cast("string")).alias("m"))
    kept = docs.withColumn("m", key_subset(F.col("m"), ["lang", "size", "colour"]))
    return kept.select("doc_id", F.col("m")["lang"].alias("lang"), F.try_element_at("m", F.lit("colour")).alias("colour"), F.size("m").alias("n_keys"))


@query("SELECT conv_id AS label, arg_max(role, turn) AS status, arg_max(text, turn) AS path FROM conversations GROUP BY conv_id")
def last_record_wins(spark, sf_dir):
    """S3: of several JSON records with a label the last one."""
    talk = _read(spark, sf_dir, "conversations")
    lines = talk.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("label"), F.col("role").alias("status"), F.col("text").alias("path"))).alias("line"), "turn")
    return tables.last_record_wins(lines, "line", "turn", "label string, status string, path string").select(F.col("label").cast("long").alias("label"), "status", "path")


@query("""
SELECT source AS file, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high, median(n_chars)::DOUBLE AS middle, left(arg_min(text, text), 600) AS history_head, min(lang) AS lang
FROM documents GROUP BY source
""")
def header_profile(spark, sf_dir):
    """Ranges, medians and heads of long headers per file."""
    docs = _read(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.explode(F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("history"), "text", F.lit("lang"), "lang")).alias("key", "value"))
    docs = docs.withColumn("part", F.lit("Header")).withColumn("at", F.col("value"))
    profile = tables.profile_headers(docs, ["telescope"], {"n_chars": "span"}, {"n_chars": "middle"}, {})
    first = docs.where("key = 'lang'").groupBy("file").agg(F.min("value").alias("lang"))
    return profile.join(first, "file").select("file", F.col("span")[0].alias("low"), F.col("span")[1].alias("high"), "middle", "history_head", "lang")


@query("""
WITH f AS (SELECT source AS file, min(lang) AS first_group FROM documents GROUP BY source)
SELECT d.source AS file, f.first_group, d.doc_id % 4 AS spw, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high
FROM documents d JOIN f ON d.source = f.file AND d.lang = f.first_group GROUP BY ALL
""")
def container_profile(spark, sf_dir):
    """Ranges per band of the first spectrum in the first group of each container."""
    entries = _read(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("lang").alias("grp"), F.lit("all").alias("spectrum"), (F.col("doc_id") % 4).alias("spw"), F.col("n_chars").cast("double").alias("freq"))
    rows = tables.profile_containers(entries).select("file", "first_group", F.explode("spw_ranges").alias("r"))
    return rows.select("file", "first_group", F.col("r.spw").alias("spw"), F.col("r.freq_range")[0].alias("low"), F.col("r.freq_range")[1].alias("high"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pspec' WHEN page_id % 3 = 1 THEN 'skymodel' ELSE 'visibility' END AS kind FROM pages
""")
def profile_kind(spark, sf_dir):
    """The profile that a file's suffix calls for."""
    suffix = F.when(F.col("page_id") % 3 == 0, ".pspec.h5").when(F.col("page_id") % 3 == 1, ".skyh5").otherwise(".uvh5")
    return _read(spark, sf_dir, "pages").select("page_id", tables.profile_kind(F.concat("url", suffix)).alias("kind"))


@query("""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_id % 10 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events
""")
def status_isolation(spark, sf_dir):
    """Bad records are marked and kept, good ones parsed."""
    events = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{bad "), "props")).otherwise(F.col("props")).alias("line"))
    return tables.with_status(events, "line", "k bigint").select("event_id", "status", F.col("record.k").alias("k"))


@query("""
WITH m AS (SELECT l_orderkey, l_linestatus AS s, count(*) AS n_lines, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL),
a AS (SELECT * FROM m WHERE s = 'F'), b AS (SELECT * FROM m WHERE s = 'O')
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN concat_ws(',', CASE WHEN a.n_lines <> b.n_lines THEN 'n_lines' END, CASE WHEN a.first_line <> b.first_line THEN 'first_line' END) END AS columns
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey WHERE a.s IS NULL OR b.s IS NULL OR a.n_lines <> b.n_lines OR a.first_line <> b.first_line
""")
def manifest_diff(spark, sf_dir):
    """From the manifest of finished lines to that of open lines, orders that were added, removed or changed."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count(F.lit(1)).alias("n_lines"), F.min("l_linenumber").alias("first_line"))
    finished, still_open = (lines.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("F", "O"))
    return catalog.diff_manifests(finished, still_open, "l_orderkey")


def _spectra(spark, sf_dir, branch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, delays and lengths made from the lineitem panel: one row per key, day, band and delay."""
    items = _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == branch)
    day = F.floor(days(F.col("l_shipdate")) / 30) * 30.0
    cells = items.groupBy(F.lit(0).alias("spw"), (F.col("l_suppkey") % 5).alias("blpair"), day.alias("time_jd"), (F.col("l_linenumber") - 1).alias("dly_idx")).agg(F.sum("l_quantity").alias("value"), F.avg("l_tax").alias("noise"))
    cells = cells.withColumn("lst_rad", F.col("time_jd") / 365.0)
    delays = cells.select("spw", "dly_idx").distinct().withColumn("dly", (F.col("dly_idx") - 3).cast("double"))
    lengths = cells.select("blpair").distinct().withColumn("length_m", F.floor(F.col("blpair") / 2) * 10.0)
    return cells, delays, lengths


def _aligned_sql(branch: str, x: str) -> str:
    """Common table expressions that state one branch's alignment, ending in ``{x}s``."""
    return f"""
{x}c AS (SELECT l_suppkey % 5 AS k, floor(epoch_us(l_shipdate) / 86400000000.0::DOUBLE / 30) * 30.0::DOUBLE AS t, l_linenumber - 1 AS d, sum(l_quantity) AS value, avg(l_tax) AS noise
         FROM lineitem WHERE l_returnflag = '{branch}' GROUP BY ALL),
{x}a AS (SELECT min(t) - 1e-8::DOUBLE AS anchor FROM {x}c),
{x}w AS (SELECT DISTINCT k, t, floor((t - anchor) / 30.0::DOUBLE)::BIGINT AS wid, anchor + (floor((t - anchor) / 30.0::DOUBLE) + 0.5::DOUBLE) * 30.0::DOUBLE AS centre FROM {x}c, {x}a),
{x}o AS (SELECT wid, (dense_rank() OVER (ORDER BY wid) - 1)::INT AS time_pos FROM (SELECT wid FROM {x}w GROUP BY wid HAVING count(DISTINCT k) = (SELECT count(DISTINCT k) FROM {x}w))),
{x}g AS (SELECT k, dense_rank() OVER (ORDER BY floor(k / 2.0)) - 1 AS group_id, floor(k / 2.0) * 10.0::DOUBLE AS length FROM (SELECT DISTINCT k FROM {x}c)),
{x}m AS (SELECT time_pos, wid, centre, group_id, d, sum(w * value) AS num, sum(w) AS den FROM (SELECT *, CASE WHEN noise > 0 THEN 1 / (noise * noise) ELSE 0 END AS w FROM {x}c)
         JOIN {x}w USING (k, t) JOIN {x}o USING (wid) JOIN {x}g USING (k) GROUP BY ALL),
{x}v AS (SELECT *, CASE WHEN den > 0 THEN num / den ELSE 0 END AS value FROM {x}m),
{x}s AS (SELECT time_pos, centre, group_id, greatest(d, 6 - d) - 4 AS dly_pos, group_id * 3 + greatest(d, 6 - d) - 4 AS feature, sum(value) / 2 AS value FROM {x}v WHERE d <> 3 GROUP BY ALL)"""


_WINDOWED = pipeline.AlignParams(window_seconds=DAYS_30)


def _branch_run(spark, sf_dir, branch: str) -> pipeline.Aligned:
    return pipeline.align_samples(*_spectra(spark, sf_dir, branch), _WINDOWED, branch=branch)


@query(f"WITH {_aligned_sql('A', 'x')} SELECT 'A' AS branch, 0 AS spw, time_pos, group_id, dly_pos::INT AS dly_pos, feature, round(value, 5) AS value FROM xs")
def aligned_samples(spark, sf_dir):
    """The whole alignment of one branch."""
    return _branch_run(spark, sf_dir, "A").samples.select("branch", "spw", "time_pos", "group_id", "dly_pos", "feature", F.round("value", 5).alias("value"))


@query(f"""WITH {_aligned_sql('A', 'x')} SELECT time_pos, group_id, dly_pos::INT AS dly_pos, round(centre, 6) AS time_jd, group_id * 10.0::DOUBLE AS group_len, dly_pos + 1.0::DOUBLE AS dly, isnan('nan'::DOUBLE) AS no_kperp, round(value, 5) AS value FROM xs""")
def stored_samples(spark, sf_dir):
    """Samples written with their coordinates by branch and band, and read back with them."""
    root = scratch_path(spark, "samples")
    writers.write_samples(_branch_run(spark, sf_dir, "A"), root)
    read = tables.read_samples(spark, root, "A")
    both = read["samples"].drop("branch").join(read["times"].drop("branch"), "time_pos").join(read["groups"].drop("branch"), "group_id").join(read["delays"].drop("branch"), ["spw", "dly_pos"])
    return both.select("time_pos", "group_id", "dly_pos", F.round("time_jd", 6).alias("time_jd"), "group_len", "dly", F.isnan("kperp").alias("no_kperp"), F.round("value", 5).alias("value"))


@query(f"""WITH {_aligned_sql('A', 'x')}
SELECT 'A' AS branch, 2592000.0::DOUBLE AS window_seconds, 0 AS dropped_dead_keys, 0 AS dropped_ambiguous_rows, (SELECT count(*) FROM xo) AS n_common_windows, (SELECT count(DISTINCT group_id) FROM xg) AS n_groups,
       (SELECT count(*) FROM xg) AS n_live_keys, (SELECT count(*) FROM xv WHERE NOT den > 0) AS zero_weight_cells, 0 AS max_spread, (SELECT count(DISTINCT time_pos) FROM xs) AS n_times, 3 AS n_delays, true AS has_size""")
def run_provenance(spark, sf_dir):
    """K2: the provenance of a run, written as one document and read back."""
    path = scratch_path(spark, "provenance")
    writers.write_json(pipeline.provenance(_branch_run(spark, sf_dir, "A"), {"lineitem": f"{sf_dir}/lineitem.parquet"}, "aligned_samples"), path, pretty=True)
    schema = "inputs array<struct<path: string, mtime: double, size: long>>, parameters struct<branch: string, window_seconds: double>, counters struct<dropped_dead_keys: long, dropped_ambiguous_rows: long, n_common_windows: long, n_groups: long, n_live_keys: long, zero_weight_cells: long, max_spread_seconds: double>, spws array<struct<n_times: long, n_delays: long>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    return r.select(
        "parameters.branch", "parameters.window_seconds", *[f"counters.{c}" for c in ("dropped_dead_keys", "dropped_ambiguous_rows", "n_common_windows", "n_groups", "n_live_keys", "zero_weight_cells")],
        F.round("counters.max_spread_seconds", 3).cast("int").alias("max_spread"), F.col("spws")[0]["n_times"].alias("n_times"), F.col("spws")[0]["n_delays"].alias("n_delays"), ((F.col("inputs")[0]["size"] > 0) & (F.col("inputs")[0]["mtime"] > 0)).alias("has_size"),
    )


def _branch_runs(spark, sf_dir):
    return pipeline.run_branches(_branch_run(spark, sf_dir, "A"), _branch_run(spark, sf_dir, "R"), tol_seconds=86400.0)


@query()
def contrast_spectrum(spark, sf_dir):
    """Both branches aligned, contrasted and decomposed."""
    return _branch_runs(spark, sf_dir)["contrast"].spectrum


_VARIANCE = "SELECT '{run}' AS run, round(sum(value * value), 3) AS total FROM (SELECT value - avg(value) OVER (PARTITION BY feature) AS value FROM {x})"


@query(f"""WITH {_aligned_sql('A', 'x')}, {_aligned_sql('R', 'y')},
z AS (SELECT xs.time_pos, feature, xs.value - ys.value AS value FROM xs JOIN ys USING (feature) WHERE abs(xs.centre - ys.centre) <= 1.0)
{_VARIANCE.format(run='left', x='xs')} UNION ALL {_VARIANCE.format(run='right', x='ys')} UNION ALL {_VARIANCE.format(run='contrast', x='z')}""")
def branch_variances(spark, sf_dir):
    """Squared singular values of both branches and of their contrast sum to their variances."""
    runs, out = _branch_runs(spark, sf_dir), None
    for name, run in runs.items():
        own = run.spectrum.agg(F.round(F.sum(F.col("singular_value") * F.col("singular_value")), 3).alias("total")).select(F.lit(name).alias("run"), "total")
        out = own if out is None else out.unionAll(own)
    return out


@query(f"""WITH {_aligned_sql('A', 'x')}, f AS (SELECT DISTINCT group_id, dly_pos, feature FROM xs)
SELECT feature, group_id * 10.0::DOUBLE AS group_len, dly_pos + 1.0::DOUBLE AS dly, 1.0::DOUBLE AS length, 0.99::DOUBLE AS threshold FROM f""")
def stored_decomposition(spark, sf_dir):
    """A decomposition written with its coordinates and read back; over all components, the
    squared loadings of a feature that varies freely sum to one."""
    aligned, root = _branch_run(spark, sf_dir, "A"), scratch_path(spark, "decomposition")
    run = pipeline.decompose_samples(pipeline.with_features(aligned))
    writers.write_decomposition(run, root, "A", decompose.THRESHOLD, aligned)
    loadings, needed = (spark.read.parquet(f"{root}/{name}").where("label = 'A'") for name in ("components", "needed"))
    placed = pipeline.with_coordinates(loadings, pipeline.Aligned(aligned.samples, *[spark.read.parquet(f"{root}/{name}") for name in ("times", "groups", "delays")], aligned.counters))
    whole = placed.groupBy("feature", "group_len", "dly").agg(F.round(F.sum(F.col("loading") * F.col("loading")), 6).alias("length"))
    return whole.crossJoin(needed.select(F.col("variance_threshold").alias("threshold")))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 4 = 0""")
def select_polarisation(spark, sf_dir):
    """Rows of the polarisation pair pI, by name."""
    codes = F.element_at(F.array(*[F.lit(align.polpair_code(p)) for p in ("pI", "pQ", "pU", "pV")]), F.col("l_linenumber") % 4 + 1)
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codes.alias("polpair"))
    return align.select_polarisation(rows, "pI").drop("polpair")


@query("""SELECT l_orderkey, l_linenumber, ((100 + l_suppkey % 100) * 1000 + 100 + l_linenumber) * 1000000 + (101 + l_suppkey % 100) * 1000 + 100 + l_linenumber AS code FROM lineitem""")
def series_codes(spark, sf_dir):
    """Pairs of baselines given as structs, normalised to one integer code."""
    a, b = (F.struct((F.col("l_suppkey") % 100 + i).alias("a"), F.col("l_linenumber").alias("b")) for i in (0, 1))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct(a.alias("left"), b.alias("right")).alias("key"))
    return rows.select("l_orderkey", "l_linenumber", series_code(F.col("key"), rows.schema["key"].dataType).alias("code"))


@query("""SELECT doc_id, printf('spw%02d', doc_id % 14) AS band, left(coalesce(text, ''), 600) AS head, round(n_chars / 86400.0::DOUBLE, 9) AS days, n_chars * 86400.0::DOUBLE AS seconds, text AS decoded FROM documents""")
def scalar_functions(spark, sf_dir):
    """P9, 2.11: band labels, heads of texts, unit conversions, bytes as text."""
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", band_label(F.col("doc_id") % 14).alias("band"), head(F.coalesce("text", F.lit(""))).alias("head"), F.round(to_days(F.col("n_chars")), 9).alias("days"), to_seconds(F.col("n_chars")).alias("seconds"), to_text(F.col("text").cast("binary")).alias("decoded"))


@query("""SELECT l_returnflag AS grp, count(DISTINCT l_linenumber) AS n_spws, count(DISTINCT l_suppkey) AS n_keys, count(DISTINCT (l_suppkey, l_shipdate)) AS n_rows, count(DISTINCT l_shipdate) AS n_times FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def spectra_counts(spark, sf_dir):
    """One spectrum of a stored container, selected in the scan, and its counts."""
    root, items = scratch_path(spark, "spectra"), _read(spark, sf_dir, "lineitem")
    items.select(F.col("l_returnflag").alias("grp"), F.lit("averaged").alias("spectrum"), F.lit("b").alias("branch"), F.col("l_linenumber").alias("spw"), F.col("l_suppkey").alias("blpair"), F.col("l_shipdate").alias("time_jd")).write.partitionBy("grp").parquet(root)
    return tables.describe_spectra(tables.read_spectra(spark, root, "R", "averaged")).select(F.lit("R").alias("grp"), "*")


@query("""SELECT l_orderkey AS blpair, l_linenumber - 1 AS dly_idx, sum(l_quantity) AS value, max(l_tax) AS noise FROM lineitem GROUP BY ALL""")
def spectra_cells(spark, sf_dir):
    """The real parts of stored spectra, one row per delay, with their noise."""
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"), F.max("l_tax").alias("l_tax"))
    arrays = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax"))).alias("c"))
    at = lambda name: F.transform(F.sequence(F.lit(1), F.array_max(F.transform("c", lambda x: x["l_linenumber"]))), lambda i: F.get(F.transform(F.filter("c", lambda x: x["l_linenumber"] == i), lambda x: x[name]), 0))
    spectra = arrays.select(F.lit("b").alias("branch"), F.lit(0).alias("spw"), F.col("l_orderkey").alias("blpair"), F.lit(0.0).alias("time_jd"), F.lit(0.0).alias("lst_rad"), at("l_tax").alias("pn_abs"), at("l_quantity").alias("data_re"))
    return tables.explode_cells(spectra).where("value IS NOT NULL").select("blpair", "dly_idx", "value", "noise")


def _headers(spark, sf_dir) -> DataFrame:
    """Long headers of one file per source (scalars, arrays, polarisations, a history, data shapes), of one per
    language that has names at its root only, and the names at the root of the containers."""
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit(".uvh5")).alias("file"), "doc_id", "n_chars", "lang", "source", "text")
    row = lambda part, key, at, value: F.struct(F.lit(part).alias("part"), key.alias("key"), at.cast("long").alias("at"), value.cast("string").alias("value"))
    zero, one, none, i, n = F.lit(0), F.lit(1), F.lit(""), F.col("doc_id"), F.col("n_chars")
    arrays = docs.select("file", F.explode(F.array(row("Header", F.lit("freq_array"), i, n), row("Header", F.lit("integration_time"), i, n / 2))).alias("r"))
    files = docs.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("m"), F.min("text").alias("text"))
    facts = [row("Header", F.lit("Ntimes"), zero, F.col("n")), row("Header", F.lit("history"), zero, F.col("text")), row("Data", F.lit("visdata"), zero, F.col("n")), row("Data", F.lit("visdata"), one, F.col("m")), row("Root", F.lit("Header"), zero, none), row("Root", F.lit("Data"), zero, none)]
    code = F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))
    pols = docs.where("lang IS NOT NULL").select("file", row("Header", F.lit("polarization_array"), code, code).alias("r")).distinct()
    bare = docs.where("lang IS NOT NULL").select(F.concat("lang", F.lit(".uvh5")).alias("file"), row("Root", F.coalesce("source", F.lit("none")), zero, none).alias("r")).distinct()
    groups_of = _read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit(".pspec.h5")).alias("file"), row("Root", F.col("l_linestatus"), zero, none).alias("r")).distinct()
    whole = arrays.unionAll(files.select("file", F.explode(F.array(*facts)).alias("r"))).unionAll(pols).unionAll(bare).unionAll(groups_of)
    return whole.select("file", "r.*")


_HEADERS = "(SELECT coalesce(source, 'none') || '.uvh5' AS file, * FROM documents)"


@query(f"""
SELECT file, count(*)::VARCHAR AS ntimes, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high, median(n_chars / 2.0)::DOUBLE AS integration_time_s, NULL::DOUBLE AS channel_width_hz,
       coalesce(string_agg(DISTINCT (ascii(lang) * 256 + ascii(lang[2]))::VARCHAR, ',' ORDER BY (ascii(lang) * 256 + ascii(lang[2]))::VARCHAR), '') AS pols,
       left(min(text), 600) AS history_head, count(*) || ',' || max(n_chars) AS shape, '' AS root_keys FROM {_HEADERS} GROUP BY file
UNION ALL SELECT lang || '.uvh5', NULL, NULL, NULL, NULL, NULL, '', NULL, '', string_agg(DISTINCT coalesce(source, 'none'), ',' ORDER BY coalesce(source, 'none')) FROM documents WHERE lang IS NOT NULL GROUP BY lang
""")
def visibility_profile(spark, sf_dir):
    """Scalars, ranges, medians, polarisation list, history, shapes and root keys of headers."""
    headers = _headers(spark, sf_dir)
    p = tables.profile_headers(headers.where(tables.profile_kind(F.col("file")) == "visibility"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return p.select("file", F.col("scalars")["Ntimes"].alias("ntimes"), F.col("freq_range_hz")[0].alias("low"), F.col("freq_range_hz")[1].alias("high"), "integration_time_s", "channel_width_hz", text(F.col("polarization_array")).alias("pols"), "history_head", text(F.col("data_datasets")["visdata"]).alias("shape"), text(F.col("root_keys")).alias("root_keys"))


def _containers(spark, sf_dir) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem")
    return items.select(F.concat("l_returnflag", F.lit(".pspec.h5")).alias("file"), F.col("l_linestatus").alias("grp"), F.concat(F.lit("s"), F.col("l_linenumber") % 2).alias("spectrum"), (F.col("l_linenumber") % 3).alias("spw"), F.col("l_quantity").alias("freq"), (F.col("l_suppkey") % 4 + 2121).alias("polpair"), F.col("l_suppkey").alias("blpair"), F.col("l_shipdate").alias("time"), F.col("l_tax").alias("dly"), F.lit("mK2").alias("units"), F.lit("Jy").alias("vis_units"), F.lit("blackman").alias("taper"), F.lit("I").alias("norm"), F.repeat(F.lit("h"), 700).alias("history"))


_CONTAINERS = """
e AS (SELECT l_returnflag || '.pspec.h5' AS file, l_linestatus AS grp, 's' || (l_linenumber % 2) AS spectrum, l_linenumber % 3 AS spw, l_suppkey % 4 + 2121 AS polpair, l_suppkey AS blpair, l_shipdate AS t, l_tax AS dly FROM lineitem),
f AS (SELECT file, min((grp, spectrum)) AS first FROM e GROUP BY file),
o AS (SELECT e.* FROM e JOIN f USING (file) WHERE (e.grp, e.spectrum) = f.first)"""


@query(f"""WITH {_CONTAINERS}
SELECT file, string_agg(DISTINCT polpair::VARCHAR, ',' ORDER BY polpair::VARCHAR) AS polpairs, count(DISTINCT spw) AS n_spws, count(DISTINCT polpair) AS n_pols, count(DISTINCT blpair) AS n_blpairs, count(DISTINCT (blpair, t)) AS n_bltpairs, count(DISTINCT t) AS n_times,
       (SELECT count(DISTINCT dly) FROM o AS p WHERE p.file = o.file AND p.spw = (SELECT min(spw) FROM o AS q WHERE q.file = o.file)) AS n_delays, 'mK2' AS units, 'Jy' AS vis_units, 'blackman' AS taper, 'I' AS norm, 600 AS head_size FROM o GROUP BY file
""")
def container_counts(spark, sf_dir):
    """Counts, polarisation codes, delays and texts of the first spectrum of each container."""
    p = tables.profile_containers(_containers(spark, sf_dir))
    return p.select("file", F.concat_ws(",", F.transform("polpair_array", lambda x: x.cast("string"))).alias("polpairs"), "n_spws", "n_pols", "n_blpairs", "n_bltpairs", "n_times", "n_delays", "units", "vis_units", "taper", "norm", F.length("history_head").alias("head_size"))


@query(f"""WITH {_CONTAINERS}
SELECT file, 'pspec' AS kind, NULL::VARCHAR AS ntimes, count(DISTINCT spw) AS n_spws, any_value(roots) AS root_keys
FROM o JOIN (SELECT file, string_agg(DISTINCT grp, ',' ORDER BY grp) AS roots FROM e GROUP BY file) USING (file) GROUP BY file
UNION ALL SELECT file, 'visibility', count(*)::VARCHAR, NULL, '' FROM {_HEADERS} GROUP BY file
UNION ALL SELECT DISTINCT replace(file, '.uvh5', '.skyh5'), 'skymodel', NULL, NULL, 'Data,Header' FROM {_HEADERS}
UNION ALL SELECT lang || x.suffix, x.kind, NULL, NULL, string_agg(DISTINCT coalesce(source, 'none'), ',' ORDER BY coalesce(source, 'none'))
FROM documents, (VALUES ('.uvh5', 'visibility'), ('.skyh5', 'skymodel')) x(suffix, kind) WHERE lang IS NOT NULL GROUP BY lang, x.suffix, x.kind""")
def profiles_by_kind(spark, sf_dir):
    """Visibility headers, sky models and containers, each by its own profile, in one table."""
    plain = _headers(spark, sf_dir)
    sky = plain.where("file NOT LIKE '%.pspec.h5'").withColumn("file", F.regexp_replace("file", "uvh5$", "skyh5"))
    p = tables.profile_by_kind(plain.unionByName(sky), _containers(spark, sf_dir))
    return p.select("file", "kind", F.try_element_at("scalars", F.lit("Ntimes")).alias("ntimes"), "n_spws", F.concat_ws(",", "root_keys").alias("root_keys"))


@query("SELECT d.doc_id::VARCHAR AS product_id, d.lang AS file_format, l.quality::VARCHAR AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def stored_products(spark, sf_dir):
    """The product dimension with its sample metadata, written as CSV and read with its schema."""
    path = scratch_path(spark, "products") + ".csv"
    docs = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    text = {"product_id": F.col("doc_id").cast("string"), "file_format": F.col("lang"), "sample_metadata": F.to_json(F.create_map(F.lit("quality"), F.col("quality").cast("string")))}
    names = [c.split()[0] for c in tables.PRODUCT_SCHEMA.split(", ")]
    docs.select(*[text.get(n, F.lit(None).cast("string")).alias(n) for n in names]).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_products(spark, path).select("product_id", "file_format", F.col("sample_metadata")["quality"].alias("quality"))


@query("SELECT doc_id::VARCHAR AS product_id, source AS role, lang AS file_format, n_chars::VARCHAR AS n_files FROM documents")
def manifest_csv(spark, sf_dir):
    """K6: the manifest's columns as CSV, in order, with a header and empty fields for nulls."""
    path = scratch_path(spark, "manifest")
    writers.write_manifest_csv(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), F.col("source").alias("role"), F.col("lang").alias("file_format"), F.col("n_chars").alias("n_files"), "text"), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT label, status, path FROM (SELECT conv_id AS label, arg_max(role, turn) AS status, arg_max(text, turn) AS path FROM conversations GROUP BY conv_id)")
def metadata_lines(spark, sf_dir):
    """K7, S3: records written as JSON lines, one file in order of turn, and read back by label."""
    path = scratch_path(spark, "lines")
    talk = _read(spark, sf_dir, "conversations")
    writers.write_json(talk.select(F.col("conv_id").cast("string").alias("label"), F.col("role").alias("status"), F.col("text").alias("path"), "turn").repartitionByRange("turn").sortWithinPartitions("turn").drop("turn"), path)
    return tables.read_metadata_jsonl(spark, path, "label string, status string, path string").select(F.col("label").cast("long").alias("label"), "status", "path")


@query("""
WITH u AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS dir, length(html) AS n FROM pages), c AS (SELECT dir, count(*) AS n_files FROM u GROUP BY dir),
p AS (SELECT doc_id, (SELECT min(dir) FROM u) AS dir FROM documents)
SELECT (SELECT count(*) FROM documents) AS n_products, (SELECT sum(n) FROM u)::BIGINT AS total_bytes, (SELECT sum(n_files) FROM p JOIN c USING (dir))::BIGINT AS files, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1) AS good, 'x' AS inventory_date
""")
def inventory_manifest(spark, sf_dir):
    """Listing, products and metadata in one manifest, written as an indented document and read back."""
    listing, path = _listing(spark, sf_dir), scratch_path(spark, "inventory")
    first = listing.agg(F.min("dir").alias("path"))
    products = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), F.col("doc_id").alias("meta_label")).crossJoin(first)
    parts = pipeline.build_inventory(listing, products, _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label"), {"inventory_date": "x"})
    writers.write_json(parts["manifest"], path, pretty=True)
    read = spark.read.schema("inventory_date string, n_products long, total_sizes map<string,long>, products array<struct<product_id: long, n_files: long, quality: int>>").option("multiLine", True).json(path)
    total = F.aggregate(F.map_values("total_sizes"), F.lit(0).cast("long"), lambda a, x: a + x)
    files = F.aggregate("products", F.lit(0).cast("long"), lambda a, x: a + x["n_files"])
    return read.select("n_products", total.alias("total_bytes"), files.alias("files"), F.size(F.filter("products", lambda x: x["quality"] == 1)).cast("long").alias("good"), "inventory_date")


@query("SELECT dir, count(*) AS n_files, sum(length(html))::BIGINT AS total_bytes FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS dir, html FROM pages) GROUP BY dir")
def inventory(spark, sf_dir):
    """Counts and sizes of a listing, joined."""
    products = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), F.col("doc_id").alias("meta_label"))
    parts = pipeline.build_inventory(_listing(spark, sf_dir), products, _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label"))
    return parts["counts"].join(parts["sizes"], "dir")


_DOUBLE_DAYS = "epoch_us(l_shipdate) / 86400000000.0::DOUBLE"


def _two_bands(spark, sf_dir, branch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, delays and lengths of two bands with odd cases: key 6 is dead in the first band, key 3 has two times in
    each fifth window, times differ by key, and keys 4 and 5 have no noise in each fourth window."""
    items = _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == branch)
    slot, key, band = F.floor(days(F.col("l_shipdate")) / 30), F.col("l_suppkey") % 7, F.col("l_linenumber") % 2
    twice = F.when((key == 3) & (slot % 5 == 0) & (F.col("l_partkey") % 2 == 0), 1.0).otherwise(0.0)
    rows = items.select(
        band.alias("spw"), key.alias("blpair"), (slot * 30.0 + key * 0.5 + twice).alias("time_jd"), (F.col("l_partkey") % (5 + 2 * band)).alias("dly_idx"),
        F.when((key == 6) & (band == 0), 0.0).otherwise(F.col("l_quantity")).alias("value"), F.when((key >= 4) & (slot % 4 == 0), 0.0).otherwise(F.col("l_tax")).alias("noise"),
    )
    cells = rows.groupBy("spw", "blpair", "time_jd", "dly_idx").agg(F.sum("value").alias("value"), F.avg("noise").alias("noise")).withColumn("lst_rad", F.col("time_jd") / 365.0)
    delays = cells.select("spw", "dly_idx").distinct().withColumn("dly", (F.col("dly_idx") - 2 - F.col("spw")).cast("double"))
    lengths = cells.select("blpair").distinct().withColumn("length_m", F.floor(F.col("blpair") / 2) * 10.0)
    return cells, delays, lengths


def _two_bands_sql(branch: str, x: str, also: str = "") -> str:
    """Common table expressions that state a branch's run over two bands, ending in ``{x}s``."""
    return f"""
{x}i AS (SELECT l_linenumber % 2 AS spw, l_suppkey % 7 AS k, floor({_DOUBLE_DAYS} / 30)::BIGINT AS slot, l_partkey, l_quantity, l_tax FROM lineitem WHERE l_returnflag = '{branch}' {also}),
{x}c AS (SELECT spw, k, slot * 30.0::DOUBLE + k * 0.5::DOUBLE + CASE WHEN k = 3 AND slot % 5 = 0 AND l_partkey % 2 = 0 THEN 1 ELSE 0 END AS t, l_partkey % (5 + 2 * spw) AS d,
         sum(CASE WHEN k = 6 AND spw = 0 THEN 0 ELSE l_quantity END) AS value, avg(CASE WHEN k >= 4 AND slot % 4 = 0 THEN 0 ELSE l_tax END) AS noise FROM {x}i GROUP BY ALL),
{x}dead AS (SELECT k FROM {x}c WHERE spw = 0 GROUP BY k HAVING max(CASE WHEN value <> 0 THEN 1 ELSE 0 END) = 0),
{x}p AS (SELECT DISTINCT k, t FROM {x}c WHERE k NOT IN (SELECT k FROM {x}dead)),
{x}a AS (SELECT min(t) - 1e-8::DOUBLE AS anchor FROM {x}p),
{x}w AS (SELECT k, t, floor((t - anchor) / 30.0::DOUBLE)::BIGINT AS wid, anchor + (floor((t - anchor) / 30.0::DOUBLE) + 0.5::DOUBLE) * 30.0::DOUBLE AS centre FROM {x}p, {x}a),
{x}u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY k, wid) AS n FROM {x}w) WHERE n = 1),
{x}o AS (SELECT wid, (dense_rank() OVER (ORDER BY wid) - 1)::INT AS time_pos FROM (SELECT wid FROM {x}u GROUP BY wid HAVING count(*) = (SELECT count(DISTINCT k) FROM {x}w))),
{x}r AS (SELECT * FROM {x}u JOIN {x}o USING (wid)),
{x}g AS (SELECT k, dense_rank() OVER (ORDER BY floor(k / 2.0)) - 1 AS group_id FROM (SELECT DISTINCT k FROM {x}r)),
{x}m AS (SELECT spw, time_pos, any_value(centre) AS centre, group_id, d, sum(w * value) AS num, sum(w) AS den
         FROM (SELECT *, CASE WHEN noise > 0 THEN 1 / (noise * noise) ELSE 0 END AS w FROM {x}c) JOIN {x}r USING (k, t) JOIN {x}g USING (k) GROUP BY spw, time_pos, group_id, d),
{x}v AS (SELECT *, CASE WHEN den > 0 THEN num / den ELSE 0 END AS value, d - 2 - spw AS dly FROM {x}m),
{x}s AS (SELECT spw, time_pos, any_value(centre) AS centre, group_id, abs(dly) - 1 AS dly_pos, group_id * (2 + spw) + abs(dly) - 1 AS feature, sum(value) / 2 AS value FROM {x}v WHERE dly <> 0 GROUP BY spw, time_pos, group_id, abs(dly))"""


def _two_band_run(spark, sf_dir, branch: str, bands: tuple[int, ...] = (), keys: str = "true") -> pipeline.Aligned:
    cells, delays, lengths = _two_bands(spark, sf_dir, branch)
    return pipeline.align_samples(cells.where(keys), delays, lengths, pipeline.AlignParams(window_seconds=DAYS_30, bands=bands), branch=branch)


@query(f"WITH {_two_bands_sql('A', 'x')} SELECT spw, time_pos, group_id, dly_pos::INT AS dly_pos, feature, round(value, 5) AS value FROM xs")
def two_band_samples(spark, sf_dir):
    """The alignment of two bands with dead, ambiguous and weightless data."""
    return _two_band_run(spark, sf_dir, "A").samples.select("spw", "time_pos", "group_id", "dly_pos", "feature", F.round("value", 5).alias("value"))


@query(f"""WITH {_two_bands_sql('A', 'x')}
SELECT (SELECT count(*) FROM xdead) AS dropped_dead_keys, (SELECT count(*) FROM xw) - (SELECT count(*) FROM xu) AS dropped_ambiguous_rows, (SELECT count(*) FROM xo) AS n_common_windows,
       (SELECT count(DISTINCT group_id) FROM xg) AS n_groups, (SELECT count(*) FROM xg) AS n_live_keys, (SELECT count(*) FROM xv WHERE NOT den > 0) AS zero_weight_cells,
       (SELECT round(max(d) * 86400.0, 3) FROM (SELECT max(t) - min(t) AS d FROM xr GROUP BY wid)) AS max_spread_seconds,
       (SELECT string_agg(spw || ':' || n, ',' ORDER BY spw) FROM (SELECT spw, count(DISTINCT dly_pos) AS n FROM xs GROUP BY spw)) AS delays, true AS is_logged""")
def two_band_provenance(spark, sf_dir):
    """Counters observed in the run's own writes, stored in its provenance and read back."""
    path = scratch_path(spark, "provenance")
    writers.write_json(pipeline.provenance(_two_band_run(spark, sf_dir, "A"), {"lineitem": f"{sf_dir}/lineitem.parquet"}, "two_band_provenance"), path, pretty=True)
    names = ("dropped_dead_keys", "dropped_ambiguous_rows", "n_common_windows", "n_groups", "n_live_keys", "zero_weight_cells")
    schema = f"logged_at string, counters struct<{', '.join(f'{n}: long' for n in names)}, max_spread_seconds: double>, spws array<struct<spw: int, n_delays: long>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    each = F.transform("spws", lambda s: F.concat(s["spw"].cast("string"), F.lit(":"), s["n_delays"].cast("string")))
    return r.select(*[f"counters.{n}" for n in names], F.round("counters.max_spread_seconds", 3).alias("max_spread_seconds"), F.concat_ws(",", each).alias("delays"), F.col("logged_at").cast("timestamp").isNotNull().alias("is_logged"))


@query(f"""WITH {_two_bands_sql('A', 'x')},
f AS (SELECT DISTINCT group_id, unnest(range(3)) AS dly_pos FROM xg)
SELECT 'A' AS label, 1 AS spw, o.time_pos, round(o.centre, 6) AS time_jd, (f.group_id * 3 + f.dly_pos)::INT AS feature, f.group_id * 10.0::DOUBLE AS group_len, f.dly_pos + 1.0::DOUBLE AS dly, round(coalesce(s.value, 0), 5) AS value
FROM (SELECT time_pos, min(centre) AS centre FROM xr GROUP BY time_pos) o CROSS JOIN f LEFT JOIN xs s ON s.spw = 1 AND s.time_pos = o.time_pos AND s.group_id = f.group_id AND s.dly_pos = f.dly_pos""")
def sample_files_by_name(spark, sf_dir):
    """The run's bands written as one file each, and one of them found by its name and read with its
    coordinates; rows lie in order of time by their place in the file."""
    root = scratch_path(spark, "sample-files")
    sample_files.write_sample_files(_two_band_run(spark, sf_dir, "A"), root, "A")
    rows = sample_files.read_sample_files(spark, root, "A", [1]).select("label", "spw", "time_pos", F.round("time_jd", 6).alias("time_jd"), F.posexplode("values").alias("feature", "value"))
    axes = sample_files.read_sample_files(spark, root, "A", [1], "features").select("feature", "group_len", "dly")
    return rows.join(axes, "feature").withColumn("value", F.round("value", 5))


@query(f"""WITH {_two_bands_sql('A', 'x')}, {_two_bands_sql('R', 'y', 'AND l_linenumber % 2 = 1 AND l_suppkey % 7 <> 6')},
z AS (SELECT spw, time_pos, feature, xs.value - ys.value AS value FROM xs JOIN ys USING (spw, feature, time_pos) WHERE spw = 1),
q AS (SELECT 'left' AS run, spw, time_pos, feature, value FROM xs UNION ALL SELECT 'right', spw, time_pos, feature, value FROM ys WHERE spw = 1 UNION ALL SELECT 'contrast', spw, time_pos, feature, value FROM z)
SELECT run, spw, round(sum(value * value), 3) AS total FROM (SELECT run, spw, value - avg(value) OVER (PARTITION BY run, spw, feature) AS value FROM q) GROUP BY run, spw""")
def band_skipping_contrast(spark, sf_dir):
    """One branch has two bands and the other one; the band without a partner is in no contrast (nor is a key
    that is dead in the other branch's first band, without which the groups of both are the same)."""
    runs, out = pipeline.run_branches(_two_band_run(spark, sf_dir, "A"), _two_band_run(spark, sf_dir, "R", (1,), "blpair <> 6"), tol_seconds=10 * 86400.0), None
    for name, run in runs.items():
        own = run.spectrum.groupBy("spw").agg(F.round(F.sum(F.col("singular_value") * F.col("singular_value")), 3).alias("total")).withColumn("run", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


_OF_ALL = "SELECT t * 86400.0::DOUBLE AS t, row_number() OVER (ORDER BY t) AS {n} FROM (SELECT {t} AS t FROM events WHERE event_type = '{kind}')"


@query(f"""
WITH RECURSIVE l AS ({_OF_ALL.format(t=_T, n='i', kind='click')}), r AS ({_OF_ALL.format(t=_T, n='j', kind='view')}),
g AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS j, NULL::DOUBLE AS left_time, NULL::DOUBLE AS right_time
  UNION ALL
  SELECT l.i, coalesce(min(r.j), g.j), l.t, min(r.t) FROM g JOIN l ON l.i = g.i + 1 LEFT JOIN r ON r.j > g.j AND r.t >= l.t - 1800 AND abs(r.t - l.t) <= 1800 GROUP BY l.i, g.j, l.t)
SELECT left_time, right_time FROM g WHERE right_time IS NOT NULL
""")
def tolerance_match_hot(spark, sf_dir):
    """All clicks and views as one key, dealt over many tasks, greedily one to one within half an hour."""
    of = lambda kind: _read(spark, sf_dir, "events").where(F.col("event_type") == kind).select((days(F.col("ts")) * 86400.0).alias("time"))
    return match.tolerance_match_parts(of("click"), of("view"), [], 1800.0, parts=16)


@query("""
WITH RECURSIVE a AS (
  SELECT 0 AS group_id, min(s_acctbal) AS anchor FROM supplier
  UNION ALL SELECT a.group_id + 1, min(s.s_acctbal) FROM a JOIN supplier s ON s.s_acctbal > a.anchor + 50.0::DOUBLE GROUP BY a.group_id)
SELECT s_suppkey, s_acctbal, max(group_id)::BIGINT AS group_id FROM supplier JOIN a ON a.anchor <= s_acctbal GROUP BY ALL
""")
def anchored_groups(spark, sf_dir):
    """R3, anchored mode: suppliers whose balances lie up to 50 above that of their group's first one."""
    return groups.anchored_groups(_read(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 50.0)


@query("SELECT user_id, median(step) AS median_step FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM (SELECT user_id, epoch_us(ts)::DOUBLE AS t FROM events)) WHERE step IS NOT NULL GROUP BY user_id UNION ALL SELECT NULL, median(l_extendedprice) FROM lineitem")
def exact_medians(spark, sf_dir):
    """Medians of each user's time steps, and of all prices as one group, selected by counts."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts")).cast("double")
    steps = grid.steps(_read(spark, sf_dir, "events").select("user_id", micros.alias("t")), ["user_id"], "t")
    prices = _read(spark, sf_dir, "lineitem").select(F.lit(None).cast("long").alias("user_id"), F.col("l_extendedprice").alias("step"))
    return ordered.exact_medians(steps.unionByName(prices), ["user_id"], "step").withColumnRenamed("median", "median_step")


@query("""WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings),
c AS (SELECT vec_id, feature, value - avg(value) OVER (PARTITION BY feature) AS value FROM v)
SELECT 0 AS spw, round(sum(value * value), 6) AS total, count(DISTINCT vec_id) AS n_samples, count(DISTINCT feature) AS n_features, 1.0::DOUBLE AS whole FROM c""")
def wide_band_variance(spark, sf_dir):
    """D3 by the range finder: all embeddings as one band that counts as too wide for one task; over as many
    components as there are features, the squared singular values sum to the variance."""
    cells = _vectors(spark, sf_dir).withColumn("spw", F.lit(0))
    run = decompose.Decomposition(cells, stored=64, store=materialise, dense=16)
    lead = run.spectrum.groupBy("spw").agg(F.round(F.sum(F.col("singular_value") * F.col("singular_value")), 6).alias("total"), F.round(F.max("cum_evr"), 9).alias("whole"))
    return lead.join(run.summary, "spw").select("spw", "total", "n_samples", "n_features", "whole")


@query("""
SELECT doc_id AS product_id, CASE WHEN l.doc_id IS NULL OR doc_id % 3 = 2 THEN '{}' WHEN doc_id % 3 = 0 THEN '{"quality":' || quality || '}' ELSE '{"nested":{"list":[' || toxic || '],"quality":' || quality || '},"toxic":' || toxic || '}' END AS sample_metadata
FROM documents LEFT JOIN labels l USING (doc_id)
""")
def product_records(spark, sf_dir):
    """Records with keys of their own, written as JSON lines and read back; each product takes the keys
    that its own list names and its record has."""
    path = scratch_path(spark, "records")
    found = _read(spark, sf_dir, "labels").select(F.struct(F.col("doc_id").cast("string").alias("label"), "quality", "toxic", F.struct(F.array("toxic").alias("list"), "quality").alias("nested")).alias("r"))
    writers.write_json(found.select("r.*"), path)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    keys = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("quality"), F.lit("absent"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("toxic"), F.lit("nested"))).otherwise(F.array().cast("array<string>"))
    products = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), F.col("doc_id").cast("string").alias("meta_label"), keys.alias("meta_keys"))
    joined = records.join_records(products, records.records_of_lines(lines, "value", "at"))
    return joined.select("product_id", F.to_json("sample_metadata").alias("sample_metadata"))


@query("""
WITH l AS (SELECT l_orderkey, l_linestatus AS s, l_linenumber AS line, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, s, '$.lines[' || line || '].line' AS path, line::VARCHAR AS v FROM l UNION ALL SELECT l_orderkey, s, '$.lines[' || line || '].qty', qty::VARCHAR FROM l
      UNION ALL SELECT l_orderkey, s, '$.n', count(*)::VARCHAR FROM l GROUP BY ALL),
a AS (SELECT * FROM p WHERE s = 'F'), b AS (SELECT * FROM p WHERE s = 'O')
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.path, b.path) AS path, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old, b.v AS new
FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.path = b.path WHERE a.s IS NULL OR b.s IS NULL OR a.v <> b.v
""")
def document_diff(spark, sf_dir):
    """J10 on nested documents: from the stored documents of finished lines to those of open ones, path by path; a line is
    named by its number and not by its place."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("qty"))
    items = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), "qty")))
    text = F.to_json(F.struct(F.count(F.lit(1)).alias("n"), items.alias("lines")))
    path = scratch_path(spark, "documents")
    lines.groupBy("l_orderkey", "l_linestatus").agg(text.alias("doc")).write.partitionBy("l_linestatus").parquet(path)
    stored = spark.read.parquet(path).select("l_orderkey", "l_linestatus", F.parse_json("doc").alias("doc"))
    finished, still_open = (stored.where(F.col("l_linestatus") == s) for s in ("F", "O"))
    return records.diff_documents(finished, still_open, ["l_orderkey"], "doc", {"$.lines": "line"})


@query("""
WITH p AS (SELECT page_id % 7 AS a, page_id % 5 AS b, url LIKE 'https%' AS s FROM pages)
SELECT (SELECT count(*) FROM p) AS n_files, (SELECT count(*) FROM p WHERE s) AS n_spectra, (SELECT count(*) FROM p WHERE a = b) AS n_autos, (SELECT count(*) FROM p WHERE a <> b) AS n_cross,
       (SELECT count(*) FROM p WHERE a <> b AND NOT s) AS n_cross_without_spectrum, (SELECT count(*) FROM documents) AS n_products, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_missing
""")
def inventory_census(spark, sf_dir):
    """The census of the listing inside the manifest document, written and read back, and the products without a record."""
    path = scratch_path(spark, "inventory")
    identifier = F.concat_ws("_", F.col("page_id") % 7, F.col("page_id") % 5)
    listing = _listing(spark, sf_dir).withColumn("identifier", identifier).join(_read(spark, sf_dir, "pages").select("page_id", F.col("url").startswith("https").alias("has_spectrum")), "page_id")
    products = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), F.col("doc_id").alias("meta_label"))
    parts = pipeline.build_inventory(listing, products, _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label"))
    writers.write_json(parts["manifest"], path, pretty=True)
    names = ("n_files", "n_spectra", "n_autos", "n_cross", "n_cross_without_spectrum")
    read = spark.read.schema(f"n_products long, census struct<{', '.join(f'{n}: long' for n in names)}>").option("multiLine", True).json(path)
    return read.select(*[f"census.{n}" for n in names], "n_products").crossJoin(F.broadcast(parts["missing"].agg(F.count(F.lit(1)).alias("n_missing"))))


@query("SELECT d.doc_id AS product_id, d.source AS role, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def manifest_parts(spark, sf_dir):
    """The manifest document over many files, in order of product, and its products read back."""
    path = scratch_path(spark, "manifest-parts")
    products = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), F.col("source").alias("role"), F.col("doc_id").alias("meta_label"))
    joined = catalog.join_metadata(products, _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label")).select("product_id", "role", "quality")
    writers.write_manifest_parts(joined, {"inventory_date": "x"}, path)
    return writers.read_manifest_parts(spark.read.text(path), "product_id long, role string, quality int")


@query("SELECT 'part=' || (page_id % 3) AS dir, 1 AS n_files, true AS has_bytes FROM pages GROUP BY ALL")
def listed_files(spark, sf_dir):
    """Regular files of a folder and of those below it, with their sizes."""
    path = scratch_path(spark, "listed")
    _read(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("part"), "html").repartition("part").write.partitionBy("part").parquet(path)
    files = tables.list_files(spark, path, recursive=True).select(F.regexp_extract("path", r"(part=\d+)/", 1).alias("dir"), "length")
    return files.where("dir <> ''").groupBy("dir").agg(F.count(F.lit(1)).cast("int").alias("n_files"), F.min(F.col("length") > 0).alias("has_bytes"))


# Bands of two features, whose decomposition has a closed form.
_PLANE = """
v AS (SELECT o_orderstatus AS spw, o_orderkey AS time_pos, o_totalprice / 1000.0::DOUBLE AS x, o_custkey::DOUBLE AS y FROM orders),
c AS (SELECT spw, time_pos, x - avg(x) OVER (PARTITION BY spw) AS x, y - avg(y) OVER (PARTITION BY spw) AS y FROM v),
m AS (SELECT spw, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS d, count(*) AS n FROM c GROUP BY spw),
l AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS top FROM m),
e AS (SELECT *, (a * d - b * b) / top AS low, CASE WHEN a >= d THEN top - d ELSE b END AS p, CASE WHEN a >= d THEN b ELSE top - a END AS q FROM l),
u AS (SELECT *, p / sqrt(p * p + q * q) AS f0, q / sqrt(p * p + q * q) AS f1 FROM e),
s AS (SELECT spw, 0 AS comp, sqrt(top) AS singular_value, top / (a + d) AS evr, top / (a + d) AS cum_evr FROM e UNION ALL SELECT spw, 1, sqrt(low), low / (a + d), 1.0 FROM e),
o AS (SELECT spw, 0 AS comp, f0, f1 FROM u UNION ALL SELECT spw, 1, -f1, f0 FROM u),
w AS (SELECT spw, comp, f0 * g AS f0, f1 * g AS f1 FROM (SELECT *, CASE WHEN abs(f0) >= abs(f1) THEN sign(f0) ELSE sign(f1) END AS g FROM o))"""


def _plane(spark, sf_dir, **options) -> decompose.Decomposition:
    orders = _read(spark, sf_dir, "orders")
    cells = orders.select(F.col("o_orderstatus").alias("spw"), F.col("o_orderkey").alias("time_pos"), F.posexplode(F.array(F.col("o_totalprice") / 1000.0, F.col("o_custkey").cast("double"))).alias("feature", "value"))
    return decompose.Decomposition(cells, store=materialise, **options)


@query(f"WITH {_PLANE} SELECT spw, comp, round(singular_value, 4) AS singular_value, round(evr, 9) AS evr, round(cum_evr, 9) AS cum_evr FROM s")
def plane_spectrum(spark, sf_dir):
    """Singular values, ratios and their running sums of bands of two features."""
    return _plane(spark, sf_dir).spectrum.select("spw", "comp", *[F.round(c, n).alias(c) for c, n in (("singular_value", 4), ("evr", 9), ("cum_evr", 9))])


@query(f"WITH {_PLANE} SELECT spw, comp, round(f0, 6) + 0.0 AS first, round(f1, 6) + 0.0 AS second FROM w WHERE comp < 1")
def plane_components(spark, sf_dir):
    """Loadings of the stored components, here one, with the sign that makes the largest positive."""
    held = _plane(spark, sf_dir, stored=1).components
    at = lambda i: (F.round(F.max(F.when(F.col("feature") == i, F.col("loading"))), 6) + 0.0)
    return held.groupBy("spw", "comp").agg(at(0).alias("first"), at(1).alias("second"))


@query(f"WITH {_PLANE} SELECT spw, comp, time_pos, round(x * f0 + y * f1, 3) + 0.0 AS score FROM c JOIN w USING (spw)")
def plane_scores(spark, sf_dir):
    """Scores of all samples."""
    return _plane(spark, sf_dir).scores.select("spw", "comp", "time_pos", (F.round("score", 3) + 0.0).alias("score"))


@query(f"""WITH {_PLANE}
SELECT spw, n::BIGINT AS n_samples, 2 AS n_features, (SELECT count(*) FROM s WHERE s.spw = m.spw AND cum_evr < 0.9) + 1 AS n_components, (SELECT string_agg(round(evr, 6)::VARCHAR, ',' ORDER BY comp) FROM s WHERE s.spw = m.spw) AS top5,
       row_number() OVER (ORDER BY spw) - 1 AS place FROM m""")
def plane_summary(spark, sf_dir):
    """The summary document over all bands in order, written, read back and taken apart."""
    path = scratch_path(spark, "summary")
    writers.write_json(writers.summary_document(_plane(spark, sf_dir, threshold=0.9).summary, "orders"), path)
    read = spark.read.schema("label string, spws array<struct<spw: string, n_samples: long, n_features: long, n_components: long, top5_evr: array<double>>>").json(path)
    rows = read.select(F.posexplode("spws").alias("place", "r")).select("place", "r.*")
    return rows.select("spw", "n_samples", "n_features", "n_components", F.concat_ws(",", F.transform("top5_evr", lambda x: number_text(F.round(x, 6)))).alias("top5"), F.col("place").cast("long").alias("place"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

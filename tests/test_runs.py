import pytest

import __spark_entry__
from alignkit import registry
from alignkit.plans import pipeline


def spectra(spark, scale=1.0, keys=4, times=4):
    cells = [(0, k, t + 0.01 * k, 0.1 * t, d, scale * (k + 1) * (t + 1) * (d + 1), 1.0) for k in range(keys) for t in range(times) for d in range(5)]
    delays = spark.createDataFrame([(0, d, float(d - 2)) for d in range(5)], "spw int, dly_idx int, dly double")
    lengths = spark.createDataFrame([(k, 10.0 * (k // 2)) for k in range(keys)], "blpair int, length_m double")
    return spark.createDataFrame(cells, "spw int, blpair int, time_jd double, lst_rad double, dly_idx int, value double, noise double"), delays, lengths


def test_alignment_end_to_end(spark):
    out = pipeline.align_samples(*spectra(spark), pipeline.AlignParams(window_seconds=86400.0))
    got = {(r.time_pos, r.group_id, r.dly_pos): r.value for r in out.samples.collect()}
    assert len(got) == 4 * 2 * 2
    mean = lambda g: (2 * g + 1 + 2 * g + 2) / 2
    for (t, g, d), v in got.items():
        assert v == pytest.approx(mean(g) * (t + 1) * ((d + 4) + (2 - d)) / 2)
    counters = out.counters.first()
    assert (counters.n_common_windows, counters.n_groups, counters.dropped_dead_keys, counters.zero_weight_cells, counters.dropped_ambiguous_rows) == (4, 2, 0, 0, 0)


def test_no_common_window_raises(spark):
    cells, delays, lengths = spectra(spark)
    with pytest.raises(ValueError, match="common"):
        pipeline.align_samples(cells, delays, lengths, pipeline.AlignParams(window_seconds=0))


def test_contrast_of_scaled_branches(spark):
    params = pipeline.AlignParams(window_seconds=86400.0)
    a, b = (pipeline.with_features(pipeline.align_samples(*spectra(spark, s), params)) for s in (3.0, 1.0))
    diff = {(r.time_pos, r.feature): r.value for r in pipeline.contrast_samples(a, b).collect()}
    want = {(r.time_pos, r.feature): 2.0 * r.value for r in b.collect()}
    assert diff == pytest.approx(want)


def test_branches_with_other_bands_and_features(spark):
    from pyspark.sql import functions as F

    cells, delays, lengths = spectra(spark)
    two = cells.unionByName(cells.withColumn("spw", F.lit(1)))
    params = pipeline.AlignParams(window_seconds=86400.0)
    both = pipeline.with_features(pipeline.align_samples(two, delays.unionByName(delays.withColumn("spw", F.lit(1))), lengths, params))
    one = pipeline.with_features(pipeline.align_samples(cells, delays, lengths, params))
    assert {r.spw for r in pipeline.contrast_samples(both, one).select("spw").distinct().collect()} == {0}  # band 1 has no partner
    with pytest.raises(ValueError, match="feature counts differ"):
        pipeline.contrast_samples(both, one.where("feature > 0"))


def test_counters_are_those_of_the_writes(spark):
    from pyspark.sql import functions as F

    cells, delays, lengths = spectra(spark, keys=5)
    odd = cells.withColumn("value", F.when(F.col("blpair") == 4, 0.0).otherwise(F.col("value"))).withColumn("noise", F.when(F.col("blpair") >= 2, 0.0).otherwise(1.0))
    twice = cells.where("blpair = 1 AND time_jd < 1").withColumn("time_jd", F.col("time_jd") + 0.3)
    out = pipeline.align_samples(odd.unionByName(twice), delays, lengths, pipeline.AlignParams(window_seconds=86400.0))
    c = out.counters.first()
    assert (c.dropped_dead_keys, c.dropped_ambiguous_rows, c.n_common_windows, c.n_live_keys, c.n_groups) == (1, 2, 3, 4, 2)
    assert c.zero_weight_cells == 3 * 5 and c.max_spread_seconds == pytest.approx(0.03 * 86400)
    run = pipeline.decompose_samples(pipeline.with_features(out).withColumn("value", F.when(F.col("feature") == 0, float("nan")).otherwise(F.col("value"))))
    assert run.n_replaced == 3


def test_polarisation_is_chosen_by_name(spark):
    from pyspark.sql import functions as F

    from alignkit.operators import align

    cells, delays, lengths = spectra(spark)
    both = cells.withColumn("polpair", F.lit(align.polpair_code("pI"))).unionByName(cells.withColumn("polpair", F.lit(align.polpair_code("pQ"))).withColumn("value", F.col("value") * 5))
    assert (align.polpair_code("pI"), align.polpair_code("pV"), align.polpair_code("pI", "pQ")) == (2121, 2424, 2122)
    params = pipeline.AlignParams(window_seconds=86400.0, pol="pQ")
    value = lambda run: {(r.time_pos, r.feature): r.value for r in run.samples.collect()}
    mine, plain = value(pipeline.align_samples(both, delays, lengths, params)), value(pipeline.align_samples(cells, delays, lengths, pipeline.AlignParams(window_seconds=86400.0)))
    assert mine == pytest.approx({k: 5 * v for k, v in plain.items()})
    with pytest.raises(ValueError, match="no rows of polarisation pU"):
        pipeline.align_samples(both, delays, lengths, pipeline.AlignParams(pol="pU"))
    with pytest.raises(ValueError, match="unknown"):
        align.polpair_code("pX")


def test_samples_and_decomposition_are_stored_with_coordinates(spark, tmp_path):
    from alignkit.sources import tables, writers

    run = pipeline.align_samples(*spectra(spark), pipeline.AlignParams(window_seconds=86400.0), branch="b")
    writers.write_samples(run, str(tmp_path / "s"))
    back = tables.read_samples(spark, str(tmp_path / "s"), "b")
    for name in ("samples", "times", "groups", "delays"):
        mine, theirs = getattr(run, name), back[name]
        # NaN is not equal to itself, so rows are compared as text.
        assert sorted(map(str, mine.select(sorted(mine.columns)).collect())) == sorted(map(str, theirs.select(sorted(mine.columns)).collect()))
    with pytest.raises(FileNotFoundError):
        tables.read_samples(spark, str(tmp_path / "s"), "none")
    writers.write_decomposition(pipeline.decompose_samples(pipeline.with_features(run)), str(tmp_path / "d"), "b", 0.99, run)
    assert {p.name for p in (tmp_path / "d").iterdir()} == {"mean", "spectrum", "components", "scores", "needed", "times", "groups", "delays"}


def test_struct_keys_and_plain_keys(spark):
    from alignkit.functions.scalar import series_code
    from pyspark.sql import functions as F

    rows = spark.sql("SELECT named_struct('x', named_struct('a', 1, 'b', 2), 'y', named_struct('a', 3, 'b', 4)) AS k, 7 AS n")
    got = rows.select(series_code(F.col("k"), rows.schema["k"].dataType).alias("k"), series_code(F.col("n"), rows.schema["n"].dataType).alias("n")).first()
    assert tuple(got) == (101102103104, 7)


def test_registered_core_queries_match_their_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "orders", "events", "documents", "labels", "conversations", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    known, sql = registry.queries(), registry.oracle_sql()
    plain = lambda v: "none" if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name in ("aligned_samples", "branch_variances", "run_provenance", "stored_samples", "stored_decomposition", "tolerance_match_greedy", "infer_integration", "visibility_profile", "profiles_by_kind", "container_counts", "stored_products", "metadata_lines", "inventory_manifest", "series_codes", "spectra_cells", "product_records", "manifest_parts", "plane_summary"):
        got, want = known[name](spark, sf), con.sql(sql[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        mine = sorted([str([plain(r[c]) for c in columns]) for r in got.collect()])
        at = [want.columns.index(c) for c in columns]
        assert mine == sorted([str([plain(r[i]) for i in at]) for r in want.fetchall()]), name


def test_small_ratios_are_written_as_in_the_sql(spark, tmp_path):
    import duckdb
    from alignkit.functions.scalar import number_text
    from pyspark.sql import functions as F

    values = [1.0, 0.0, 0.999969, 0.001, 0.00099, 0.00012, 0.0001, 0.000099, 0.000031, 0.00001, 0.000001, -0.00012, -3e-5, 1.25e-100, 1234567.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    want = duckdb.sql(f"SELECT v::DOUBLE::VARCHAR FROM (SELECT unnest({values}::DOUBLE[]) AS v)").fetchall()
    assert [tuple(r) for r in rows.select(number_text(F.col("v"))).collect()] == want
    # Orders whose second ratio is below 0.001, and below 0.0001.
    orders = "CASE WHEN i % 2 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus, i AS o_orderkey, i * 10 AS o_custkey, 1000 * (i % 7) * CASE WHEN i % 2 = 0 THEN 7 ELSE 18 END::DOUBLE AS o_totalprice"
    duckdb.sql(f"COPY (SELECT {orders} FROM range(1000) r(i)) TO '{tmp_path}/orders.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = registry.queries()["plane_summary"](spark, str(tmp_path)).orderBy("place").collect()
    want = con.sql(f"SELECT spw, top5 FROM ({registry.oracle_sql()['plane_summary']}) ORDER BY place").fetchall()
    assert [(r.spw, r.top5) for r in got] == want
    second = [float(t.split(",")[1]) for _, t in want]
    assert min(second) < 1e-4 < max(second) < 1e-3


def test_bounded_median_by_counts(spark):
    import random
    import statistics

    from alignkit.operators import grid

    rng = random.Random(6)
    for n in (0, 1, 2, 7, 500, 501):
        values = [rng.choice([rng.random() * 30, 10.5, 10.5, 0.0]) for _ in range(n)]
        got = grid.bounded_median(spark.createDataFrame([(v,) for v in values], "v double"), "v", 0.0, 30.0).first().median
        assert got == (pytest.approx(statistics.median(values)) if values else None)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(registry.queries()) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stream_means_agree_with_batch(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from alignkit.operators import reduce
    from alignkit.streaming.windows import stream_group_means

    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = stream_group_means(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", ["event_type"], "value", None, "1 hour")
    run = stream.writeStream.format("memory").queryName("means").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    batch = reduce.weighted_group_mean(events.withColumn("w", F.date_trunc("hour", "ts")), ["w", "event_type"], "value")
    got = {(r.window_start, r.event_type): round(r.value, 6) for r in spark.table("means").collect()}
    assert got == {(r.w, r.event_type): round(r.value, 6) for r in batch.collect()}

"""Sample sets as files by name: round trips, pruning without opening, commit and abort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignkit.plans import pipeline
from alignkit.sources import sample_files


@pytest.fixture(scope="module")
def run(spark):
    samples = [(s, t, g, d, g * (2 + s) + d, 100.0 * s + 10 * t + 3 * g + d) for s in (0, 7, 12) for t in range(3) for g in range(2) for d in range(2 + s) if (t, g) != (1, 1)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("branch", F.lit("sum"))
    return pipeline.Aligned(
        frame(samples, "spw int, time_pos int, group_id int, dly_pos int, feature int, value double"),
        frame([(t, 2459000.5 + t, 0.1 * t) for t in range(3)], "time_pos int, time_jd double, lst_rad double"),
        frame([(0, 10.0, 4, 2), (1, 20.0, 9, 1)], "group_id int, group_len double, group_rep int, n_keys long"),
        frame([(s, d, d + 0.5, float("nan") if d else 2.0, float("nan")) for s in (0, 7, 12) for d in range(2 + s)], "spw int, dly_pos int, dly double, kpara double, kperp double"),
        None,
    )


def test_round_trip(spark, run, tmp_path):
    root = str(tmp_path)
    sample_files.write_sample_files(run, root, "sum")
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"sum.aligned.spw{s:02d}.npz" for s in (0, 7, 12)]
    with np.load(tmp_path / "sum.aligned.spw07.npz") as z:
        assert sorted(z.files) == sorted(sample_files.ARRAYS) and z["cube_shape"].tolist() == [3, 2, 9] and z["matrix"].shape == (3, 18)
        assert np.isnan(z["kperps"]).all() and z["group_reps"].tolist() == [4, 9] and z["time_grid"].tolist() == [2459000.5, 2459001.5, 2459002.5]
        matrix = z["matrix"]
    read = sample_files.read_sample_files(spark, root, "sum")
    got = {(r.spw, r.time_pos): r["values"] for r in read.collect()}
    assert len(got) == 9 and got[7, 1] == matrix[1].tolist() and got[7, 1][9:] == [0.0] * 9
    cells = {(r.spw, r.time_pos, r.feature): r.value for r in run.samples.collect()}
    assert all(got[s, t][f] == v for (s, t, f), v in cells.items()) and sum(map(sum, got.values())) == sum(cells.values())
    features = sample_files.read_sample_files(spark, root, "sum", [0], "features").orderBy("feature").collect()
    assert [(r.group_id, r.dly_pos, r.group_len, r.group_rep, r.dly) for r in features] == [(0, 0, 10.0, 4, 0.5), (0, 1, 10.0, 4, 1.5), (1, 0, 20.0, 9, 0.5), (1, 1, 20.0, 9, 1.5)]
    assert read.rdd.getNumPartitions() == 3


def test_files_of_other_bands_are_not_opened(spark, run, tmp_path):
    sample_files.write_sample_files(run, str(tmp_path), "sum")
    (tmp_path / "sum.aligned.spw07.npz").write_bytes(b"not a zip")
    (tmp_path / "other.aligned.spw00.npz").write_bytes(b"not a zip")
    (tmp_path / "sum.aligned.spwXX.npz").write_bytes(b"")
    read = lambda **k: sample_files.read_sample_files(spark, str(tmp_path), "sum", **k)
    assert {r.spw for r in read(bands=[0, 12]).collect()} == {0, 12} and read(bands=[3]).count() == 0
    with pytest.raises(Exception, match="zip"):
        read().collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert {r.spw for r in read().where("spw IN (0, 12)").collect()} == {0, 12}
        assert read().where("spw = 12 AND time_pos = 1").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_commit_and_abort(spark, run, tmp_path):
    sample_files.write_sample_files(run, str(tmp_path), "sum")
    before = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    rows = spark.createDataFrame([(0, 0, 1.0, 1.0, 2, [0], [1.0], [(0, 1.0, 1)], [(0, 1.0, 1.0)])], "spw int, time_pos int, time_jd double, lst_rad double, n_times int, features array<int>, values array<double>, groups array<struct<group_id int, group_len double, group_rep long>>, delays array<struct<dly_pos int, dly double, kpara double>>")
    with pytest.raises(Exception, match="1 of 2 times"):
        rows.write.format("samplefiles").option("label", "sum").mode("append").save(str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == before  # nothing half-written, no folder left
    one = pipeline.Aligned(run.samples.where("spw = 12"), run.times, run.groups, run.delays.where("spw = 12"), None)
    sample_files.write_sample_files(one, str(tmp_path), "sum", "overwrite")
    assert [p.name for p in tmp_path.iterdir()] == ["sum.aligned.spw12.npz"]
    with pytest.raises(Exception, match="no samples for eor"):
        sample_files.read_sample_files(spark, str(tmp_path), "eor").collect()

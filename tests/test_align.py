import math

import pytest
from pyspark.sql import functions as F

from alignkit.operators import align, grid, groups, reduce, reshape

INF, NAN = float("inf"), float("nan")


def windows(spark, rows):
    return spark.createDataFrame(rows, "k string, wid long")


def test_ambiguous_rows_and_common_windows(spark):
    rows = windows(spark, [("a", 0), ("a", 1), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)])
    single = align.drop_ambiguous_rows(rows, "k")
    assert sorted(map(tuple, single.collect())) == [("a", 0), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    assert sorted(map(tuple, align.common_windows(single, "k", rows).collect())) == [(0, 0), (2, 1)]
    assert align.misaligned(align.align_rows(single, align.common_windows(single, "k", rows)), "k").count() == 0


def test_key_without_rows_leaves_no_window(spark):
    rows = windows(spark, [("a", 0), ("a", 0), ("b", 0)])
    assert align.common_windows(align.drop_ambiguous_rows(rows, "k"), "k", rows).count() == 0


def test_dead_keys(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0), ("b", NAN, 0.0), ("c", 0.0, 1.0), ("d", None, None)], "k string, re double, im double")
    assert {r.k for r in align.dead_keys(rows, "k", "re", "im").collect()} == {"a", "d"}
    assert {r.k for r in align.drop_dead_keys(rows, "k", "re").collect()} == {"b"}
    probe = spark.createDataFrame([("b", 0.0)], "k string, re double")
    assert {r.k for r in align.drop_dead_keys(rows, "k", "re", probe=probe).collect()} == {"a", "c", "d"}


def test_first_keys(spark):
    rows = spark.createDataFrame([(3,), (1,), (2,), (1,)], "k int")
    assert sorted(r.k for r in align.keep_first_keys(rows, "k", 2).collect()) == [1, 1, 2]
    assert align.keep_first_keys(rows, "k", 0).count() == 4


def test_grid(spark):
    rows = spark.createDataFrame([("a", float(t)) for t in (0, 2, 4, 7)] + [("b", float(t)) for t in (1, 3)], "k string, t double")
    assert grid.infer_window(rows, "k", "t").first()[0] == 2.0
    assert grid.infer_window(rows, "k", "t", 0).first()[0] is None
    assert grid.infer_window(rows.limit(1), "k", "t", 60.0).first()[0] is None
    assert grid.infer_integration(rows, "t").first()[0] == 0.0
    fine = spark.createDataFrame([(i * 10 / 86400,) for i in range(5)], "t double")
    assert math.isclose(grid.infer_integration(fine, "t").first()[0], 10.0, rel_tol=1e-9)
    one = spark.createDataFrame([(5.0, None)], "anchor double, window_days double")
    assert {(r.wid, r.centre) for r in grid.assign_windows(rows, one, "t").collect()} == {(0, 0.0)}
    two = spark.createDataFrame([(0.0, 2.0)], "anchor double, window_days double")
    assert sorted({(r.wid, r.centre) for r in grid.assign_windows(rows, two, "t").collect()}) == [(0, 1.0), (1, 3.0), (2, 5.0), (3, 7.0)]


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        ([(4.0, 1.0), (8.0, 2.0)], (4.8, 1.25)),
        ([(4.0, 0.0), (8.0, NAN)], (0.0, 0.0)),
        ([(NAN, 1.0), (6.0, 1.0)], (6.0, 1.0)),
        ([(INF, 1.0), (None, 1.0), (2.0, None), (3.0, 1.0)], (3.0, 1.0)),
    ],
)
def test_weighted_mean(spark, cells, want):
    df = spark.createDataFrame([("g", *c) for c in cells], "g string, value double, noise double")
    row = reduce.weighted_group_mean(df, ["g"], "value", "noise").first()
    assert (row.value, row.weight) == want
    assert reduce.zero_weight_cells(reduce.weighted_group_mean(df, ["g"], "value", "noise")).first()[0] == (want[1] == 0)


def test_without_noise_all_weigh_alike(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0)], "g string, value double")
    assert reduce.weighted_group_mean(df, ["g"], "value").first().value == 2.0


def test_fold(spark):
    delays = spark.createDataFrame([(0, i, float(d)) for i, d in enumerate((-2, -1, 0, 1, 2))], "spw int, dly_idx int, dly double")
    cells = spark.createDataFrame([(0, "g", i, float(v)) for i, v in enumerate((1, 2, 9, 4, 5))], "spw int, g string, dly_idx int, value double")
    got = {r.dly_pos: r.value for r in reshape.fold_axis(cells, delays, "spw", ["g"]).collect()}
    assert got == {0: 3.0, 1: 3.0}
    lopsided = spark.createDataFrame([(0, 0, -1.2), (0, 1, -0.8), (0, 2, 1.0)], "spw int, dly_idx int, dly double")
    assert reshape.mirror_index(lopsided, "spw").first().neg_idx in (0, 1)
    tied = spark.createDataFrame([(0, 0, -1.5), (0, 1, -0.5), (0, 2, 1.0)], "spw int, dly_idx int, dly double")
    assert reshape.mirror_index(tied, "spw").first().neg_idx == 0
    flat = reshape.flatten_features(reshape.fold_axis(cells.withColumn("g", F.lit(2)), delays, "spw", ["g"]), "spw", "g")
    assert sorted(r.feature for r in flat.collect()) == [4, 5]


def test_groups_chain(spark):
    keys = spark.createDataFrame([(1, 0.0), (2, 0.9), (3, 1.8), (4, 3.5), (5, 3.4), (6, 9.0)], "k int, v double")
    members = groups.tolerance_groups(keys, "k", "v", 1.0)
    assert {r.k: r.group_id for r in members.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    live = spark.createDataFrame([(4,), (5,), (6,)], "k int")
    summary = groups.group_summary(groups.restrict_groups(members, live, "k"), "k", "v").collect()
    assert sorted(map(tuple, summary)) == [(0, 3.4, 5, 2), (1, 9.0, 6, 1)]


def test_groups_match_sorted_gaps(spark):
    import random

    rng = random.Random(4)
    values = [round(rng.uniform(-50, 50), 2) for _ in range(80)]
    got = {r.v: r.group_id for r in groups.tolerance_groups(spark.createDataFrame(list(enumerate(values)), "k int, v double"), "k", "v", 1.5).collect()}
    group, last = -1, -INF
    for v in sorted(values):
        group += v - last > 1.5
        last = v
        assert got[v] == group

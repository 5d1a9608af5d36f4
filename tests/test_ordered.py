"""Neighbours in order, exact medians, anchored groups and mirrors: against plain models, for hot groups too."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignkit.operators import grid, groups, ordered, reshape


@pytest.mark.parametrize("itself", [False, True])
def test_carried_over_borders(spark, itself):
    rng = np.random.default_rng(3)
    rows = [(int(b) if b else None, i, float(v) if v > 3 else None) for i, (b, v) in enumerate(zip(rng.choice([0, 1, 1, 1, 1, 1, 2], 400), rng.integers(0, 9, 400), strict=True))]
    got = ordered.carried(spark.createDataFrame(rows, "b int, i int, v double"), ["b"], [F.col("i")], {"seen": F.col("v")}, itself, parts=9)
    last, want = {}, {}
    for b, i, v in rows:
        want[i] = last.get(b)
        last[b] = v if v is not None else last.get(b)
        want[i] = last[b] if itself else want[i]
    assert {r.i: r.seen for r in got.collect()} == want and got.columns == ["b", "i", "v", "seen"]


@pytest.mark.parametrize("few", [0, 3, 4096])
def test_exact_medians_of_groups(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    rng = np.random.default_rng(7)
    groups = {
        1: rng.normal(size=501).tolist(), 2: [3.0], 3: [1.0, 2.0], 4: (10.0 ** rng.integers(-300, 300, 40) * rng.choice([-1, 1], 40)).tolist(),
        5: [5.0] * 300 + [7.0] * 300, 6: [-1.0, 0.0, -0.0, 1.0], 7: [1.0, float("inf"), float("inf")], None: rng.integers(0, 3, 100).astype(float).tolist(), 8: [1.5, 1.5 + 2**-52], 9: [5e-324, 1e-310, 3e-310],
    }
    rows = [(g, v) for g, x in groups.items() for v in x] + [(2, None), (2, float("nan")), (10, float("nan"))]
    got = {r.g: r["median"] for r in ordered.exact_medians(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    assert got == {g: statistics.median(x) for g, x in groups.items()}


def test_numbered_over_borders(spark):
    rng = np.random.default_rng(5)
    rows = [(int(b) if b else None, i) for i, b in enumerate(rng.choice([0, 1, 1, 1, 2], 300))]
    got = ordered.numbered(spark.createDataFrame(rows, "b int, i int"), ["b"], [F.col("i")], parts=7)
    want, seen = {}, {}
    for b, i in rows:
        want[i] = seen.get(b, 0)
        seen[b] = want[i] + 1
    assert {r.i: r.at for r in got.collect()} == want


def test_exact_median_without_groups(spark):
    values = spark.range(100_000).select((F.col("id") % 1000 / 7.0).alias("v"))
    assert ordered.exact_medians(values, [], "v").first()["median"] == statistics.median([i % 1000 / 7.0 for i in range(100_000)])
    assert ordered.exact_medians(values.limit(0), [], "v").count() == 0


def test_inferred_lengths_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * F.col("id") / 86400.0).alias("t"))
    steps = [((i + 1) ** 2 - i**2) / 86400.0 for i in range(4999)]
    assert math.isclose(grid.infer_window(rows, "k", "t").first()[0], statistics.median(steps), rel_tol=1e-9)
    assert math.isclose(grid.infer_integration(rows, "t").first()[0], statistics.median([s * 86400 for s in steps if s * 86400 < 30 - 1e-6]), rel_tol=1e-6)


def test_settled_grid_equals_the_joined_one(spark):
    rows = spark.range(50).select((F.col("id") % 5).alias("k"), (F.col("id") / 7.0).alias("t"))
    for seconds in (0, 86400.0, -1):
        one = grid.window_grid(rows, "k", "t", seconds)
        a, b = grid.assign_windows(rows, one, "t"), grid.assign_windows(rows, grid.settled(one), "t")
        assert a.schema == b.schema or [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("n,spread,tol", [(1, 1, 1.0), (60, 10, 1.0), (300, 40, 1.0), (300, 300, 0.0), (200, 20, 50.0)])
def test_anchored_groups_equal_a_pass_in_order(spark, n, spread, tol):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, spread * 8, n) / 8.0).tolist()
    rows = [(i, v) for i, v in enumerate(values)] + [(n, None)]
    got = {r.k: r.group_id for r in groups.anchored_groups(spark.createDataFrame(rows, "k int, v double"), "k", "v", tol, parts=5).collect()}
    number, anchor, want = -1, None, {}
    for v, i in sorted((v, i) for i, v in enumerate(values)):
        if anchor is None or v > anchor + tol:
            number, anchor = number + 1, v
        want[i] = number
    assert got == want


def test_mirrors_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    axes = [(b, i, float(x)) for b, n in ((0, 1), (1, 40), (2, 300)) for i, x in enumerate(rng.integers(-30, 30, n) / 2.0)] + [(3, 0, 4.0), (3, 1, 2.0)]
    found = reshape.mirror_index(spark.createDataFrame(axes, "spw int, dly_idx int, dly double"), "spw")
    for r in found.collect():
        assert r.neg_idx == min((abs(x + r.dly), i) for b, i, x in axes if b == r.spw)[1]
    positive = [(b, i) for b, i, x in axes if x > 0]
    assert sorted((r.spw, r.pos_idx) for r in found.collect()) == sorted(positive)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

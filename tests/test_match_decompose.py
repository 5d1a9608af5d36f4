import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alignkit.functions.scalar import rounded
from alignkit.operators import decompose, match


def brute_greedy(left, right, tol):
    """The rule by scanning all right times for each left one."""
    free, out = sorted(right), []
    for t in sorted(left):
        near = [r for r in free if t - tol <= r <= t + tol]
        if near:
            out.append((t, min(near)))
            free.remove(min(near))
            free = [r for r in free if r >= min(near)]
    return out


def times(spark, values):
    return spark.createDataFrame([(0, float(v)) for v in values], "b int, time double")


@pytest.mark.parametrize(("left", "right", "want"), [([10], [7, 10], [(10, 7)]), ([10, 11], [10], [(10, 10)]), ([], [1], []), ([1], [9], [])])
def test_greedy_examples(spark, left, right, want):
    got = match.tolerance_match(times(spark, left), times(spark, right), ["b"], 3.0).collect()
    assert [(r.left_time, r.right_time) for r in got] == want


def test_greedy_random(spark):
    rng = random.Random(2)
    left = {b: sorted(rng.randrange(400) for _ in range(40)) for b in range(6)}
    right = {b: sorted(rng.randrange(400) for _ in range(40)) for b in range(6)}
    rows = lambda of: spark.createDataFrame([(b, float(t)) for b, ts in of.items() for t in ts], "b int, time double")
    got = match.tolerance_match(rows(left), rows(right), ["b"], 2.0).collect()
    want = [(b, *p) for b in left for p in brute_greedy(left[b], right[b], 2.0)]
    assert sorted((r.b, r.left_time, r.right_time) for r in got) == sorted(want)


def test_one_dense_island_is_a_stream(spark):
    rng = random.Random(4)
    sides = [rng.choice([0, 0, 1]) for _ in range(30000)]
    ticks = [i + rng.choice([0.0, 0.5]) for i in range(len(sides))]
    left, right = ([t for t, s in zip(ticks, sides) if s == k] for k in (0, 1))
    want = brute_greedy(left[:2000], right[:1000], 2.5)
    order = np.argsort(ticks, kind="stable")
    ordered, kinds = np.array(ticks)[order], np.array(sides)[order]
    for size in (1, 7, 500):
        matcher, got, held = match.Matcher(2.5), [], 0
        for i in range(0, len(ticks), size):
            t, s = ordered[i : i + size], kinds[i : i + size]
            got += matcher.feed(t[s == 0], t[s == 1], t[-1])
            held = max(held, len(matcher.waiting) + len(matcher.free))
        assert got[: len(want) - 10] == want[:-10] and held <= 12
    want = got
    frame = match.tolerance_match(times(spark, left), times(spark, right), ["b"], 2.5)
    assert sorted((r.left_time, r.right_time) for r in frame.collect()) == want
    assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().toString()
    assert match.tolerance_match(times(spark, left).drop("b"), times(spark, right).drop("b"), [], 2.5).count() == len(want)


def test_wide_equals_greedy_on_wide_grids(spark):
    left, right = [i * 10 for i in range(30)], [i * 10 + 3 for i in range(5, 40)]
    a = match.tolerance_match(times(spark, left), times(spark, right), ["b"], 4.0)
    b = match.tolerance_match_wide(times(spark, left), times(spark, right), ["b"], 4.0)
    assert sorted(map(tuple, a.select("left_time", "right_time").collect())) == sorted(map(tuple, b.select("left_time", "right_time").collect()))


def cells_of(spark, matrices):
    rows = [(s, i, j, float(x[i, j])) for s, x in matrices.items() for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "spw int, time_pos long, feature int, value double")


def test_components_match_dense_decomposition(spark):
    rng = np.random.default_rng(0)
    matrices = {0: rng.normal(size=(7, 30)) * np.arange(1, 31), 1: rng.normal(size=(12, 5))}
    run = decompose.Decomposition(cells_of(spark, matrices))
    spectrum = run.spectrum.toPandas()
    for spw, x in matrices.items():
        centred = x - x.mean(axis=0)
        u, s, v = np.linalg.svd(centred, full_matrices=False)
        mine = spectrum[spectrum.spw == spw].sort_values("comp")
        assert len(mine) == min(x.shape)
        np.testing.assert_allclose(mine.singular_value, s, atol=1e-6 * s[0])
        np.testing.assert_allclose(mine.cum_evr, np.cumsum(s**2) / (s**2).sum(), atol=1e-9)
        comp = run.components.where(F.col("spw") == spw).toPandas()
        score = run.scores.where(F.col("spw") == spw).toPandas()
        real = int((s > 1e-9 * s[0]).sum())
        assert sorted(set(comp.comp)) == sorted(set(score.comp)) == list(range(real))
        assert all(v == 0 for v in mine.singular_value[real:])
        for k in range(real):
            load = comp[comp.comp == k].sort_values("feature").loading.to_numpy()
            sign = np.sign(v[k][np.argmax(np.abs(v[k]))])
            np.testing.assert_allclose(load, v[k] * sign, atol=1e-6)
            assert np.sum(load**2) == pytest.approx(1)
            np.testing.assert_allclose(score[score.comp == k].sort_values("time_pos").score, u[:, k] * s[k] * sign, atol=1e-6 * s[0])
        needed = {r.spw: r.n_components for r in run.needed.collect()}[spw]
        assert needed == int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.99)) + 1


def test_many_samples_take_the_covariance(spark):
    rows = spark.range(20000).select(F.lit(0).alias("spw"), F.col("id").alias("time_pos"), F.posexplode(F.array(*[F.hash("id", F.lit(k)) / 2.0**31 * (k + 1) for k in range(3)])).alias("feature", "value"))
    x = rows.toPandas().pivot(index="time_pos", columns="feature", values="value").to_numpy()
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    run = decompose.Decomposition(rows)
    np.testing.assert_allclose([r.singular_value for r in run.spectrum.orderBy("comp").collect()], s, rtol=1e-9)
    comp = run.components.orderBy("comp", "feature").toPandas().loading.to_numpy().reshape(3, 3)
    sign = np.sign(v[np.arange(3), np.abs(v).argmax(axis=1)])
    np.testing.assert_allclose(comp, v * sign[:, None], atol=1e-9)
    score = run.scores.orderBy("comp", "time_pos").toPandas().score.to_numpy().reshape(3, -1)
    np.testing.assert_allclose(score, (u * s * sign).T, atol=1e-7)
    centred = decompose.centre_columns(decompose.zero_nonfinite(rows))
    shape = spark.createDataFrame([(0, 20000, 3)], "spw int, n long, p long")
    in_shards = decompose.covariance(centred, shape, shard_cells=1000).orderBy("i", "j").toPandas().g
    np.testing.assert_allclose(in_shards, ((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))[np.triu_indices(3)], rtol=1e-9, atol=1e-7)


def test_blocks_add_up(spark, monkeypatch):
    monkeypatch.setattr(decompose, "BLOCK", 4)
    x = np.random.default_rng(5).normal(size=(11, 30))
    got = decompose.gram_matrix(cells_of(spark, {0: x, 3: x[:5]}), shard_cells=16).toPandas()
    for spw, y in ((0, x), (3, x[:5])):
        mine = got[got.spw == spw].sort_values(["i", "j"])
        i, j = np.triu_indices(len(y))
        assert mine.i.tolist() == i.tolist() and mine.j.tolist() == j.tolist()
        np.testing.assert_allclose(mine.g, (y @ y.T)[i, j], rtol=1e-12)


def test_pairs_of_many_samples_come_from_tiles(spark, monkeypatch):
    """A band of more than ``PAIRED`` samples has no task that holds its matrix; the others are as before."""
    monkeypatch.setattr(decompose, "PAIRED", 6)
    monkeypatch.setattr(decompose, "TILE", 4)
    monkeypatch.setattr(decompose, "CHUNK", 7)
    whole = []
    blocks = decompose.product_blocks
    monkeypatch.setattr(decompose, "product_blocks", lambda cells, shape, *more: (whole.extend(r.spw for r in shape.collect()), blocks(cells, shape, *more))[1])
    rng = np.random.default_rng(6)
    matrices = {0: rng.normal(size=(11, 30)), 3: rng.normal(size=(5, 30)), 4: rng.normal(size=(8, 3))}
    matrices[0][2, 7:] = 0.0
    cells = cells_of(spark, matrices).where("value <> 0")  # a sample without cells in some pieces
    got = decompose.gram_matrix(cells).toPandas()
    assert whole == [3]
    for spw, x in matrices.items():
        mine = got[got.spw == spw].sort_values(["i", "j"])
        i, j = np.triu_indices(len(x))
        assert mine.i.tolist() == i.tolist() and mine.j.tolist() == j.tolist()
        np.testing.assert_allclose(mine.g, (x @ x.T)[i, j], rtol=1e-9, atol=1e-12)
    got = decompose.covariance(cells, decompose.shapes(cells)).where("spw = 0").toPandas().sort_values(["i", "j"])
    assert whole == [3, 4]
    np.testing.assert_allclose(got.g, (matrices[0].T @ matrices[0])[np.triu_indices(30)], rtol=1e-9, atol=1e-12)


def test_cells_of_tiles_are_stored_once(spark, monkeypatch):
    """What is written for all pairs is the cells, however many pairs of tiles they are in; the pairs come without an exchange."""
    for name, value in (("PAIRED", 6), ("TILE", 4), ("CHUNK", 7)):
        monkeypatch.setattr(decompose, name, value)
    kept, stored = [], decompose.materialise
    monkeypatch.setattr(decompose, "materialise", lambda df, name: (kept.append(stored(df, name)), kept[-1])[1])
    rng = np.random.default_rng(7)
    matrices = {0: rng.normal(size=(40, 9)), 1: rng.normal(size=(41, 20))}
    matrices[1][5:9, :12] = 0.0
    cells = cells_of(spark, matrices).where("value <> 0").repartition(5)  # a sample's cells come in many pieces
    pairs = decompose.gram_matrix(cells)
    got = pairs.toPandas()
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    tiles = next(t for t in kept if "values" in t.columns).toPandas()
    assert tiles["values"].map(len).sum() == 8 * cells.count() and len(tiles) >= 20
    assert tiles["names"].map(len).max() <= 8 * decompose.TILE and tiles["values"].map(len).max() < 8 * (decompose.TILE * decompose.CHUNK + 20)
    for spw, x in matrices.items():
        mine = got[got.spw == spw].sort_values(["i", "j"])
        i, j = np.triu_indices(len(x))
        assert mine.i.tolist() == i.tolist() and mine.j.tolist() == j.tolist()
        np.testing.assert_allclose(mine.g, (x @ x.T)[i, j], rtol=1e-9, atol=1e-12)


def test_more_samples_than_features_come_from_tiles(spark, monkeypatch):
    """Their matrix has more entries than the band has cells."""
    whole = []
    blocks = decompose.product_blocks
    monkeypatch.setattr(decompose, "product_blocks", lambda cells, shape, *more: (whole.extend(r.spw for r in shape.collect()), blocks(cells, shape, *more))[1])
    rng = np.random.default_rng(8)
    matrices = {0: rng.normal(size=(9, 4)), 1: rng.normal(size=(4, 9))}
    rows = cells_of(spark, matrices)
    unnamed = spark.createDataFrame([(None, 1, 1, 1.0), (0, None, 1, 1.0), (0, 1, None, 1.0)], rows.schema)
    got = decompose.gram_matrix(rows.union(unnamed)).toPandas()
    assert 0 not in whole and 1 in whole
    for spw, x in matrices.items():
        mine = got[got.spw == spw].sort_values(["i", "j"])
        i, j = np.triu_indices(len(x))
        assert mine.i.tolist() == i.tolist() and mine.j.tolist() == j.tolist()
        np.testing.assert_allclose(mine.g, (x @ x.T)[i, j], rtol=1e-9, atol=1e-12)


def test_rounded_is_round(spark):
    rng = np.random.default_rng(9)
    some = rng.normal(size=4000) * 10.0 ** rng.uniform(-9, 5, 4000)
    halves = (np.rint(some * 1e6) + 0.5) / 1e6
    values = [*some.tolist(), *halves.tolist(), *np.nextafter(halves, 0).tolist(), None, float("nan"), float("inf"), -0.0, -1e-9, 5e-7, 1e300]
    got = spark.createDataFrame([(v,) for v in values], "g double").select((F.round("g", 6) + 0.0).cast("string").alias("a"), rounded(F.col("g"), 6).cast("string").alias("b"))
    assert got.where("NOT a <=> b").count() == 0


def test_nothing_varies(spark):
    run = decompose.Decomposition(cells_of(spark, {0: np.ones((3, 4))}))
    assert [r.evr for r in run.spectrum.collect()] == [0.0] * 3
    assert run.needed.first().n_components == 4


def test_nonfinite_cells(spark):
    got = decompose.zero_nonfinite(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "value double")).collect()
    assert [(r.value, r.replaced) for r in got] == [(0.0, True), (0.0, True), (0.0, True), (2.0, False)]


def test_threshold_on_published_ratios(spark):
    evr = [0.978996, 0.011643, 0.006140]
    rows = spark.createDataFrame([(0, i, float(sum(evr[: i + 1]))) for i in range(3)], "spw int, comp int, cum_evr double")
    assert decompose.components_needed(rows).first().n_components == 2

"""Leading components of bands that no task holds, and products over streams: against dense decompositions."""

import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alignkit.operators import decompose, range_finder


def cells_of(spark, matrices):
    rows = [(s, i, j, float(x[i, j])) for s, x in matrices.items() for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "spw int, time_pos long, feature int, value double")


def decaying(rng, n, p, rank):
    u, v = (np.linalg.qr(rng.normal(size=(m, rank)))[0] for m in (n, p))
    return u * 100 * 0.8 ** np.arange(rank) @ v.T


def test_leading_components_match_a_dense_run(spark, monkeypatch):
    monkeypatch.setattr(range_finder, "TILE", 16)
    rng = np.random.default_rng(0)
    matrices = {0: decaying(rng, 70, 90, 30), 1: decaying(rng, 90, 60, 12), 2: rng.normal(size=(9, 50))}
    run = decompose.Decomposition(cells_of(spark, matrices), stored=6, dense=40)
    spectrum, comp, score = run.spectrum.toPandas(), run.components.toPandas(), run.scores.toPandas()
    needed = {r.spw: r.n_components for r in run.needed.collect()}
    for spw, x in matrices.items():
        centred = x - x.mean(axis=0)
        u, s, v = np.linalg.svd(centred, full_matrices=False)
        mine = spectrum[spectrum.spw == spw].sort_values("comp")
        k = len(mine)
        assert k == (9 if spw == 2 else 6)
        np.testing.assert_allclose(mine.singular_value, s[:k], atol=1e-6 * s[0])
        np.testing.assert_allclose(mine.cum_evr, (np.cumsum(s**2) / (s**2).sum())[:k], atol=1e-9)
        for c in range(6):
            sign = np.sign(v[c][np.argmax(np.abs(v[c]))])
            mine = comp[(comp.spw == spw) & (comp.comp == c)].sort_values("feature").loading.to_numpy()
            np.testing.assert_allclose(mine, v[c] * sign, atol=1e-6)
            mine = score[(score.spw == spw) & (score.comp == c)].sort_values("time_pos").score.to_numpy()
            np.testing.assert_allclose(mine, u[:, c] * s[c] * sign, atol=1e-6 * s[0])
    assert needed[0] is None and needed[1] is None and needed[2] == 8  # six components don't reach 0.99 in the large ones
    more = decompose.Decomposition(cells_of(spark, {0: matrices[0]}), stored=20, dense=40)
    assert more.needed.first().n_components == decompose.Decomposition(cells_of(spark, {0: matrices[0]})).needed.first().n_components


def test_rank_below_the_width(spark, monkeypatch):
    monkeypatch.setattr(range_finder, "TILE", 8)
    x = np.outer(np.arange(30.0), np.ones(25)) + np.outer(np.cos(np.arange(30)), np.arange(25))
    run = decompose.Decomposition(cells_of(spark, {0: x}), stored=5, dense=4)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    mine = run.spectrum.orderBy("comp").toPandas().singular_value.to_numpy()
    np.testing.assert_allclose(mine[:2], s[:2], rtol=1e-9)
    assert (mine[2:] < 1e-9 * s[0]).all() and run.needed.first().n_components == int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.99)) + 1
    nothing = decompose.Decomposition(cells_of(spark, {0: np.ones((20, 20))}), stored=3, dense=4)
    assert [r.singular_value for r in nothing.spectrum.collect()] == [0.0] * 3 and nothing.components.count() == 0


def test_no_side_by_side_matrix(spark, monkeypatch):
    """No table of the range finder has more rows than blocks of its sides, tiles apart."""
    monkeypatch.setattr(range_finder, "TILE", 16)
    x = decaying(np.random.default_rng(2), 100, 120, 8)
    cells = cells_of(spark, {0: x}).select("spw", F.col("time_pos").alias("i"), F.col("feature").alias("j"), "value")
    found = range_finder.RangeFinder(cells, ["spw"], 4)
    assert range_finder.tiles(cells, ["spw"]).count() == 7 * 8 and found.rounds < range_finder.ROUNDS
    assert found.left.count() == 7 * 16 * 4 and found.right.count() == 8 * 16 * 4


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_products_over_a_stream(batch, monkeypatch):
    monkeypatch.setattr(decompose, "STRIP", 5)
    x = np.random.default_rng(1).normal(size=(33, 6))
    over, at, value = np.repeat(np.arange(33), 6), np.tile(np.arange(6), 33), x.ravel()
    product = decompose.Product(6)
    for i in range(0, len(over), batch):
        product.feed(pa.array(over[i : i + batch]), at[i : i + batch], value[i : i + batch])
    product.flush()
    np.testing.assert_allclose(product.total, x.T @ x)


def test_memory_does_not_grow_with_the_stream():
    """Sixty-four times the rows take no more memory: the product and one strip are held."""

    def peak(rows):
        product, rng = decompose.Product(64), np.random.default_rng(0)
        for first in range(0, rows, 1000):
            product.feed(pa.array(np.repeat(np.arange(first, first + 1000), 64)), np.tile(np.arange(64), 1000), rng.normal(size=64_000))
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    peak(2_000)
    small = peak(4_000)
    assert peak(256_000) - small < 64 * 1024  # KB; the rows themselves are 131 MB

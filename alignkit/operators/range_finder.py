"""Leading components of a matrix that has too many rows and too many columns for one task.

The matrix is cut into square tiles. A block of random columns is multiplied by the matrix and by its
transpose in turn, made orthonormal after each step, until the singular values stay (subspace
iteration). All matrices as long as the matrix's sides are tables of blocks of ``TILE`` rows; what one
task holds are tiles, blocks, and triangles as wide as the number of components sought.

A tall block table is made orthonormal by the triangles of its QR decomposition: each task folds its
blocks into one triangle, those are folded into one for the band, and the blocks are multiplied by
its inverse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise
from .streams import added, kinds, numbers_in, runs

#: Rows and columns of a tile.
TILE = 256
#: Components found beyond those that are wanted, which make the wanted ones converge.
OVERSAMPLE = 16
#: Relative change of the wanted singular values at which the iteration ends, and rounds at most.
TOLERANCE, ROUNDS = 1e-9, 40
#: Tiles of a row of tiles that are dealt out together; blocks that a task adds up before it hands them on.
SPAN, HELD = 64, 64
SEED = 20_240


def tiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """``by, row, col, data``: tiles of cells ``by, i, j, value`` (numbered from 0); absent cells are 0.

    Cells are dealt out by tile and sorted; a task holds one tile at a time.
    """
    side = TILE
    at = lambda c: (F.floor(F.col(c) / side).cast("int"), (F.col(c) % side).cast("int"))
    (row, r), (col, c) = at("i"), at("j")
    placed = cells.select(*by, row.alias("row"), col.alias("col"), r.alias("r"), c.alias("c"), "value")
    dealt = placed.repartition(*by, "row", F.floor(F.col("col") / SPAN)).sortWithinPartitions(*by, "row", "col")
    names = [*by, "row", "col"]

    def each(batches):
        held, tile, types = None, None, None
        give = lambda: pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(held, types, strict=True)], pa.array([tile.tobytes()], pa.binary())], names=[*names, "data"])
        for key, part in runs(batches, len(names)):
            if types is None or key != held:
                if types is not None:
                    yield give()
                held, tile, types = key, np.zeros((side, side)), [x.type for x in part.columns[: len(names)]]
            r, c, value = (part.column(len(names) + k).to_numpy(zero_copy_only=False) for k in range(3))
            tile[r, c] = value
        if types is not None:
            yield give()

    return dealt.mapInArrow(each, f"{kinds(placed, names)}, data binary")


def _products(rows: DataFrame, by: list[str], to: str, multiply) -> DataFrame:
    """``by, at, data``: products of ``rows(by, to, ...)`` by ``multiply(part, i)``, added up for each value of ``to``.

    A task adds what it can before it hands on, in at most ``HELD`` sums.
    """
    columns = [*by, to]

    def give(sums, types):
        keys = list(sums)
        return pa.RecordBatch.from_arrays([*[pa.array([k[n] for k in keys], t) for n, t in enumerate(types)], pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=[*by, "at", "data"])

    def each(batches):
        sums, types = {}, None
        for key, part in runs(batches, len(columns)):
            types = types or [c.type for c in part.columns[: len(columns)]]
            if key not in sums and len(sums) == HELD:
                yield give(sums, types)
                sums.clear()
            for i in range(part.num_rows):
                found = multiply(part, i)
                sums[key] = sums[key] + found if key in sums else found
        if sums:
            yield give(sums, types)

    fields = kinds(rows, columns).rpartition("`" + to + "`")
    return added(rows.select(*columns, *[c for c in rows.columns if c not in columns]).mapInArrow(each, f"{fields[0]}`at`{fields[2]}, data binary"), [*by, "at"])


def _random(cut: DataFrame, by: list[str], width: int, seed: int) -> DataFrame:
    """The matrix times a random one, whose rows are drawn from the number of the tile's column."""
    side, place = TILE, len(by) + 1

    def multiply(part, i):
        col = part.column(place)[i].as_py()
        return numbers_in(part.column(place + 1), i).reshape(side, side) @ np.random.default_rng([seed, col]).standard_normal((side, width))

    return _products(cut.select(*by, "row", "col", "data"), by, "row", multiply)


def _times(cut: DataFrame, block: DataFrame, by: list[str], over: str, to: str, width: int) -> DataFrame:
    """The matrix (over columns) or its transpose (over rows) times a block table ``by, at, data``."""
    side, place, transpose = TILE, len(by) + 1, over == "row"
    right = block.select(*by, F.col("at").alias(over), F.col("data").alias("_block"))
    both = cut.join(right, [*by, over]).select(*by, to, "data", "_block")

    def multiply(part, i):
        tile = numbers_in(part.column(place), i).reshape(side, side)
        return (tile.T if transpose else tile) @ numbers_in(part.column(place + 1), i).reshape(side, width)

    return _products(both, by, to, multiply)


def _folded(blocks: DataFrame, by: list[str], width: int) -> DataFrame:
    """``by, data``: triangles of the QR decomposition of each band's blocks, one for each task that has some."""

    def each(batches):
        found, types = {}, None
        for key, part in runs(batches, len(by)):
            types = types or [c.type for c in part.columns[: len(by)]]
            for i in range(part.num_rows):
                block = numbers_in(part.column(len(by)), i).reshape(-1, width)
                r = np.linalg.qr(np.vstack([found[key], block]) if key in found else block, mode="r")
                found[key] = np.vstack([r, np.zeros((width - len(r), width))])
        if types is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([k[n] for k in found], t) for n, t in enumerate(types)], pa.array([found[k].tobytes() for k in found], pa.binary())], names=[*by, "data"])

    return blocks.select(*by, "data").mapInArrow(each, f"{kinds(blocks, by)}, data binary")


def factors(blocks: DataFrame, by: list[str], width: int) -> DataFrame:
    """``by, values, turn``: singular values of each band's tall matrix and the vectors on its narrow side
    (a column each). A band's triangles meet in one task, which folds them as they come."""
    one = _folded(_folded(blocks, by, width).repartition(*by).sortWithinPartitions(*by), by, width)

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, s, v = np.linalg.svd(numbers_in(batch.column(len(by)), i).reshape(width, width))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[: len(by)]], pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([v.T.tobytes()], pa.binary())], names=[*by, "values", "turn"])

    return one.mapInArrow(each, f"{kinds(blocks, by)}, values array<double>, turn binary")


def turned(blocks: DataFrame, found: DataFrame, by: list[str], width: int, scaled: bool = True) -> DataFrame:
    """Blocks times the ``turn`` of their band; ``scaled``: each column divided by its singular value, so that
    the columns are orthonormal (one that is no more than rounding error is 0)."""
    columns = [*by, "at"]
    both = blocks.join(found, by).select(*columns, "data", "values", "turn") if by else blocks.crossJoin(found).select(*columns, "data", "values", "turn")
    n = len(columns)

    def each(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                s = np.array(batch.column(n + 1)[i].as_py())
                w = numbers_in(batch.column(n + 2), i).reshape(width, width)
                if scaled:
                    w = w * np.divide(1.0, s, out=np.zeros(width), where=s > s[0] * width * np.finfo(float).eps)
                out.append((numbers_in(batch.column(n), i).reshape(-1, width) @ w).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.binary())], names=[*columns, "data"])

    return both.mapInArrow(each, f"{kinds(blocks, columns)}, data binary")


def unpacked(blocks: DataFrame, by: list[str], width: int, kept: int) -> DataFrame:
    """``by, at, comp, u``: the first ``kept`` columns of a block table, a row for each entry; rows beyond the
    matrix's own are among them, all 0."""

    def each(batches):
        for key, part in runs(batches, len(by) + 1):
            for i in range(part.num_rows):
                x = numbers_in(part.column(len(by) + 1), i).reshape(-1, width)[:, :kept]
                rows = len(x)
                at = np.repeat(np.arange(rows) + key[-1] * rows, kept)
                own = [c.slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))) for c in part.columns[: len(by)]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int64()), pa.array(np.tile(np.arange(kept, dtype=np.int32), rows)), pa.array(x.ravel())], names=[*by, "at", "comp", "u"])

    columns = [*by, "at"]
    return blocks.select(*columns, "data").mapInArrow(each, f"{kinds(blocks, by)}{', ' if by else ''}at long, comp int, u double")


class RangeFinder:
    """The leading ``wanted`` components of each band of cells ``by, i, j, value``, whatever their extents.

    ``values``: ``by, comp, singular_value``; ``left`` and ``right``: ``by, at, comp, u``, entries of the vectors over
    rows ``i`` and columns ``j``. Components whose singular value is rounding error have value 0. The
    driver sees the wanted singular values of each band, to tell when they stay.
    """

    def __init__(self, cells: DataFrame, by: list[str], wanted: int, oversample: int = OVERSAMPLE, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = SEED):
        width = wanted + oversample
        cut = materialise(tiles(cells, by), "tiles")
        rows, last = materialise(_random(cut, by, width, seed), "range"), None
        self.rounds = 0
        while True:
            self.rounds += 1
            basis = materialise(turned(rows, factors(rows, by, width), by, width), "basis")
            columns = materialise(_times(cut, basis, by, "row", "col", width), "columns")
            found = materialise(factors(columns, by, width), "factors")
            values = {tuple(r[:-1]): np.array(r[-1][:wanted]) for r in found.select(*by, "values").collect()}
            if self.rounds == rounds or last is not None and all((np.abs(v - last[k]) <= tolerance * v[0]).all() for k, v in values.items()):
                break
            last = values
            discard(rows)
            rows = materialise(_times(cut, turned(columns, found, by, width), by, "col", "row", width), "range")
            for old in (basis, columns, found):
                discard(old)
        # The matrix is about basis * columns', and columns = right * values * turn'.
        noise = F.col("values")[0] * F.lit(width * float(np.finfo(float).eps))
        spectrum = found.select(*by, F.posexplode(F.transform(F.slice("values", 1, wanted), lambda s: F.when(s > noise, s).otherwise(0.0))).alias("comp", "singular_value"))
        self.values = spectrum
        self.left = unpacked(turned(basis, found, by, width, scaled=False), by, width, wanted)
        self.right = unpacked(turned(columns, found, by, width), by, width, wanted)

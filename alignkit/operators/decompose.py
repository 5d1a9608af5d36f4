"""Principal components per band, without bringing a band's matrix to one place.

Cells are long rows (band, time_pos, feature, value). With few samples and many features the n x n
Gram matrix is summed over shards of features; with more samples than features it is the p x p
covariance, summed over shards of samples. Shards are read as sorted streams. Partial matrices travel as
square blocks of doubles, are added block by block, and only the sum, of min(n, p) rows, is decomposed in
one task per band. Loadings or scores come back by a join of the cells with its vectors. Bands with more
than ``DENSE`` samples and features have no such matrix: their leading components are found over tiles
(``range_finder``). A band may be several columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, finite_or_zero
from ..sources.scratch import materialise
from . import ordered, range_finder
from .streams import added, changes, kinds, numbers_in, runs

THRESHOLD = 0.99
STORED = 40
#: Cells of a shard that a partial matrix is made from; more where the matrix is large, so that the
#: partial matrices stay smaller than the cells.
SHARD_CELLS = 1 << 20
#: Rows and columns of a block, and rows of the long side that are multiplied at a time.
BLOCK = STRIP = 256
#: Extent up to which a band's matrix of products is formed and decomposed in one task (128 MB of doubles).
DENSE = 4096
#: Samples up to which all pairs come from whole matrices of products, if there are no fewer features. Else they come
#: from tiles of at most ``TILE`` samples and, but for one sample, ``TILE`` x ``CHUNK`` cells; ``CHUNK`` features of two
#: tiles are multiplied at a time.
PAIRED, TILE, CHUNK = 2048, 1024, 128
#: Tiles that are written to a file.
TILES_IN_FILE = 8


def _list(band: str | list[str]) -> list[str]:
    return [band] if isinstance(band, str) else list(band)


def zero_nonfinite(cells: DataFrame) -> DataFrame:
    """``value`` with non-finite cells replaced by 0 and ``replaced`` telling which."""
    return cells.withColumn("replaced", ~finite(F.col("value"))).withColumn("value", finite_or_zero(F.col("value")))


def column_mean(cells: DataFrame, band: str | list[str] = "spw") -> DataFrame:
    return cells.groupBy(*_list(band), "feature").agg(F.avg("value").alias("mean"))


def centre_columns(cells: DataFrame, band: str | list[str] = "spw", store=lambda df, name: df) -> DataFrame:
    """Cells minus their column's mean; the mean is aggregated and joined back. ``store`` writes the means and reads them
    back: their size is known then, and the cells are not dealt out to meet a small table."""
    return cells.join(store(column_mean(cells, band), "means"), [*_list(band), "feature"]).withColumn("value", F.col("value") - F.col("mean")).drop("mean")


def shapes(cells: DataFrame, band: str | list[str] = "spw") -> DataFrame:
    """``band, n, p``: samples and features of each band."""
    return cells.groupBy(*_list(band)).agg(F.count_distinct("time_pos").alias("n"), F.count_distinct("feature").alias("p"))


def numbered(cells: DataFrame, column: str, band: str | list[str] = "spw") -> DataFrame:
    """``band, column, at``: the samples or features of each band in order, numbered from 0."""
    by = _list(band)
    return cells.select(*by, column).distinct().withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(column)) - 1)


class Product:
    """x.T @ x, summed over the rows of a long matrix that are fed in order: entries ``(over, at, value)``, those of
    a row (equal ``over``) in succession.

    Rows are filled into a strip of ``STRIP`` rows, which is multiplied when it is full. Memory is that of
    the product and of the strip, however many rows come.
    """

    def __init__(self, size: int):
        self.total, self.strip, self.row, self.last = np.zeros((size, size)), np.zeros((STRIP, size)), -1, None

    def feed(self, over: pa.Array, at: np.ndarray, value: np.ndarray) -> None:
        starts = changes([over])
        starts[0] = self.row < 0 or over[0].as_py() != self.last
        rows = self.row + np.cumsum(starts)
        self.last = over[-1].as_py()
        for a, b in _stretches(rows // STRIP):
            if self.row >= 0 and rows[a] // STRIP != self.row // STRIP:
                self.flush()
            self.strip[rows[a:b] % STRIP, at[a:b]] = value[a:b]
            self.row = int(rows[b - 1])

    def flush(self) -> None:
        self.total += self.strip.T @ self.strip
        self.strip[:] = 0.0


def _stretches(numbers: np.ndarray):
    """(begin, end) of each run of equal numbers."""
    cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True]).tolist()
    return zip(cuts[:-1], cuts[1:], strict=True)


def product_blocks(centred: DataFrame, shape: DataFrame, numbers: DataFrame, over: str, band: str | list[str] = "spw", shard_cells: int = SHARD_CELLS) -> DataFrame:
    """``band, row, col, data``: blocks of the matrix of products summed over ``over`` (``feature``: the
    Gram matrix of the samples, ``time_pos``: the covariance of the features), on and above the diagonal,
    filled up with zeros at its ends.

    ``shape(band, n, p)`` gives the number of shards. A shard is a stream sorted by ``over``: its task holds
    one matrix of products and one strip, and hands the matrix on once. A shard has four times as many
    cells as the matrix, so what is handed on is less than what came in.
    """
    by, kept = _list(band), "time_pos" if over == "feature" else "feature"
    size = F.col("n" if over == "feature" else "p")
    shards = F.ceil(F.col("n") * F.col("p") / F.greatest(F.lit(shard_cells), 4 * size * size))
    dealt = centred.join(shape, by).join(numbers, [*by, kept]).select(*by, F.pmod(F.xxhash64(over), shards).alias("_shard"), over, "at", "value", size.alias("size"))
    dealt = dealt.repartition(*by, "_shard").sortWithinPartitions(*by, "_shard", over)
    k = len(by)

    def give(held, product, types):
        product.flush()
        x, side = product.total, BLOCK
        for i in range(0, len(x), side):
            for j in range(i, len(x), side):
                block = np.zeros((side, side))
                part = x[i : i + side, j : j + side]
                block[: part.shape[0], : part.shape[1]] = part
                yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(held[:k], types, strict=False)], pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=[*by, "row", "col", "data"])

    def each(batches):
        held, product, types = None, None, None
        for key, part in runs(batches, k + 1):
            if product is None or key != held:
                if product is not None:
                    yield from give(held, product, types)
                held, types, product = key, [c.type for c in part.columns[:k]], None  # one matrix at a time
                product = Product(part.column(k + 4)[0].as_py())
            product.feed(part.column(k + 1), part.column(k + 2).to_numpy(), part.column(k + 3).to_numpy())
        if product is not None:
            yield from give(held, product, types)

    parts = dealt.mapInArrow(each, f"{kinds(dealt, by)}, row int, col int, data binary")
    return added(parts, [*by, "row", "col"])


def _pairs(blocks: DataFrame, numbers: DataFrame, kept: str, band: str | list[str]) -> DataFrame:
    """``band, i, j, g`` of blocks, for i <= j in order."""
    by = _list(band)

    def each(parts):
        for pdf in parts:
            for r in pdf.to_dict("records"):
                g = np.frombuffer(r["data"]).reshape(BLOCK, BLOCK)
                i, j = np.indices(g.shape)
                fine = (i + r["row"] <= j + r["col"]).ravel()  # those past the ends have no name and go
                out = pd.DataFrame({"_i": (i.ravel() + r["row"])[fine], "_j": (j.ravel() + r["col"])[fine], "g": g.ravel()[fine]})
                for c in reversed(by):
                    out.insert(0, c, r[c])
                yield out

    rows = blocks.mapInPandas(each, f"{kinds(blocks, by)}, _i int, _j int, g double")
    name = lambda at, to: numbers.select(*by, F.col(kept).cast("long").alias(to), F.col("at").alias(at))
    return rows.join(name("_i", "i"), [*by, "_i"]).join(name("_j", "j"), [*by, "_j"]).select(*by, "i", "j", "g")


def gram_matrix(centred: DataFrame, band: str | list[str] = "spw", shard_cells: int = SHARD_CELLS) -> DataFrame:
    """``band, i, j, g``: sums over features of value_i * value_j, for samples i <= j."""
    return _all_pairs(centred, shapes(centred, band), "feature", band, shard_cells)


def covariance(centred: DataFrame, shape: DataFrame, band: str | list[str] = "spw", shard_cells: int = SHARD_CELLS) -> DataFrame:
    """``band, i, j, g``: sums over samples of value_i * value_j, for features i <= j."""
    return _all_pairs(centred, shape, "time_pos", band, shard_cells)


def _all_pairs(centred: DataFrame, shape: DataFrame, over: str, band: str | list[str], shard_cells: int) -> DataFrame:
    """Bands of few rows, and no fewer columns, by whole matrices, so that these are no larger than the cells; the others
    by tiles. Which there are is asked first. Cells without a band, a sample or a feature are in no pair."""
    by, kept, size, other = _list(band), *(("time_pos", F.col("n"), F.col("p")) if over == "feature" else ("feature", F.col("p"), F.col("n")))
    for c in (*by, kept, over):
        centred = centred.where(F.col(c).isNotNull())
    shape = materialise(shape.select(*by, "n", "p"), "shapes")
    whole = (size <= PAIRED) & (size <= other)
    few, many = shape.agg(F.count_if(whole), F.count_if(~whole)).first()
    out = None
    if many:
        out = tiled_pairs(centred.join(shape.where(~whole).select(*by), by, "left_semi"), over, by)
    if few or not many:
        small = shape.where(whole)
        cells = centred.join(small.select(*by), by, "left_semi")
        numbers = numbered(cells, kept, by)
        rows = _pairs(product_blocks(cells, small, numbers, over, by, shard_cells), numbers, kept, by)
        out = rows if out is None else out.unionAll(rows)
    return out


def tiled_pairs(centred: DataFrame, over: str, band: str | list[str] = "spw") -> DataFrame:
    """``band, i, j, g`` for bands whose matrix of products no task can hold, or has more entries than the band has cells.

    The tiles are stored once (``stored_tiles``). A task of their Cartesian product reads some of them against some
    others, so that what is written doesn't grow with the pairs. It holds the products of one pair of tiles and hands
    them on a few rows at a time: its memory does not depend on the band's extents.
    """
    by = _list(band)
    k, cut = len(by), stored_tiles(centred, over, by)
    side = lambda at, names: cut.select(*names, F.col("_tile").alias(f"{at}tile"), *[F.col(c).alias(f"{at}{c}") for c in _TILE])
    left, right = side("_a", by), side("_b", [F.col(c).alias(f"_k{c}") for c in by])
    same = F.col("_atile") <= F.col("_btile")
    for c in by:
        same = same & (F.col(c) == F.col(f"_k{c}"))
    both = left.join(right.hint("shuffle_replicate_nl"), same).select(*by, (F.col("_atile") == F.col("_btile")).alias("_own"), *[f"{at}{c}" for at in ("_a", "_b") for c in _TILE])

    def products(a, b):
        total = np.zeros((len(a[0]), len(b[0])))
        chunks = [_stretch_of(x[2] // CHUNK) for x in (a, b)]
        for c in chunks[0].keys() & chunks[1].keys():
            strips = []
            for (names, rows, places, values), found in zip((a, b), chunks, strict=True):
                at, strip = slice(*found[c]), np.zeros((len(names), CHUNK))
                strip[rows[at], places[at] - c * CHUNK] = values[at]
                strips.append(strip)
            total += strips[0] @ strips[1].T
        return total

    def each(batches):
        for batch in batches:
            types = [c.type for c in batch.columns[:k]]
            for at in range(batch.num_rows):
                own = batch.column(k)[at].as_py()
                a, b = ([np.frombuffer(batch.column(k + 1 + s + c)[at].as_buffer(), t) for c, t in enumerate(_TILE.values())] for s in (0, len(_TILE)))
                total, step = products(a, b), max(1, (1 << 16) // len(b[0]))
                for r in range(0, len(a[0]), step):
                    x = total[r : r + step]
                    i, j = np.indices(x.shape)
                    fine = (i + r <= j).ravel() if own else np.ones(x.size, bool)
                    bands = [pa.repeat(pa.scalar(c[at].as_py(), t), int(fine.sum())) for c, t in zip(batch.columns[:k], types, strict=True)]
                    found = (a[0][r + i.ravel()[fine]], b[0][j.ravel()[fine]], x.ravel()[fine])
                    yield pa.RecordBatch.from_arrays([*bands, *map(pa.array, found)], names=[*by, "i", "j", "g"])

    return both.mapInArrow(each, f"{kinds(both, by)}, i long, j long, g double")


def _stretch_of(numbers: np.ndarray) -> dict[int, tuple[int, int]]:
    """(begin, end) of each of the numbers, equal ones of which stand together."""
    return {int(numbers[a]): (a, b) for a, b in _stretches(numbers)} if len(numbers) else {}


#: What is stored of a tile: the names of its rows, and of each cell its row in the tile, its column in the band and its
#: value, ``CHUNK`` columns after ``CHUNK`` columns.
_TILE = {"names": np.int64, "rows": np.int32, "places": np.int32, "values": np.float64}


def stored_tiles(centred: DataFrame, over: str, band: str | list[str] = "spw") -> DataFrame:
    """``band, _tile, names, rows, places, values``: each band's cells, once, in tiles of rows that follow each other.

    Rows are put in order with the cells that each has, and cut where a tile is full. Cells are packed before they are
    dealt out: what a task reads of a row in succession goes on as one.
    """
    by, kept = _list(band), "time_pos" if over == "feature" else "feature"
    k, spark = len(by), centred.sparkSession
    columns = materialise(ordered.numbered(centred.select(*by, over).distinct(), by, [F.col(over)]), "columns")
    counted = centred.groupBy(*by, kept).agg(F.greatest(F.count(F.lit(1)), F.lit(CHUNK)).alias("_cells"))
    before = ordered.numbered(counted, by, [F.col(kept)], "_before", weight=F.col("_cells"))
    first = before.groupBy(*by, F.floor(F.col("_before") / (TILE * CHUNK)).alias("_tile")).agg(F.min(kept).alias("_first"))
    starts = materialise(first.groupBy(*by).agg(F.sort_array(F.collect_list("_first")).alias("_starts")), "tiles")
    tiles = starts.agg(F.sum(F.size("_starts"))).first()[0] or 0
    cells = centred.join(columns, [*by, over]).select(*by, kept, F.col(kept).cast("long").alias("_name"), F.col("at").cast("int").alias("at"), "value")

    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                begins = np.flatnonzero(changes(batch.columns[: k + 1]))
                ends = np.r_[begins, batch.num_rows]
                raw = [pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in (batch.column(k + 2).to_numpy(), batch.column(k + 3).to_numpy())]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(begins)) for c in batch.columns[: k + 2]], *raw], names=[*by, kept, "_name", "places", "values"])

    pieces = cells.mapInArrow(packed, f"{kinds(cells, [*by, kept])}, _name long, places binary, values binary")
    tile = F.size(F.filter("_starts", lambda s: s <= F.col(kept))) - 1
    dealt = pieces.join(starts, by).select(*by, tile.alias("_tile"), kept, "_name", "places", "values")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tiles // TILES_IN_FILE))
    dealt = dealt.repartition(parts, *by, "_tile").sortWithinPartitions(*by, "_tile", kept)

    def give(held, types, found):
        names, rows, places, values = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(places // CHUNK, kind="stable")
        data = (names, rows[order], places[order], values[order])
        raw = [pa.array([np.asarray(x, t).tobytes()], pa.binary()) for x, t in zip(data, _TILE.values(), strict=True)]
        return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(held, types, strict=True)], *raw], names=[*by, "_tile", *_TILE])

    def each(batches):
        held, types, found, row, last = None, None, [], -1, None
        for key, part in runs(batches, k + 1):
            if key != held:
                if found:
                    yield give(held, types, found)
                held, types, found, row = key, [c.type for c in part.columns[: k + 1]], [], -1
            new = changes([part.column(k + 1)])
            new[0] = row < 0 or part.column(k + 1)[0].as_py() != last
            rows, last = (row + np.cumsum(new)).astype(np.int32), part.column(k + 1)[-1].as_py()
            row = int(rows[-1])
            places, values = (np.frombuffer(b"".join(part.column(k + c).to_pylist()), t) for c, t in ((3, np.int32), (4, np.float64)))
            of = [len(x) // values.itemsize for x in part.column(k + 4).to_pylist()]
            found.append((part.column(k + 2).to_numpy()[new], np.repeat(rows, of), places, values))
        if found:
            yield give(held, types, found)

    return materialise(dealt.mapInArrow(each, f"{kinds(dealt, [*by, '_tile'])}, {', '.join(f'{c} binary' for c in _TILE)}"), "tiles")


def eigen(blocks: DataFrame, shape: DataFrame, band: str | list[str] = "spw", stored: int = STORED) -> DataFrame:
    """``band, comp, singular_value, at, u``: the min(n, p) components, largest first, and the vectors of the
    first ``stored`` of them (one row without ``at`` and ``u`` for each of the rest).

    A band's blocks come to one task, which holds the matrix and what its decomposition needs. What is
    below the rounding error of the largest is no component of the cells: its singular value is 0.
    """
    by = _list(band)
    k = len(by)
    dealt = blocks.join(shape, by).select(*by, "row", "col", "n", "p", "data").repartition(*by).sortWithinPartitions(*by)

    def solve(held, types, n, p, g):
        values, vectors = np.linalg.eigh(g[: min(n, p), : min(n, p)], UPLO="U")
        values = values[::-1]
        values = np.where(values > values[0] * NOISE * len(values), values, 0.0)
        found = np.sqrt(values)
        for comp in range(len(values)):
            rows = len(values) if comp < stored else 1
            at, u = (np.arange(rows, dtype=np.int32), vectors[:, -1 - comp]) if comp < stored else ([None], [None])
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * rows, t) for v, t in zip(held, types, strict=True)], pa.array(np.full(rows, comp, np.int32)), pa.array(np.full(rows, found[comp])), pa.array(at, pa.int32()), pa.array(u, pa.float64())], names=[*by, "comp", "singular_value", "at", "u"])

    def each(batches):
        held, types, g, n, p = None, None, None, 0, 0
        for key, part in runs(batches, k):
            if g is None or key != held:
                if g is not None:
                    yield from solve(held, types, n, p, g)
                held, types, n, p = key, [c.type for c in part.columns[:k]], part.column(k + 2)[0].as_py(), part.column(k + 3)[0].as_py()
                g = np.zeros((-(-min(n, p) // BLOCK) * BLOCK,) * 2)
            for i in range(part.num_rows):
                row, col = part.column(k)[i].as_py(), part.column(k + 1)[i].as_py()
                g[row : row + BLOCK, col : col + BLOCK] = numbers_in(part.column(k + 4), i).reshape(BLOCK, BLOCK)
        if g is not None:
            yield from solve(held, types, n, p, g)

    return dealt.mapInArrow(each, f"{kinds(dealt, by)}, comp int, singular_value double, at int, u double")


#: Share of the largest eigenvalue, for each row of the matrix, that rounding may leave in one that is 0.
NOISE = 4 * float(np.finfo(float).eps)


def explained(spectrum: DataFrame, band: str | list[str] = "spw", totals: DataFrame | None = None) -> DataFrame:
    """``evr`` and ``cum_evr`` for rows of (band, comp, singular_value); all 0 where nothing varies.

    The whole is the sum over a band's rows, or what ``totals(band, total)`` gives where the rows are only
    its leading components.
    """
    squares = F.col("singular_value") * F.col("singular_value")
    if totals is not None:
        spectrum = spectrum.join(totals.withColumnRenamed("total", "_total"), _list(band))
    total = F.sum(squares).over(Window.partitionBy(*_list(band))) if totals is None else F.col("_total")
    order = Window.partitionBy(*_list(band)).orderBy("comp").rowsBetween(Window.unboundedPreceding, 0)
    return spectrum.withColumn("evr", F.when(total > 0, squares / total).otherwise(squares)).withColumn("cum_evr", F.sum("evr").over(order)).drop("_total")


def components_needed(spectrum: DataFrame, threshold: float = THRESHOLD, band: str | list[str] = "spw") -> DataFrame:
    """``band, n_components``: the first count whose ratios sum to the threshold; one more than there
    are if none does. For leading components only, null where they don't reach it (``Decomposition``)."""
    return spectrum.groupBy(*_list(band)).agg((F.count_if(F.col("cum_evr") < threshold) + 1).alias("n_components"))


def _largest_positive(value: str, place: str) -> Column:
    """The sign that makes a component's loading of largest size (the first of equals) positive."""
    return F.signum(F.max_by(value, F.struct(F.abs(value), -F.col(place))))


class Decomposition:
    """Tables of one run, each a DataFrame keyed by band: ``mean, spectrum, scores, components, needed, summary``.

    A band whose smaller extent is at most ``dense`` is decomposed whole: all its singular values are in
    ``spectrum``, and ``stored`` vectors. In a larger one the ``stored`` leading components are found by a
    range finder over tiles; their ratios are of the band's whole variance, and ``needed`` is null where
    they don't reach the threshold.

    ``store`` writes the shapes and the vectors of all bands, small tables, and reads them back, so that
    the tables made from them do not each decompose again; without it each table is a plan of its own.
    """

    def __init__(self, cells: DataFrame, band: str | list[str] = "spw", stored: int = STORED, threshold: float = THRESHOLD, store=lambda df, name: df, dense: int = DENSE):
        by = self.by = _list(band)
        clean = zero_nonfinite(cells)
        self.replaced = clean.agg(F.count_if("replaced").alias("replaced"))
        self.mean = column_mean(clean, by)
        centred = centre_columns(clean.drop("replaced"), by)
        shape = store(shapes(clean, by), "shapes")
        kind = cells.schema["feature"].dataType.simpleString()
        long_time = F.col("time_pos").cast("long").alias("time_pos")
        few, many = shape.where(f"n <= p AND n <= {dense}"), shape.where(f"n > p AND p <= {dense}")
        large = shape.where(f"least(n, p) > {dense}")
        # Few samples: vectors of the samples. Many: vectors of the features, which are the loadings.
        flat, tall = centred.join(few.select(*by), by, "left_semi"), centred.join(many.select(*by), by, "left_semi")
        samples, features = numbered(flat, "time_pos", by), numbered(tall, "feature", by)
        of_samples = eigen(product_blocks(flat, few, samples, "feature", by), few, by, stored).join(samples, [*by, "at"], "left")
        of_features = eigen(product_blocks(tall, many, features, "time_pos", by), many, by, stored).join(features, [*by, "at"], "left")
        of_samples = of_samples.select(*by, "comp", "singular_value", "u", long_time, F.lit(None).cast(kind).alias("feature"))
        of_features = of_features.select(*by, "comp", "singular_value", "u", F.lit(None).cast("long").alias("time_pos"), F.col("feature").cast(kind).alias("feature"))
        vectors = store(of_samples.unionByName(of_features), "vectors")
        self.spectrum = explained(vectors.select(*by, "comp", "singular_value").distinct(), by)
        kept = vectors.where((F.col("comp") < stored) & (F.col("singular_value") > 0))
        rows, axes = kept.where("time_pos IS NOT NULL").drop("feature"), kept.where("feature IS NOT NULL").drop("time_pos")
        loadings = flat.withColumn("time_pos", long_time).join(rows, [*by, "time_pos"]).groupBy(*by, "comp", "feature").agg((F.sum(F.col("value") * F.col("u")) / F.first("singular_value")).alias("loading"))
        loadings = loadings.unionByName(axes.select(*by, "comp", "feature", F.col("u").alias("loading")))
        # A sample's score is its vector's entry times the singular value, or the sum over its cells.
        of_cells = tall.join(axes.select(*by, "comp", "feature", "u"), [*by, "feature"]).groupBy(*by, "comp", long_time).agg(F.sum(F.col("value") * F.col("u")).alias("score"))
        scores = rows.select(*by, "comp", "time_pos", (F.col("u") * F.col("singular_value")).alias("score")).unionByName(of_cells)
        needed = components_needed(self.spectrum, threshold, by)
        if not large.isEmpty():
            spectrum, more_loadings, more_scores = self._leading(centred.join(large.select(*by), by, "left_semi"), by, stored)
            reached = spectrum.groupBy(*by).agg(F.max("cum_evr").alias("_reached"))
            self.spectrum = self.spectrum.unionByName(spectrum)
            loadings, scores = loadings.unionByName(more_loadings.withColumn("feature", F.col("feature").cast(kind))), scores.unionByName(more_scores)
            more = components_needed(spectrum, threshold, by).join(reached, by)
            needed = needed.unionByName(more.select(*by, F.when(F.col("_reached") >= threshold, F.col("n_components")).alias("n_components")))
        sign = loadings.groupBy(*by, "comp").agg(_largest_positive("loading", "feature").alias("_sign"))
        self.components = loadings.join(sign, [*by, "comp"]).select(*by, "comp", "feature", (F.col("loading") * F.col("_sign")).alias("loading"))
        self.scores = scores.join(sign, [*by, "comp"]).select(*by, "comp", "time_pos", (F.col("score") * F.col("_sign")).alias("score"))
        self.needed = needed
        five = self.spectrum.where("comp < 5").groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("comp", "evr"))), lambda r: r["evr"]).alias("top5_evr"))
        self.summary = shape.select(*by, F.col("n").alias("n_samples"), F.col("p").alias("n_features")).join(self.needed, by).join(five, by)

    @staticmethod
    def _leading(centred: DataFrame, by: list[str], stored: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(spectrum, loadings, scores) of the leading components of bands that no task can hold."""
        samples, features = (materialise(ordered.numbered(centred.select(*by, c).distinct(), by, [F.col(c)]), f"{c}-numbers") for c in ("time_pos", "feature"))
        placed = centred.join(samples.withColumnRenamed("at", "i"), [*by, "time_pos"]).join(features.withColumnRenamed("at", "j"), [*by, "feature"])
        found = range_finder.RangeFinder(placed.select(*by, "i", "j", "value"), by, stored)
        totals = centred.groupBy(*by).agg(F.sum(F.col("value") * F.col("value")).alias("total"))
        real = found.values.where("singular_value > 0")
        of = lambda vectors, names: vectors.join(real, [*by, "comp"]).join(names, [*by, "at"])
        loadings = of(found.right, features).select(*by, "comp", "feature", F.col("u").alias("loading"))
        scores = of(found.left, samples).select(*by, "comp", F.col("time_pos").cast("long").alias("time_pos"), (F.col("u") * F.col("singular_value")).alias("score"))
        return explained(found.values, by, totals), loadings, scores

    TABLES = ("mean", "spectrum", "scores", "components", "needed", "summary")

    def of(self, **values) -> Decomposition:
        """The tables of some of the bands: those with the given values of band columns, which go."""
        out = object.__new__(Decomposition)
        out.by = [c for c in self.by if c not in values]
        for name in self.TABLES:
            table = getattr(self, name)
            for c, v in values.items():
                table = table.where(F.col(c) == v).drop(c)
            setattr(out, name, table)
        return out

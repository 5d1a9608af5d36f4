"""Product codes of vectors; the nearest codebook entry is found by Orchard's search.

A vector is cut into equal parts, and each part is replaced by the number of the nearest entry of its
part's codebook. Entries keep lists of the other entries by distance. A search holds its best entry so
far and walks that entry's list: a nearer entry takes its place and its own list is walked from the
start, entries seen once are marked and passed over, and a list ends where its entries are more than
twice as far from the best entry as the vector is, for none from there on can be nearer.

Components are integers, so distances, sums and codebooks are exact and agree for any partitioning.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of the vectors that one step of a task works on.
STEP_CELLS = 1 << 18


def usable(vector: str = "embedding") -> Column:
    """True for a vector that is not null and holds no null, NaN or infinite component."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


@dataclass
class Codebooks:
    """``entries[part, entry]`` are integer vectors; ``width`` components make up a whole vector."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Digest of all components as decimals by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The components that a code stands for."""
        return [int(x) for part, at in enumerate(bytes.fromhex(code)) for x in self.entries[part, at]]


class Orchard:
    """Neighbour lists of all codebooks, and the search over them for many points at a time."""

    def __init__(self, books: Codebooks):
        parts, size, self.length = books.entries.shape
        self.size, self.flat = size, books.entries.reshape(parts * size, self.length)
        apart = np.stack([((e[:, None, :] - e[None, :, :]) ** 2).sum(axis=2) for e in books.entries])
        order = np.argsort(apart, axis=2, kind="stable")
        #: Of each entry: entries of its book by ascending distance (itself among the first), and those distances.
        self.lists = (order + (np.arange(parts) * size)[:, None, None]).reshape(parts * size, size)
        self.gaps = np.take_along_axis(apart, order, axis=2).reshape(parts * size, size)
        #: Entries of each book by their first component, where a search starts.
        self.by_first = np.argsort(books.entries[:, :, 0], axis=1, kind="stable") if self.length else np.zeros((parts, size), np.int64)

    def _starts(self, points: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Entries of the points' books with about the same first component."""
        best = part * self.size
        if self.length:
            for i, order in enumerate(self.by_first):
                own = part == i
                at = np.searchsorted(self.flat[i * self.size + order, 0], points[own, 0])
                best[own] += order[np.minimum(at, self.size - 1)]
        return best

    def _squares(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return ((points - self.flat[entries]) ** 2).sum(axis=1)

    def nearest(self, points: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest entry within its book, squared distance) of each point; of equally
        near entries the lower number."""
        best = self._starts(points, part)
        distance = self._squares(points, best)
        seen = np.zeros((len(points), self.size), bool)
        place = np.zeros(len(points), np.int64)
        live = np.arange(len(points))
        seen[live, best % self.size] = True
        while True:
            live = live[place[live] < self.size]
            live = live[self.gaps[best[live], place[live]] <= 4 * distance[live]]
            if not len(live):
                return best % self.size, distance
            entry = self.lists[best[live], place[live]]
            place[live] += 1
            new = ~seen[live, entry % self.size]
            at, entry = live[new], entry[new]
            seen[at, entry % self.size] = True
            squares = self._squares(points[at], entry)
            nearer = (squares < distance[at]) | ((squares == distance[at]) & (entry < best[at]))
            at = at[nearer]
            best[at], distance[at], place[at] = entry[nearer], squares[nearer], 0


def integers(vectors: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, a row of ``width`` integers for each vector, filled with 0."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 2 ** ((61 - max(width, 1).bit_length()) // 2):
        raise OverflowError("a component is too large for exact squared distances in 64 bits")
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat.astype(np.int64)
    return out


def _steps(column: pa.Array, width: int):
    rows = max(1, STEP_CELLS // max(width, 1))
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows)


def _assigned(vectors: pa.Array, books: Codebooks, search: Orchard, scale: int):
    """(points by row and part, entry by row and part, squared distances) of a step's vectors."""
    parts, _, length = books.entries.shape
    points = integers(vectors, books.width, scale).reshape(-1, length)
    entry, distance = search.nearest(points, np.tile(np.arange(parts), len(vectors)))
    return points.reshape(-1, parts, length), entry.reshape(-1, parts), distance.reshape(-1, parts)


def first_codebooks(vectors: DataFrame, id_col: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the ``entries`` vectors with the smallest ids, nulls last; equal ids by their vectors."""
    longest = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = vectors.select(id_col, vector).orderBy(F.asc_nulls_last(id_col), vector).limit(entries).select(vector).toArrow()
    column = first.column(0).combine_chunks()
    whole = integers(column, width, scale) if len(column) else np.zeros((0, width), np.int64)
    return Codebooks(whole.reshape(len(whole), parts, width // parts).transpose(1, 0, 2).copy())


def refine(vectors: DataFrame, books: Codebooks, vector: str, scale: int) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts that are nearest to it.

    A task adds up what it assigns and hands on one row for each entry and position, so the shuffle
    depends on the codebooks' size and not on the vectors, however many share an entry.
    """
    parts, size, length = books.entries.shape

    def each(batches):
        search = Orchard(books)
        sums, counts = np.zeros((parts * size, length), np.int64), np.zeros(parts * size, np.int64)
        for batch in batches:
            for _, step in _steps(batch.column(0), books.width):
                points, entry, _ = _assigned(step, books, search, scale)
                at = (entry + np.arange(parts) * size).ravel()
                np.add.at(sums, at, points.reshape(-1, length))
                counts += np.bincount(at, minlength=parts * size)
        used = np.flatnonzero(counts)
        rows = np.column_stack([sums[used], counts[used]])
        slot = np.repeat(used, length + 1)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.tile(np.arange(length + 1), len(used))), pa.array(rows.ravel())], names=["slot", "at", "total"])

    found = vectors.select(vector).mapInArrow(each, "slot long, at long, total long").groupBy("slot", "at").agg(F.sum("total").alias("total")).toArrow()
    totals = np.zeros((parts * size, length + 1), np.int64)
    slot, at, total = (c.to_numpy() for c in found.columns)
    totals[slot, at] = total
    used = totals[:, length] > 0
    flat = books.entries.reshape(parts * size, length).copy()
    flat[used] = totals[used, :length] // totals[used, length:]
    return Codebooks(flat.reshape(parts, size, length))


def train(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all usable vectors. The driver holds entries * width integers, whatever the table's size."""
    kept = vectors.where(usable(vector))
    books = first_codebooks(kept, id_col, vector, parts, entries, scale)
    if not books.entries.size:
        return books
    for _ in range(rounds):
        books = refine(kept, books, vector, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: list[str], vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Columns ``keep`` and ``code, error`` for each usable vector: the entries' numbers in order of the
    parts, two hex digits each, and the sum of the squared distances to them."""
    if books.entries.shape[1] > 256:
        raise ValueError("codes of two hex digits tell 256 entries apart")
    kept = vectors.where(usable(vector)).select(*keep, vector)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])

    def each(batches):
        search = Orchard(books)
        for batch in batches:
            for at, step in _steps(batch.column(len(keep)), books.width):
                _, entry, distance = _assigned(step, books, search, scale)
                codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(step)) for c in batch.columns[: len(keep)]], pa.array(codes, pa.string()), pa.array(distance.sum(axis=1), pa.int64())], names=[*keep, "code", "error"])

    return kept.mapInArrow(each, f"{schema}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each usable row of ``vectors(vec_id, embedding, label)``.

    Null vectors and vectors with a null or non-finite component are left out. Vectors shorter than
    the longest, or than a multiple of ``parts``, count as filled up with zeros; empty ones are all
    zeros. Repeated ids and rows are each coded; null ids come last among the first entries; null
    labels are one label. With fewer vectors than ``entries`` the codebooks are as small as that. An
    empty table gives no rows; other columns are not read. A component so large that squared
    distances pass 64 bits is an error.

    Codes are written once and read for both the sums by label and the result; a label's sum is
    combined before the shuffle, and comes back by an equi-join that Spark may split where a label
    is hot.
    """
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label"))
    books = train(table, parts=parts, entries=entries, rounds=rounds)
    coded = materialise(encode(table, books, ["vec_id", "label"]), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

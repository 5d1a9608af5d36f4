"""Work on sorted Arrow streams: runs of a key, and sums of blocks, without gathering a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def changes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row's values differ from those of the row before it (null is a value); true first."""
    out = np.zeros(len(columns[0]) if columns else 0, bool)
    for c in columns:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    out[:1] = True
    return out


def runs(batches, keys: int):
    """(values of the first ``keys`` columns, rows) of each run of equal keys in each batch, in order. A
    key's rows may go on in the next batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(changes(batch.columns[:keys])) if keys else np.zeros(1, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            yield tuple(c[a].as_py() for c in batch.columns[:keys]), batch.slice(a, b - a)


def kinds(df: DataFrame, columns: list[str]) -> str:
    """Columns with their types, as a schema."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def numbers_in(raw: pa.Array, at: int) -> np.ndarray:
    """The doubles of a binary value, without a copy."""
    return np.frombuffer(raw[at].as_buffer())


def added(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, data``: sums of the blocks (doubles as binary, of one size for a key) with equal keys.

    Blocks are dealt out and sorted by key, and a task adds them as they come: it holds one sum.
    """
    columns = [*keys, "data"]

    def each(batches):
        held, total, types = None, None, None
        give = lambda: pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(held, types, strict=True)], pa.array([total.tobytes()], pa.binary())], names=columns)
        for key, part in runs(batches, len(keys)):
            if types is None or key != held:
                if types is not None:
                    yield give()
                held, total, types = key, 0.0, [c.type for c in part.columns[: len(keys)]]
            for i in range(part.num_rows):
                total = total + numbers_in(part.column(len(keys)), i)
        if types is not None:
            yield give()

    return blocks.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, f"{kinds(blocks, keys)}, data binary")

"""SimHash near-duplicates, found with a Gray-order hierarchical index.

Fingerprints that differ in at most four bits agree in one of five blocks at least, so the different
fingerprints are dealt out five times, by the first bits of each block; how many bits grows with the
number of fingerprints, so that a bucket holds some hundreds. A bucket is sorted by Gray rank and
indexed: leaves of neighbouring fingerprints, and above them nodes that hold the bits which all members
share (a mask and a pattern; what a parent already holds is masked out below it). All fingerprints of the
bucket search the index; a search adds up the differences on its way down and drops a node with all its
members once they exceed the limit.

A bucket yields a spanning forest of its links, never all of them. Each two chunks of a bucket that is
larger than a chunk meet in a task of their own, so nothing is lost and no task is unbounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, materialise, salt_bit, salt_of, salts_in
from .components import components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: (first bit, bits) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints that a bucket holds on average, as far as the bits of a block go.
BUCKET = 512
#: Most bits of a block that deal fingerprints out, and fingerprints of a chunk.
MAX_KEY_BITS, CHUNK = 12, 1 << 20
#: Members of a node, and fingerprints that search at a time.
FAN, QUERIES = 4, 256
#: Shingles whose bits are unpacked at a time.
BITS_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of one text: bit i is 1 if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-size] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS_CHUNK):
        part = hashes[i : i + BITS_CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for each row of ``docs``."""

    def each(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Rank in Gray order of 64 bits, as a signed long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


class GrayIndex:
    """Index over fingerprints in Gray order. ``compared`` counts the members that searches came to."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.compared = fps, 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (pattern, mask of bits first shared here), from the leaves up
        low, high = fps, fps
        shared = []
        while len(low) > FAN or not shared:
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            shared.append((low, ~(low ^ high)))
        for i, (pattern, mask) in enumerate(shared):
            above = np.repeat(shared[i + 1][1], FAN)[: len(mask)] if i + 1 < len(shared) else np.uint64(0)
            self.levels.append((pattern, mask & ~above))
        self.rest = ~np.repeat(shared[0][1], FAN)[: len(fps)]  # bits that only the leaves' members tell apart

    def search(self, first: int, last: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs within ``limit`` bits: members ``first`` to ``last`` - 1 search among those
        that stand behind them."""
        top = np.arange(len(self.levels[-1][0]))
        q, node = np.repeat(np.arange(first, last), len(top)), np.tile(top, last - first)
        sums, span = np.zeros(len(q), np.uint8), FAN ** len(self.levels)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            sums = sums + np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node])
            near = (sums <= limit) & ((node + 1) * span > q + 1)
            q, node, sums, span = q[near], node[near], sums[near], span // FAN
            below = len(self.levels[depth - 1][0]) if depth else len(self.fps)
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            q, sums = np.repeat(q, FAN), np.repeat(sums, FAN)
            real = node < below
            q, sums, node = q[real], sums[real], node[real]
        later = node > q
        q, sums, node = q[later], sums[later], node[later]
        self.compared += len(q)
        near = sums + np.bitwise_count((self.fps[q] ^ self.fps[node]) & self.rest[node]) <= limit
        return q[near], node[near]


def _forest(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links of a bucket (in Gray order) join, one fewer than members each part."""
    index, root, a, b = GrayIndex(fps), list(range(len(fps))), [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for at in range(0, len(fps), QUERIES):
        for q, x in zip(*[c.tolist() for c in index.search(at, min(at + QUERIES, len(fps)), limit)], strict=True):
            p, r = find(q), find(x)
            if p != r:
                root[max(p, r)] = min(p, r)
                a.append(q)
                b.append(x)
    return np.array(a, np.int64), np.array(b, np.int64)


def _link_runs(batches, limit: int):
    """Links inside runs of equal (block, key, low, high): batches of these, rank-sorted fp, node."""

    def out(starts, fps, node):
        x, y = [], []
        for s, e in zip(starts, [*starts[1:], len(fps)], strict=True):
            if e - s > 1:
                a, b = _forest(fps[s:e], limit)
                x.append(node[s + a])
                y.append(node[s + b])
        x, y = (np.concatenate(c) if c else np.array([], np.int64) for c in (x, y))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y), pa.int64()), pa.array(np.minimum(x, y), pa.int64())], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        table = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, table, strict=True)] if held else table
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[:-2]], axis=0)) + 1
        if not len(change):
            continue
        cut = int(change[-1])  # the last run may go on in the next batch
        yield out([0, *change[:-1].tolist()], held[-2][:cut].view(np.uint64), held[-1][:cut])
        held = [x[cut:] for x in held]
    if held and len(held[0]):
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[:-2]], axis=0)) + 1
        yield out([0, *change.tolist()], held[-2].view(np.uint64), held[-1])


def key_bits_for(n: int, bucket: int = BUCKET) -> int:
    """Bits of a block that deal ``n`` fingerprints into buckets of about ``bucket``."""
    return min(MAX_KEY_BITS, max(0, (max(1, n) // bucket).bit_length()))


def _block_keys(fp: Column, bits: int) -> Column:
    """The five (block, its first ``bits`` bits) of a fingerprint."""
    keys = [F.shiftrightunsigned(fp, at + n - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int") for at, n in BLOCKS]
    return F.array(*[F.struct(F.lit(i).alias("block"), k.alias("key")) for i, k in enumerate(keys)])


def near_pairs(classes: DataFrame, limit: int = MAX_BITS, key_bits: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` (a > b) whose components are those of all links between ``classes(fp, node)``.

    ``limit`` up to 4: one of the five blocks is then equal in any link. ``key_bits`` (0 to 12; default
    by the number of classes) changes how the search is dealt out, not its result.
    """
    if not 0 <= limit < len(BLOCKS):
        raise ValueError("limit must be 0 to 4")
    bits = key_bits_for(classes.count()) if key_bits is None else key_bits
    rows = classes.select(F.explode(_block_keys(F.col("fp"), bits)).alias("k"), "fp", "node").select("k.block", "k.key", "fp", "node")
    # At most 5 * 2^12 rows, whatever the table.
    buckets = rows.groupBy("block", "key").count().select("block", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    met = rows.join(F.broadcast(buckets), ["block", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["block", "key", "low", "high"]
    dealt = met.select("block", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "node").repartition(*key).sortWithinPartitions(*key, gray_rank(F.col("fp")))
    return dealt.mapInArrow(lambda batches: _link_runs(batches, limit), "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = MAX_BITS, key_bits: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Null and blank texts have the fingerprint zero and are linked like any other. Equal fingerprints
    form one class, named by its smallest ``doc_id``; only classes are compared, and members get
    their class back over (fp, salt), so a class that holds a third of the rows is dealt over 64
    keys. Rows that repeat an id are each reported. An empty table gives no rows; columns other than
    ``doc_id`` and ``text`` are not read.
    """
    members = materialise(fingerprints(docs).withColumn("salt", salt_of()), "fingerprints")
    salted = members.groupBy("fp", "salt").agg(F.min("doc_id").alias("node"))
    classes = materialise(salted.groupBy("fp").agg(F.min("node").alias("node"), F.bit_or(salt_bit(F.col("salt"))).alias("salts")), "fingerprint-classes")
    linked = components(near_pairs(classes.where(F.col("node").isNotNull()), limit, key_bits, chunk))
    named = classes.join(linked, "node", "left").select("fp", F.explode(salts_in(F.col("salts"))).alias("salt"), F.coalesce("component", "node").alias("component_id"))
    return members.join(named, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one with the smallest ``doc_id``.

    The ids that go are joined away by the same sort-merge join at every size; texts are shuffled once. Of rows that repeat the id
    that stays, all stay (exact deduplication comes before).
    """
    gone = near_duplicates(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


assert SALTS == 64  # a salt mask is one long

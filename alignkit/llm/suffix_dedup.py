"""Removal of repeated passages by distributed suffix sorting with a difference cover.

A byte goes if it is covered by a 50-byte string that also starts in a document with a smaller id.

1. *Dealing out.* Texts are packed into batches, written once. Each 50-byte window is given the least
   hashed 16-byte string inside it, its anchor: equal windows have equal anchors, so windows of different
   anchors need never be compared. Batches send the hashes of their anchors, and learn which of them
   stand in one document only. Different hashes prove different strings, so windows of those anchors are
   proven to occur once; that is all that hashes decide.
2. *Suffix sorting.* The texts around all other anchors are dealt out by anchor. Each task puts the
   suffixes of its texts in order by the difference cover modulo 3: it sorts the triples at sampled
   positions, names them, recurses on the names, merges the remaining suffixes, and compares adjacent
   prefixes of 50 bytes, as bytes. Equal texts around an anchor are found by comparing them whole first,
   in a batch and in a task: of those only the first document's is sorted.
3. *Removal.* Covered windows go back to their batches, which are cut there.

An anchor with very many different surroundings is dealt out by the hashes of its windows instead, each
window a text of its own: equal windows still meet, and no anchor is one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty

LENGTH = 50
GRAM = 16
#: Bytes of text of a batch, and as many again as its last document has.
BATCH_BYTES = 4 << 20
#: Bytes of text that anchors are found in at a time, thus what a worker's arrays are sized by.
GROUP_BYTES = 1 << 18
#: Bytes of text whose anchors, and whose surroundings, one part of a shuffle gets on average.
ANCHOR_BYTES, PIECE_BYTES = 24 << 20, 8 << 20
#: Partitions of a shuffle at most; with more parts, a partition gets several, which a task takes in turn.
PARTITIONS = 10_000
#: Bytes of text that are suffix-sorted at a time, and as many again if the last anchor has them.
CHUNK_BYTES = 1 << 18
#: Different surroundings of an anchor, counted batch by batch, beyond which its windows are dealt out one
#: by one.
HOT = 4096
#: Bits of an anchor's hash that travel.
KEY_BITS = 48
#: Bits of a hash that make room for a place in the text when the least one is looked for.
PLACE_BITS = 21
LEAST_ID = -(2**62)

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def occurrences(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: ``anchor, surrounding, text, start, windows``.

    ``anchor`` and ``surrounding`` are hashes; the windows are those that start at ``start`` in text
    number ``text`` and the next ``windows - 1``.
    """
    width, n = length - gram + 1, len(data)
    none = np.array([], np.int64)
    if n < length or not (sizes >= length).any():
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    power, inverse = _powers(_R, n + 1), _powers(_R_INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    if n > 1 << PLACE_BITS:
        raise ValueError("too much text at a time")
    bits = np.uint64(PLACE_BITS)  # the same for all texts, so that equal windows choose alike
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # ties go to the left
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(least) - (width - step)], least[width - step :]) if width > step else least
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    start = np.arange(len(at))
    start = start[start + length <= ends[text]]
    at, text = at[start], text[start]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    windows = np.diff(np.r_[first, len(at)])
    begin, text, at = start[first], text[first], at[first]
    around = _mix((sums[begin + windows + length - 1] - sums[begin]) * inverse[begin] + (windows * 64 + at - begin).astype(np.uint64))
    return grams[at], around, text, begin - (ends - sizes)[text], windows


def _planes(values: np.ndarray, n_bytes: int) -> bytes:
    """Integers as planes of their bytes, so that planes of zeros vanish when compressed."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T.tobytes()


def _unplanes(raw: bytes, n: int, n_bytes: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(raw, np.uint8).reshape(n_bytes, n).T
    return out.view("<u8").ravel()


def _grouped(batches):
    """(key, rows) for runs of equal values in the first column, over Arrow batches."""
    held, now = [], None
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            row = [x.as_py() for x in row]
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held


_BATCH = "batch long, ids binary, sizes binary, texts binary"


def _batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """``batch, ids, sizes, texts``: documents in batches, their texts one after the other, compressed."""

    def each(batches):
        import zstandard
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        pack = zstandard.ZstdCompressor(level=3)

        def row(ids, raw):
            sizes = np.array([len(r) for r in raw], "<i8")
            columns = [[first + made], [np.array(ids, "<i8").tobytes()], [sizes.tobytes()], [pack.compress(b"".join(raw))]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["batch", "ids", "sizes", "texts"])

        ids, raw, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                raw.append(t.as_py().encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                if size >= batch_bytes:
                    yield row(ids, raw)
                    made += 1
                    ids, raw, size = [], [], 0
        if ids:
            yield row(ids, raw)

    return docs.mapInArrow(each, _BATCH)


class _Batch:
    """One batch unpacked: ``ids``, ``sizes`` and ``begins`` of its documents, their bytes as ``text``."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes):
        import zstandard

        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.text = zstandard.ZstdDecompressor().decompress(texts)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _groups(self):
        """(documents, offsets in them, sizes) of pieces of text up to ``GROUP_BYTES`` together. A longer text
        comes in parts that overlap by a window less one byte: each window is in one part only."""
        docs, offsets, sizes, total = [], [], [], 0
        for d, size in enumerate(self.sizes.tolist()):
            for at in range(0, max(1, size - LENGTH + 1), GROUP_BYTES - LENGTH + 1):
                part = min(GROUP_BYTES, size - at)
                if total + part > GROUP_BYTES and docs:
                    yield docs, offsets, sizes
                    docs, offsets, sizes, total = [], [], [], 0
                docs.append(d)
                offsets.append(at)
                sizes.append(part)
                total += part
        if docs:
            yield docs, offsets, sizes

    def occurrences(self) -> tuple[np.ndarray, ...]:
        """``key, surrounding, doc, start, windows`` of the anchors of all documents."""
        found, data = [], np.frombuffer(self.text, np.uint8)
        for docs, offsets, sizes in self._groups():
            at = self.begins[docs] + np.array(offsets)
            parts = [data[a : a + n] for a, n in zip(at.tolist(), sizes, strict=True)]
            anchor, around, text, start, windows = occurrences(np.concatenate(parts), np.array(sizes))
            # Least hashes are small; mixed once more they are spread over all parts alike.
            found.append((_mix(anchor) >> np.uint64(64 - KEY_BITS), around, np.array(docs)[text], start + np.array(offsets)[text], windows))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _slices(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending keys: each part has a range of keys."""
    part = ((keys >> np.uint64(16)) * np.uint64(parts) >> np.uint64(KEY_BITS - 16)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist() if len(part) else []
    return [(int(part[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _distinct(batch: _Batch):
    """(occurrences in order of key, number of each one's key, different keys, their surroundings, whether
    they stand in several documents) of a batch."""
    key, around, doc, start, windows = batch.occurrences()
    order = np.lexsort((around, key))
    key, around, doc, start, windows = (x[order] for x in (key, around, doc, start, windows))
    fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    number, firsts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    if not len(firsts):
        return (key, around, doc, start, windows), number, key, number, fresh
    other = fresh | np.r_[True, around[1:] != around[:-1]]
    ids = batch.ids[doc]
    several = np.minimum.reduceat(ids, firsts) != np.maximum.reduceat(ids, firsts)
    return (key, around, doc, start, windows), number, key[firsts], np.add.reduceat(other.astype(np.int64), firsts), several


def _anchors(batches: DataFrame, parts: int) -> DataFrame:
    """``part, batch, n, blob``: the different anchors of each batch, in order, by ranges of their hashes."""

    def each(rows):
        for table in rows:
            for number, ids, sizes, texts in zip(*[c.to_pylist() for c in table.columns], strict=True):
                _, _, keys, around, several = _distinct(_Batch(ids, sizes, texts))
                out = []
                for part, a, b in _slices(keys, parts):
                    gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                    raw = _planes(gaps, KEY_BITS // 8) + _planes(np.minimum(around[a:b], 65535), 2) + np.packbits(several[a:b]).tobytes()
                    out.append((part, number, b - a, raw))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "batch", "n", "blob"])

    return batches.mapInArrow(each, "part int, batch long, n int, blob binary")


def _verdicts(anchors: DataFrame, hot: int) -> DataFrame:
    """``batch, part, codes``: two bits for each anchor in the order it was sent: 0 where it stands in one
    document only, 1 where it may stand in several, 2 where it also has very many surroundings."""

    def judge(rows):
        keys, around, several = [], [], []
        for _, _, n, raw in rows:
            wide = n * KEY_BITS // 8
            keys.append(np.cumsum(_unplanes(raw[:wide], n, KEY_BITS // 8)))
            around.append(_unplanes(raw[wide : wide + 2 * n], n, 2).astype(np.int64))
            several.append(np.unpackbits(np.frombuffer(raw[wide + 2 * n :], np.uint8), count=n).astype(bool))
        sizes = [len(k) for k in keys]
        keys, around, several = (np.concatenate(x) for x in (keys, around, several))
        order = np.argsort(keys, kind="stable")
        firsts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        lengths = np.diff(np.r_[firsts, len(order)])
        repeated = (lengths > 1) | np.logical_or.reduceat(several[order], firsts)
        code = repeated * (1 + (np.add.reduceat(around[order], firsts) > hot))
        codes = np.empty(len(order), np.uint8)
        codes[order] = np.repeat(code, lengths)
        ends = np.cumsum(sizes).tolist()
        for (part, batch, n, _), end in zip(rows, ends, strict=True):
            own = codes[end - n : end]
            yield batch, part, np.packbits(own & 1).tobytes() + np.packbits(own >> 1).tobytes()

    def each(batches):
        for _, rows in _grouped(batches):
            out = list(judge(rows))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["batch", "part", "codes"])

    return anchors.mapInArrow(each, "batch long, part int, codes binary")


#: Bytes of: deal key's gap, id above the blob's least, document in its batch, start, bytes of a piece.
_PIECE = (6, 8, 3, 6, 1)


def _pieces(batches: DataFrame, anchor_parts: int, parts: int) -> DataFrame:
    """``part, batch, n, low, blob``: what stands around anchors that may occur in several documents, in order
    of deal key; with part -1, windows known to be covered. ``batches`` also has ``codes(part, codes)``."""

    def pack(keys, ids, doc, start, texts):
        import zstandard

        low = int(ids.min())
        columns = (np.diff(keys, prepend=np.uint64(0)), ids - low, doc, start, np.array([len(t) for t in texts]))
        return low, zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(c, n) for c, n in zip(columns, _PIECE, strict=True)) + b"".join(texts))

    def solve(number, ids, sizes, texts, codes):
        batch = _Batch(ids, sizes, texts)
        (key, _, doc, start, windows), of, keys, _, _ = _distinct(batch)
        code = np.zeros(len(keys), np.uint8)
        packed = dict(codes or [])
        for part, a, b in _slices(keys, anchor_parts):
            raw = np.frombuffer(packed[part], np.uint8)
            half = len(raw) // 2
            code[a:b] = np.unpackbits(raw[:half], count=b - a) | np.unpackbits(raw[half:], count=b - a) << 1
        code = code[of]
        near, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        many = windows[hot]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        doc = np.r_[doc[near], np.repeat(doc[hot], many)]
        start = np.r_[start[near], np.repeat(start[hot], many) + step]
        size = np.r_[windows[near] + LENGTH - 1, np.full(len(step), LENGTH)]
        begin = batch.begins[doc] + start
        texts = [batch.text[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        # Windows of hot anchors go by themselves; any function of the bytes alone will do.
        own = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest()[:6], "little") for t in texts[len(near) :]]
        deal = np.r_[key[near], np.array(own, np.uint64)].astype(np.uint64)
        order = np.lexsort((start, batch.ids[doc]))
        seen, kept, late = {}, [], []
        ids = batch.ids[doc]
        for i, a in zip(order.tolist(), ids[order].tolist(), strict=True):
            first = seen.setdefault(texts[i], a)
            (kept if first == a else late).append(i)
        out = []
        if late:
            late = np.array(late)
            out.append((-1, number, len(late), 0, _covered(doc[late], start[late], size[late] - LENGTH + 1)))
        kept = np.array(kept, np.int64)
        kept = kept[np.argsort(deal[kept], kind="stable")]
        for part, a, b in _slices(deal[kept], parts):
            at = kept[a:b]
            out.append((part, number, b - a, *pack(deal[at], ids[at], doc[at], start[at], [texts[i] for i in at.tolist()])))
        return out

    def each(rows):
        for table in rows:
            for row in zip(*[c.to_pylist() for c in table.columns[:4]], table.column(4), strict=True):
                codes = [(x["part"], x["codes"]) for x in row[4].as_py() or []]
                if out := solve(*row[:4], codes):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "batch", "n", "low", "blob"])

    return batches.mapInArrow(each, "part int, batch long, n int, low long, blob binary")


def _covered(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> bytes:
    """Covered windows of a batch as packed (document, start, windows), those that follow each other as one."""
    order = np.lexsort((start, doc))
    doc, start, windows = doc[order], start[order], windows[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != (start + windows)[:-1])])
    return np.stack([doc[first], start[first], np.add.reduceat(windows, first)], axis=1).astype("<i8").tobytes()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (integers from 1) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with n % 3 == 1 the empty suffix ends the first third
    sampled = np.concatenate([one, two])
    bits = max(1, int(t.max()).bit_length())
    if 3 * bits <= 63:
        key = (t[sampled] << (2 * bits)) | (t[sampled + 1] << bits) | t[sampled + 2]
        order = np.argsort(key)
        change = key[order[1:]] != key[order[:-1]]
    else:
        pair = (t[sampled] << bits) | t[sampled + 1]
        order = np.lexsort((t[sampled + 2], pair))
        change = (pair[order[1:]] != pair[order[:-1]]) | (t[sampled + 2][order[1:]] != t[sampled + 2][order[:-1]])
    names = np.empty(len(sampled), np.int64)
    names[order] = np.r_[1, 1 + np.cumsum(change)]
    if names.max() < len(names):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    sorted_sampled = sampled[order]
    sorted_sampled = sorted_sampled[sorted_sampled < n]
    rest = np.arange(0, n, 3)
    wide = int(rank.max()).bit_length()
    first = (t[rest] << wide) | rank[rest + 1]
    rest = rest[np.argsort(first)]
    # Merge: a remaining suffix meets those at 1 mod 3 over one character and a rank, those at 2 mod 3 over two.
    ones, twos = sorted_sampled[sorted_sampled % 3 == 1], sorted_sampled[sorted_sampled % 3 == 2]
    before = np.searchsorted((t[ones] << wide) | rank[ones + 1], (t[rest] << wide) | rank[rest + 1])
    theirs, own = (t[twos] << bits) | t[twos + 1], (t[rest] << bits) | t[rest + 1]
    if 2 * bits + wide > 63:
        dense = np.unique(np.concatenate([theirs, own]), return_inverse=True)[1]
        theirs, own = dense[: len(twos)], dense[len(twos) :]
    before += np.searchsorted((theirs << wide) | rank[twos + 2], (own << wide) | rank[rest + 2])
    out = np.empty(n, np.int64)
    places = before + np.arange(len(rest))
    taken = np.ones(n, bool)
    taken[places] = False
    out[places], out[taken] = rest, sorted_sampled
    return out


def covered_windows(pieces: list[bytes], doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) pairs whose window also occurs in a piece of a smaller document."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    text = data.astype(np.int64) + 2
    text[begin + sizes] = 1
    order = suffix_array(text)
    order = order[order + length <= (begin + sizes)[piece[order]]]
    if not len(order):
        return order, order
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    change = np.ones(len(order), bool)
    for a in range(1, len(order), 1 << 18):
        b = min(len(order), a + (1 << 18))
        change[a:b] = (windows[order[a:b]] != windows[order[a - 1 : b - 1]]).any(axis=1)
    runs = np.flatnonzero(change)
    least = np.minimum.reduceat(doc[piece[order]], runs)[np.cumsum(change) - 1]
    hit = order[doc[piece[order]] > least]
    return piece[hit], hit - begin[piece[hit]]


def _sorted_pieces(rows: DataFrame) -> DataFrame:
    """``batch, blob``: covered windows, from the rows of ``_pieces``."""

    def settle(rows):
        import zstandard

        unpack, fields, texts, of = zstandard.ZstdDecompressor(), [[] for _ in _PIECE], [], []
        for k, (_, _, n, low, raw) in enumerate(rows):
            raw, at = unpack.decompress(raw), 0
            for f, wide in zip(fields, _PIECE, strict=True):
                f.append(_unplanes(raw[at : at + n * wide], n, wide))
                at += n * wide
            fields[0][-1] = np.cumsum(fields[0][-1])
            fields[1][-1] = fields[1][-1].view(np.int64) + low
            texts.append(raw[at:])
            of.append(np.full(n, k))
        key, ids, doc, start, size = (np.concatenate(f).astype(np.int64) for f in fields)
        of, texts = np.concatenate(of), b"".join(texts)
        place, windows, hits = np.cumsum(size) - size, size - LENGTH + 1, []

        def compare(at: np.ndarray):
            """Pieces of whole keys. Of equal ones those of later documents are covered as a whole; the others
            are sorted, unless one is alone with its key."""
            own, seen = [texts[a : a + n] for a, n in zip(place[at].tolist(), size[at].tolist(), strict=True)], {}
            first = np.array([seen.setdefault(t, i) for t, i in zip(own, ids[at].tolist(), strict=True)]) == ids[at]
            if not first.all():
                hits.append((at[~first], start[at[~first]], windows[at[~first]]))
            own, left = [t for t, f in zip(own, first.tolist(), strict=True) if f], at[first]
            cuts = np.flatnonzero(np.r_[True, key[left][1:] != key[left][:-1], True])
            several = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
            if several.any():
                own, left = [t for t, f in zip(own, several.tolist(), strict=True) if f], left[several]
                piece, window = covered_windows(own, ids[left])
                hits.append((left[piece], start[left[piece]] + window, np.ones(len(piece), np.int64)))

        order = np.lexsort((ids, key))
        cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True]).tolist()
        chunk, total = [], 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                chunk.append(order[a:b])
                total += int(size[order[a:b]].sum())
            if chunk and (total >= CHUNK_BYTES or b == len(order)):
                compare(np.concatenate(chunk))
                chunk, total = [], 0
        which, begin, count = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 3
        for k in np.unique(of[which]).tolist():
            mine = of[which] == k
            yield rows[k][1], _covered(doc[which[mine]], begin[mine], count[mine])

    def each(batches):
        for part, rows in _grouped(batches):
            out = [(r[1], r[4]) for r in rows] if part < 0 else list(settle(rows))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["batch", "blob"])

    return rows.mapInArrow(each, "batch long, blob binary")


def _cut_out(batches: DataFrame) -> DataFrame:
    """The result, from batches with ``found``, a list of packed covered windows (null: none)."""

    def each(tables):
        for table in tables:
            for ids, sizes, texts, found in zip(*[table.column(c).to_pylist() for c in ("ids", "sizes", "texts", "found")], strict=True):
                batch = _Batch(ids, sizes, texts)
                rows = np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 3) for b in found]) if found else np.zeros((0, 3), np.int64)
                rows, out = rows[np.argsort(rows[:, 0], kind="stable")], []
                cuts = np.searchsorted(rows[:, 0], np.arange(len(batch.ids) + 1))
                for d, (begin, size) in enumerate(zip(batch.begins.tolist(), batch.sizes.tolist(), strict=True)):
                    text, own = batch.text[begin : begin + size], rows[cuts[d] : cuts[d + 1]]
                    if not len(own):
                        out.append((size, 0, 0, hashlib.sha256(text).hexdigest()))
                        continue
                    gone = np.bincount(own[:, 1], minlength=size + 1) - np.bincount(own[:, 1] + own[:, 2] + LENGTH - 1, minlength=size + 1)
                    gone = np.cumsum(gone)[:size] > 0
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                    out.append((size, int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
                n, removed, spans, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(batch.ids), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return batches.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _stored(batches: DataFrame) -> DataFrame:
    """The batches, written once to the shared folder in buckets of their numbers, so that what comes back
    to them meets them there and their texts are not shuffled."""
    spark = batches.sparkSession
    path = scratch_path(spark, "batches")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, "batch").sortBy("batch").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay: a plan that reads them needs no entry in the catalog
    return table


def remove_repeats(docs: DataFrame, batch_bytes: int = BATCH_BYTES, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``.

    Null and empty texts lose nothing. A null id counts as the least. Rows that repeat an id are each
    judged on their own text: what they share with each other stays. An empty table gives no rows; columns
    other than ``doc_id`` and ``text`` are not read. ``batch_bytes`` and ``hot`` change how the work is dealt
    out, not its result.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), text_or_empty().alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    anchor_parts, parts = max(16, total // ANCHOR_BYTES), max(16, total // PIECE_BYTES)
    batches = _stored(_batches(own, batch_bytes))
    anchors = _anchors(batches, anchor_parts)
    codes = _verdicts(anchors.repartition(min(anchor_parts, PARTITIONS), "part").sortWithinPartitions("part"), hot).groupBy("batch").agg(F.collect_list(F.struct("part", "codes")).alias("codes"))
    pieces = _pieces(batches.join(codes.hint("merge"), "batch", "left").select("batch", "ids", "sizes", "texts", "codes"), anchor_parts, parts)
    dealt = pieces.repartition(min(parts, PARTITIONS), "part", F.when(F.col("part") < 0, F.col("batch"))).sortWithinPartitions("part")
    found = _sorted_pieces(dealt).groupBy("batch").agg(F.collect_list("blob").alias("found"))
    out = _cut_out(batches.join(found.hint("merge"), "batch", "left"))
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(LEAST_ID)))

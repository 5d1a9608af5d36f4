"""Byte-level BPE over length-bucketed numpy matrices.

Pieces of a pattern are encoded once and remembered. Unknown pieces of like length form a
matrix of token ids, padded to the bucket's width; in each round every row looks its adjacent pairs
up in a hash table, merges its leftmost pair of minimum rank, and rows that have none left leave the
matrix. Each row that stays loses exactly one column, so compaction is a masked reshape.

A piece beyond the widest bucket is cut into rows that overlap, which all go through the same rounds. Where
two neighbouring rows found the same token in the same place, the left one's ids end and the right one's go
on. That is exact: each token is what its own bytes merge to, and each two neighbours are what both
together merge to, since they stand so in one row. Merges of one token never alter the order of another's, so
a pair across a border that is never the least among its two tokens is never the least among all.
Rows that share no token are joined to one.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

NONE = np.int32(2**31 - 1)
#: Widths of the buckets are powers of two from the first to the last; a longer piece takes several rows
#: of the last width, which overlap by so many bytes. Rows are 192 bytes apart, so that runs of one, two or
#: three bytes begin alike in all of them.
WIDTHS, OVERLAP = (4, 256), 64
#: Cells of a matrix at a time.
CELLS = 1 << 20
#: Bytes of pieces and ids that a worker remembers; beyond it the memory starts afresh.
REMEMBERED_BYTES = 24 << 20
#: Bytes of a piece beyond which it is not remembered.
REMEMBERED_PIECE = 256
#: Characters of text that are split into pieces at a time, and pieces that are held at a time.
PART_CHARS, PART_PIECES = 1 << 20, 1 << 16
#: Ids that are handed on at a time, and as many again if the last text has them.
PART_IDS = 1 << 18


class PairTable:
    """(left id, right id) -> rank of the joined token; open addressing in two numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]  # of several keys for a slot the last one stays
            won = self.keys[at] == keys[todo]
            self.values[at[won]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        out, slot, todo = np.full(len(keys), NONE, np.int32), self._slot(keys), np.flatnonzero(keys >= 0)
        while len(todo):
            at = slot[todo]
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (there != -1)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(pairs or np.zeros((0, 3)), np.int64).T
        self.pairs = PairTable((left << 32) | right, rank.astype(np.int32))
        self.names = {i: str(i).encode() for i in self.token}
        self.size = np.zeros(max(self.token) + 1, np.int64)
        for t, i in ranks.items():
            self.size[i] = len(t)
        self.known: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: the token itself if the piece is one, else by merging."""
        merged = iter(self._merged([p for p in pieces if p not in self.ranks]))
        return [np.array([self.ranks[p]], np.int32) if p in self.ranks else next(merged) for p in pieces]

    def _merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece by merging alone, pieces of like length in a matrix."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            buckets.setdefault(max(WIDTHS[0], 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            if width > WIDTHS[1]:
                for i in rows:
                    out[i] = self._over_rows(pieces[i])
                continue
            for at in range(0, len(rows), CELLS // width):
                part = rows[at : at + CELLS // width]
                padded = b"".join(pieces[i].ljust(width, b"\0") for i in part)
                matrix = self.byte[np.frombuffer(padded, np.uint8)].reshape(len(part), width)
                matrix[np.arange(width) >= np.array([len(pieces[i]) for i in part])[:, None]] = -1
                self._merge(matrix, np.array(part), out)
        return out

    def _over_rows(self, piece: bytes) -> np.ndarray:
        """Ids of a piece by merging alone, cut into rows that overlap."""
        first = np.arange(0, len(piece) - OVERLAP, WIDTHS[1] - OVERLAP)
        last = np.minimum(first + WIDTHS[1], len(piece))
        ids = self._merged([piece[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        while True:
            row, flat = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate(ids)
            before = np.cumsum(last - first) - last  # bytes of all rows so far beyond those of the piece
            end = np.cumsum(self.size[flat]) - before[row]
            place = (end << 32) | flat
            of_left = (row + 1 < len(ids)) & (end - self.size[flat] >= np.append(first[1:], len(piece))[row])
            of_right = (row > 0) & (end <= np.append(0, last[:-1])[row])
            shared = np.intersect1d(place[of_left], place[of_right], assume_unique=True) >> 32
            border, at = np.unique(np.searchsorted(first, shared) - 2, return_index=True)
            cut = np.full(len(ids) - 1, -1)
            cut[border] = shared[at]
            if (cut >= 0).all():
                return flat[(end > np.append(0, cut)[row]) & (end <= np.append(cut, len(piece))[row])]
            left, right = np.flatnonzero(np.append(True, cut >= 0)), np.flatnonzero(np.append(cut >= 0, True))
            ids = [ids[a] if a == b else self._merge_rows(self.byte[np.frombuffer(piece[first[a] : last[b]], np.uint8)]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
            first, last = first[left], last[right]

    def _merge(self, ids: np.ndarray, row: np.ndarray, out: list) -> None:
        """Rounds over a matrix with a piece in each row. Only the two pairs beside a merge are looked up
        again; the others move with their columns."""
        found = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while True:
            at = found.argmin(axis=1) if found.shape[1] else np.zeros(len(ids), np.intp)  # the leftmost of the least
            rank = found[np.arange(len(ids)), at] if found.shape[1] else np.full(len(ids), NONE)
            done = rank == NONE
            if done.any():
                for i, r in zip(row[done].tolist(), ids[done], strict=True):
                    out[i] = r[r >= 0]
                ids, found, row, at, rank = ids[~done], found[~done], row[~done], at[~done], rank[~done]
            if not len(ids):
                return
            n, width = ids.shape
            each = np.arange(n)
            ids[each, at] = rank
            stay = np.ones((n, width), bool)
            stay[each, at + 1] = False
            ids = ids[stay].reshape(n, width - 1)
            stay = np.ones((n, width - 1), bool)
            stay[each, at] = False
            found = found[stay].reshape(n, width - 2)
            for j in (at - 1, at):
                k = np.flatnonzero((j >= 0) & (j < width - 2))
                found[k, j[k]] = self.pairs.find(ids[k, j[k]], ids[k, j[k] + 1])

    def _merge_rows(self, piece: np.ndarray) -> np.ndarray:
        """The same rounds for bytes whose rows share no token, laid over several rows without overlap: each row
        keeps its own minimum, so a round looks at the rows' minima and at the row that has the least."""
        width = WIDTHS[1]
        n = -(-len(piece) // width)
        ids = np.full((n, width + 1), -1, np.int32)
        flat = np.full(n * width, -1, np.int32)
        flat[: len(piece)] = piece
        ids[:, :width] = flat.reshape(n, width)
        size = np.full(n, width)
        size[-1] = len(piece) - (n - 1) * width
        found = np.full((n, width + 1), NONE, np.int32)
        pairs = np.full(n * width, NONE, np.int32)
        pairs[: len(piece) - 1] = self.pairs.find(piece[:-1], piece[1:])
        found[:, :width] = pairs.reshape(n, width)
        least = found.min(axis=1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # neighbouring rows that still hold cells

        def look_up(r: int, c: int) -> None:
            """Rank of the pair that begins at a cell; its right half may stand in the next row."""
            if c + 1 < size[r]:
                right = ids[r, c + 1]
            elif after[r] < n:
                right = ids[after[r], 0]
            else:
                found[r, c] = NONE
                return
            found[r, c] = self.pairs.find(ids[r, c : c + 1], np.array([right]))[0]

        while True:
            r = int(least.argmin())
            if least[r] == NONE:
                return ids[:, :width][np.arange(width) < size[:, None]]
            c = int(found[r].argmin())
            ids[r, c] = least[r]
            gone, at = (r, c + 1) if c + 1 < size[r] else (int(after[r]), 0)  # the cell that the merge takes in
            ids[gone, at:-1] = ids[gone, at + 1 :]
            found[gone, at:-1] = found[gone, at + 1 :]
            size[gone] -= 1
            if not size[gone]:
                a, b = int(before[gone]), int(after[gone])
                if a >= 0:
                    after[a] = b
                if b < n:
                    before[b] = a
            look_up(r, c)
            left = (r, c - 1) if c else (int(before[r]), int(size[before[r]]) - 1) if before[r] >= 0 else None
            if left:
                look_up(*left)
            for x in {r, gone} | ({left[0]} if left else set()):
                least[x] = found[x].min()

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def _ids(self, parts: list[list[str]]) -> list[bytes]:
        """Ids of lists of pieces as little-endian 32-bit integers; new pieces are encoded together."""
        known = self.known
        new = list(set().union(*parts).difference(known))
        ids = dict(zip(new, [x.astype("<i4").tobytes() for x in self.encode_pieces([p.encode() for p in new])], strict=True))
        look = known.__getitem__ if not new else lambda p: known.get(p) or ids[p]
        out = [b"".join(map(look, ps)) for ps in parts]
        kept = {p: b for p, b in ids.items() if len(p) <= REMEMBERED_PIECE}
        more = sum(map(len, kept)) + sum(map(len, kept.values()))
        if self.held + more > REMEMBERED_BYTES:
            known.clear()
            self.held = 0
        if more <= REMEMBERED_BYTES:
            known.update(kept)
            self.held += more
        return out

    def ids_of(self, texts: list[str]):
        """For each text in turn its ids, as an iterator over parts of them: texts of up to ``PART_CHARS``
        together are split into pieces at once, a longer one ``PART_PIECES`` at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size + len(texts[end]) <= PART_CHARS:
                size += len(texts[end])
                end += 1
            if end > at:
                for raw in self._ids([self.pattern.findall(t) for t in texts[at:end]]):
                    yield iter([raw])
            else:
                yield self._ids_of_long(texts[at])
                end += 1
            at = end

    def _ids_of_long(self, text: str):
        pieces = self.pattern.finditer(text)
        while parts := [m.group() for m in islice(pieces, PART_PIECES)]:
            yield self._ids([parts])[0]

    def encode(self, texts: list[str]):
        """All ids of each text in turn."""
        return (np.frombuffer(b"".join(raw), "<i4") for raw in self.ids_of(texts))

    def digests(self, texts: list[str]):
        """For each text in turn (number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded
        bytes), the latter two taken part by part."""
        names, token = self.names, self.token
        for parts in self.ids_of(texts):
            n, ids, content = 0, hashlib.sha256(), hashlib.sha256()
            for raw in parts:
                part = np.frombuffer(raw, "<i4").tolist()
                if part:
                    ids.update((b" " if n else b"") + b" ".join([names[i] for i in part]))
                    content.update(b"".join([token[i] for i in part]))
                    n += len(part)
            yield n, ids.hexdigest(), content.hexdigest()


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of a rank file, built once in each worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE.from_file(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, tokens, decoded_sha256`` for each row of ``docs``; null counts as empty.

    The digest is that of the bytes which the ids decode to. ``PART_IDS`` ids are handed on at
    a time, or those of one text where it has more.
    """

    def table(doc_ids, ids, shas):
        at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(at).astype(np.int64)), lists, pa.array(shas, pa.string())], names=["doc_id", "n_tokens", "tokens", "decoded_sha256"])

    def each(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            first, size, ids, shas = 0, 0, [], []
            for i, found in enumerate(bpe.encode(batch.column(1).to_pylist())):
                ids.append(found)
                content = hashlib.sha256()
                for at in range(0, len(found), PART_PIECES):
                    content.update(bpe.decode(found[at : at + PART_PIECES].tolist()))
                shas.append(content.hexdigest())
                size += len(found)
                if size >= PART_IDS or i + 1 == batch.num_rows:
                    yield table(batch.column(0)[first : i + 1], ids, shas)
                    first, size, ids, shas = i + 1, 0, [], []

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(each, "doc_id long, n_tokens long, tokens array<int>, decoded_sha256 string")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, content`` (binary) for each row of ``tokens(doc_id, tokens)``."""

    def each(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return tokens.select("doc_id", "tokens").mapInArrow(each, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``.

    Null and empty texts have no ids. Rows that repeat an id are each encoded; an empty table gives
    no rows; columns other than ``doc_id`` and ``text`` are not read.
    """

    def each(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            got = list(bpe.digests(batch.column(1).to_pylist()))
            n, ids, decoded = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

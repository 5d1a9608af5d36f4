"""Quality classifier: subword embeddings averaged per document, softmax output, plain SGD.

A document is the mean of learned vectors: one for each hashed word, for each hashed character
n-gram of its words, and for each hashed pair of neighbouring words. A softmax layer turns the mean
into class probabilities; vectors and layer are trained together by stochastic gradient descent in
numpy. Nothing is non-linear before the softmax, so after training each bucket is reduced to the
one number it adds to the logit, and scoring a document is a mean of numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 8, 8, 0.5
NGRAMS = (2, 3, 4)
#: Labelled documents that the model is fitted on at most; each has ``BUCKETS`` features at most.
SAMPLE_DOCS = 3000
THRESHOLD = 0.3
#: Words that a worker remembers, and their bytes; beyond either the memory starts afresh.
REMEMBERED, REMEMBERED_BYTES = 300_000, 16 << 20
#: Words of texts that are scored at a time, and as many again as the last text has.
GROUP_WORDS = 1 << 17
#: Bytes of words whose n-grams are hashed at a time.
PART_BYTES = 1 << 20
#: A pair of equal neighbours is a feature of its own, whatever the word.
SAME = 1


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _crc_of_grams(packed: np.ndarray, n: int) -> np.ndarray:
    """CRC-32 of the last ``n`` bytes of integers."""
    crc = np.full(len(packed), 0xFFFFFFFF, np.uint32)
    for k in range(n - 1, -1, -1):
        byte = (packed >> np.uint64(8 * k)).astype(np.uint32)
        crc = _CRC[(crc ^ byte) & np.uint32(255)] ^ crc >> np.uint32(8)
    return ~crc


def _gram_buckets(marked: bytes, n: int) -> np.ndarray:
    """Buckets of the different n-grams of a long word: the same CRC-32 as of a short one, over arrays."""
    data, seen = np.frombuffer(marked, np.uint8), np.array([], np.uint32)
    for at in range(0, len(data) - n + 1, PART_BYTES):
        part = data[at : at + PART_BYTES + n - 1].astype(np.uint32)
        packed = np.zeros(len(part) - n + 1, np.uint32)
        for k in range(n):
            packed = packed << np.uint32(8) | part[k : len(part) - n + 1 + k]
        seen = np.union1d(seen, packed)
    return _crc_of_grams(seen.astype(np.uint64), n).astype(np.int64) % BUCKETS


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of each word and of its different n-grams with boundary marks, whatever
    its length."""
    of, buckets, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (end == at or size + len(words[end]) + 2 <= PART_BYTES):
            size += len(words[end]) + 2
            end += 1
        marked = [b"<" + w + b">" for w in words[at:end]]
        # A word of one or two bytes is, with its marks, an n-gram of itself.
        whole = np.array([i for i, w in enumerate(marked, at) if len(w) > max(NGRAMS)], np.int64)
        of.append(whole)
        buckets.append(np.array([zlib.crc32(marked[i - at]) % BUCKETS for i in whole.tolist()], np.int64))
        if size > PART_BYTES:
            for n in NGRAMS:
                buckets.append(_gram_buckets(marked[0], n))
                of.append(np.full(len(buckets[-1]), at))
        else:
            data, sizes = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64), np.array([len(w) for w in marked])
            word = np.repeat(np.arange(at, end, dtype=np.uint64), sizes)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes of the word from here on
            for n in range(1, max(NGRAMS) + 1):
                if n > 1:
                    packed = packed[:-1] << np.uint64(8) | data[n - 1 :]
                else:
                    packed = word << np.uint64(8) | data
                if n in NGRAMS:
                    seen = np.sort(packed[left[: len(packed)] >= n])
                    seen = seen[np.r_[True, seen[1:] != seen[:-1]][: len(seen)]]
                    of.append((seen >> np.uint64(8 * n)).astype(np.int64))
                    buckets.append(_crc_of_grams(seen, n).astype(np.int64) % BUCKETS)
        at = end
    return np.concatenate(of), np.concatenate(buckets)


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from their 32-bit hashes."""
    a, b = hashes[:-1].astype(np.uint64), hashes[1:].astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.where(a == b, SAME, (mixed % np.uint64(BUCKETS)).astype(np.int64))


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their counts) of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.array([0]), np.array([1.0])
    counts = Counter(words)
    of, own = word_features(list(counts))
    pairs = pair_features(np.array([zlib.crc32(w) for w in words]))
    flat = np.concatenate([own, pairs])
    weight = np.concatenate([np.array(list(counts.values()))[of], np.ones(len(pairs))])
    buckets, at = np.unique(flat, return_inverse=True)
    return buckets, np.bincount(at, weight)


@dataclass(frozen=True)
class Model:
    """``logit``: what each bucket adds to the logit of label 1."""

    logit: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Fit on (buckets, counts, label) by SGD with a falling rate; the rarer class
    takes somewhat larger steps. Rows of one class only give a constant model."""
    labels = np.array([r[2] for r in rows], int)
    n = np.bincount(labels, minlength=2)
    if not len(rows) or not n.all():
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(rows) else float(np.sign(n[1] - n[0])) * 3.0)
    rng = np.random.default_rng(0)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    balance = len(rows) / (2 * n)
    balance = np.minimum(balance / balance.min(), 8) ** 0.5
    steps, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            buckets, counts, y = rows[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[buckets]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = np.float32(RATE * balance[y] * (1 - steps / total))
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p * 0.1
            vectors[buckets] -= rate * np.outer(share * len(share) ** 0.5, back)
            steps += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; remembers for each word the sum and number of what its features add, and its hash.

    Texts are scored in groups: their words are looked up at once, and sums over words and over pairs of
    neighbours are taken for all texts of a group together.
    """

    def __init__(self, model: Model):
        self.model, self.known, self.held = model, {}, 0
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        of, buckets = word_features(words)
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.held += sum(map(len, words))
        self.sums = np.r_[self.sums[:n], np.bincount(of, self.model.logit[buckets], len(words))]
        self.counts = np.r_[self.counts[:n], np.bincount(of, minlength=len(words))]
        self.hashes = np.r_[self.hashes[:n], np.array([zlib.crc32(w) for w in words], np.int64)]

    def _group(self, words: list[list[bytes]]) -> np.ndarray:
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        if new := set().union(*words).difference(self.known):
            self._learn(list(new))
        sizes = np.array([len(ws) for ws in words])
        at = np.fromiter(chain.from_iterable(map(self.known.__getitem__, ws) for ws in words), np.intp, sizes.sum())
        of = np.repeat(np.arange(len(words)), sizes)
        total, number = np.bincount(of, self.sums[at], len(words)), np.bincount(of, self.counts[at], len(words))
        if len(at) > 1:
            pairs, same = self.model.logit[pair_features(self.hashes[at])], of[1:] == of[:-1]
            total += np.bincount(of[1:][same], pairs[same], len(words))
            number += np.maximum(sizes - 1, 0)
        mean = np.where(sizes > 0, total / np.maximum(number, 1), self.model.logit[0])
        return 1 / (1 + np.exp(-np.clip(mean + self.model.bias, -50, 50)))

    def scores(self, texts: list[str]) -> np.ndarray:
        out, words, size = [np.zeros(0)], [], 0
        for t in texts:
            words.append(t.encode("utf-8", "surrogatepass").split())
            size += len(words[-1])
            if size >= GROUP_WORDS:
                out.append(self._group(words))
                words, size = [], 0
        if words:
            out.append(self._group(words))
        return np.concatenate(out)

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


def held_out(remainder: int = 0, of: int = 5):
    """True for rows whose labels must not be learned from: crc32(doc_id as text) mod ``of``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == remainder


def training_rows(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``text, label`` of at most ``sample_docs`` labelled documents outside the held-out part.

    The sample is drawn by a hash of the id from all labelled rows, half from each class where both
    have enough, so it doesn't depend on the order of files. Only its ids, a bounded number, are
    broadcast.
    """
    fit = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label")).where("label IN (0, 1)")
    order = [F.xxhash64("doc_id", F.lit("fit")), F.col("doc_id")]
    halves = [fit.where(F.col("label") == y).orderBy(*order).limit(sample_docs // 2) for y in (0, 1)]
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(halves[0].unionAll(halves[1])), "doc_id").select("text", "label")


def learn(rows: DataFrame) -> Model:
    """Model fitted on ``rows(text, label)``, a bounded sample: texts are turned into features where
    they are, and only those are fetched."""

    def each(batches):
        for batch in batches:
            buckets, counts = [], []
            for t in batch.column(0).to_pylist():
                b, c = document_features(t)
                buckets.append(b.astype(np.int32))
                counts.append(c.astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32())), batch.column(1).cast(pa.int32())], names=["b", "c", "label"])

    table = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(each, "b array<int>, c array<float>, label int").toArrow()
    got = [(b.values.to_numpy(), c.values.to_numpy(), y) for b, c, y in zip(table["b"], table["c"], table["label"].to_pylist(), strict=True)]
    got.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))  # rows come in any order
    return train(got)


def quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts have one feature of their own kind and a score like any other. Rows that
    repeat an id are each scored; a null id counts as not held out; an empty table gives no rows, and
    without labels of both classes all scores are alike. Columns other than ``doc_id`` and ``text``
    are not read.
    """
    model = learn(training_rows(docs, labels, sample_docs))

    def each(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(each, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

"""Resample documents toward a target distribution, by importance weights of hashed n-grams.

Texts become counts of n-gram buckets in Arrow kernels: letters are lowered, texts split into words,
the lists flattened and encoded as a dictionary. Runs of words are runs of dictionary indices, told
apart as pairs of a run so far and the next word; only the distinct ones are hashed. A bucket's gain is
the log of its share in the target over its share in the corpus; a document's weight is the mean
gain of its n-grams. Weights plus Gumbel noise, drawn from the document's id, make the score, and
the highest scores are a sample without replacement by importance.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

# Fixed value: what separates words, all of ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAMS, BUCKETS, LEAST_WORDS, PERCENT, SEED, SCALE = 1, 10_000, 20, 10, 2024, 1000
#: Bytes of text that the kernels take at a time; a longer text is taken alone.
STEP_BYTES = 8 << 20


def _steps(texts: pa.Array):
    """Slices of up to ``STEP_BYTES``, a text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        begun = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begun + STEP_BYTES, side="right")))
        yield texts.slice(at, end - at)
        at = end


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and the number of the text that each is from."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    words, text = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(pc.binary_length(words), 0)  # a separator at either end leaves an empty string
    return words.filter(real), text.filter(real).to_numpy()


def features(texts: pa.Array, ngrams: int = NGRAMS, buckets: int = BUCKETS):
    """(words of each text, then for n = 1 to ``ngrams``: the bucket of each run of n words and the
    number of its text), texts without null."""
    words, text = _words(texts)
    encoded = words.dictionary_encode()
    word = encoded.indices.to_numpy().astype(np.int64)
    names = encoded.dictionary
    hashed = lambda names: np.fromiter((zlib.crc32(x.as_buffer()) % buckets for x in names), np.int64, len(names))
    runs, run, of = [], word, names
    for n in range(1, ngrams + 1):
        if n > 1:
            # A longer run is a run of n - 1 words and the word after it, in the same text.
            last = word[n - 1 :]
            whole = text[: len(last)] == text[n - 1 :]
            pairs = run[: len(last)][whole] * len(names) + last[whole]
            kept, at = np.unique(pairs, return_inverse=True)
            of = pc.binary_join_element_wise(of.take(pa.array(kept // len(names))), names.take(pa.array(kept % len(names))), " ") if len(kept) else of.slice(0, 0)
            run = np.full(len(last), -1, np.int64)
            run[whole] = at
            runs.append((hashed(of)[at], text[: len(last)][whole]))
        else:
            runs.append((hashed(of)[run], text))
    return np.bincount(text, minlength=len(texts)), runs


def bucket_counts(docs: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """N-grams in each bucket over all rows of ``docs(text)``. A task hands on one row for each bucket
    at most, and the driver gets as many."""

    def each(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _steps(batch.column(0)):
                for found, _ in features(texts, ngrams, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = docs.select(text_or_empty().alias("text")).mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of a bucket's share in the target over that in the corpus, counts raised by one."""
    n, of_corpus, of_target = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(of_corpus + n)) / (float(s + 1) * float(of_target + n))
    return np.array([math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, ngrams: int = NGRAMS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for each row: the floored mean gain of its n-grams, none: 0."""

    def each(batches):
        for batch in batches:
            done = 0
            for texts in _steps(batch.column(1)):
                n_words, runs = features(texts, ngrams, len(gain))
                n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for found, text in runs:
                    # Texts stand in order: each one's gains are a segment.
                    begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, np.int64)
                    n += np.bincount(text, minlength=len(texts))
                    total[text[begins]] += np.add.reduceat(gain.take(found), begins) if len(begins) else 0
                mean = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), *[pa.array(x, pa.int64()) for x in (n_words, n, mean)]], names=["doc_id", "n_words", "n_features", "weight"])
                done += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def scored(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """``score``: the weight plus Gumbel noise that depends on seed and id only; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighted.withColumn("score", F.col("weight") + F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u))))


def ranked(table: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rank`` 1, 2, 3... of the drawn rows of a stored table: of those with words enough, so many
    percent with the highest scores; equal scores by ``doc_id``, nulls last.

    Scores are whole numbers in a range that the gains bound, so the running count over them is a
    small table; only drawn rows are dealt out by score, and ordered within one.
    """
    fit = table.where(F.col("n_words") >= least_words)
    per_score = fit.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    before = per_score.select(F.col("score").alias("_score"), (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before"))
    drawn = fit.count() * percent // 100
    held = before.where(F.col("before") < drawn)
    cut = held.agg(F.min("_score")).first()[0]
    near = F.lit(False) if cut is None else (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    place = table.where(near).withColumn("_at", F.row_number().over(order)).join(held, F.col("score") == F.col("_score"))
    rank = (F.col("before") + F.col("_at")).cast("long")
    chosen = place.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return chosen.unionAll(table.where(~near).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def importance(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (null: not drawn) for each row of ``docs(doc_id, text)``,
    drawn toward the texts of ``target(text)``.

    Null and empty texts have no words and weight 0. Repeated rows are each scored and drawn; rows
    that repeat an id have the same noise. An empty corpus gives no rows, an empty target equal
    shares; other columns are not read.
    """
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    return ranked(materialise(scored(weights(docs, gain, ngrams), seed), "scores"), least_words, percent)


def resample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose id is drawn (see ``importance``), with all their columns; a null id is not."""
    drawn = importance(docs, target, **parameters).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"] == F.col("_drawn"), "left_semi")

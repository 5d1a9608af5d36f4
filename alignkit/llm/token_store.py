"""Token ids as Parquet files: list columns that can be read selectively.

A store is a folder of Parquet files that hold, in ascending ``doc_id`` order within and across
files, ``doc_id``, ``n_tokens`` and the list column ``tokens``. Spark's own writer makes them, so any
file system that Spark reads will do and lost tasks are written again. Ids and lengths are delta
encoded (writer version 2 without dictionary), row groups and pages are small, and pages carry
column indexes: a reader of a range of documents decodes few pages, and a reader of metadata never
touches the token column.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty

END_ID = 2
#: Words that a worker remembers, in each of two generations.
REMEMBERED = 250_000
#: Bytes of a row group and rows of a page.
ROW_GROUP_BYTES, PAGE_ROWS = 8 << 20, 2000

#: Bytes of text encoded at a time.
TEXT_BYTES = 8 << 20


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves,
    the others take the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


# The parts of a tokenizer file under which words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Encodes words with the tokenizer and remembers them.

    The tokenizer's pattern never matches across a blank, so a text's ids are those of its words in
    turn. What follows holds for tokenizers whose normaliser and pattern are ``NORMALIZER`` and
    ``PRE_TOKENIZER``; with any other file every text goes through the whole tokenizer. A word of Latin letters alone is one match of the pattern: it goes straight to the
    tokenizer's model, lowered and spelt in byte letters as the tokenizer would. A comma or full stop
    after such a word is a match of its own. Everything else goes through the whole tokenizer.
    Frequent words outlive the younger generation of the memory, rare ones are forgotten.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        plain = (parts["normalizer"], parts["pre_tokenizer"], parts["post_processor"]) == (NORMALIZER, PRE_TOKENIZER, None)
        self.by_words = plain and all(a["special"] and "<" in a["content"] for a in parts["added_tokens"])
        self.model, self.letters, self.remembered = self.tokenizer.model, _byte_letters(), remembered
        self.raw = [i.to_bytes(4, "little") for i in range(max(parts["model"]["vocab"].values()) + 1)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stops = {c: self._whole([c])[0] for c in ",."}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters_only(self, word: str) -> bytes:
        word = word.lower()
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(word)])

    def _learn(self, words) -> None:
        known, older, hard = self.known, self.older, []
        for w in words:
            if older and (ids := older.get(w)) is not None:
                known[w] = ids
                continue
            stem, stop = (w[:-1], w[-1]) if len(w) > 1 and w[-1] in ",." else (w, "")
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                plain = stem.lower()
                if plain == w:
                    known[w] = self._letters_only(w)
                    continue
                ids = known.get(plain)
                if ids is None:
                    ids = older.get(plain)
                    known[plain] = ids = self._letters_only(plain) if ids is None else ids
                known[w] = ids + self.stops[stop] if stop else ids
            else:
                hard.append(w)
        for i in range(0, len(hard), 4096):
            known.update(zip(hard[i : i + 4096], self._whole(hard[i : i + 4096]), strict=True))

    def _remember(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        self._learn([w for w in words if w not in self.known])
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, begins = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, as ``tokenizers`` gives them, and the place where each text begins
        (one more place than texts)."""
        if not self.by_words:
            return _joined(self._whole(texts.to_pylist()))
        # Other blanks than ASCII's stay inside a word, which the whole tokenizer then encodes.
        parts = pc.ascii_split_whitespace(texts)
        words = pc.dictionary_encode(parts.values)
        ids, begins = _gathered(*self._word_ids(words.dictionary), words.indices.to_numpy())
        return ids, begins[parts.offsets.to_numpy()]

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Different words in; what differs only in ASCII case or in a comma or full stop after ASCII
        letters is looked up once."""
        plain = pc.match_substring_regex(words, "^[A-Za-z]+[,.]?$")
        stems = pc.dictionary_encode(pc.if_else(plain, pc.ascii_rtrim(pc.ascii_lower(words), characters=",."), words))
        ids, begins = _gathered(*_joined(self._remember(stems.dictionary.to_pylist())), stems.indices.to_numpy())
        for stop, stop_ids in self.stops.items():
            ends = np.flatnonzero(pc.and_(plain, pc.ends_with(words, stop)).to_numpy(zero_copy_only=False))
            added = np.frombuffer(stop_ids, "<i4")
            ids = np.insert(ids, np.repeat(begins[ends + 1], len(added)), np.tile(added, len(ends)))
            more = np.zeros_like(begins)
            more[ends + 1] = len(added)
            begins = begins + np.cumsum(more)
        return ids, begins


def _gathered(flat: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of the lists that begin in ``flat`` at ``begins``, in that form again."""
    sizes = np.diff(begins)[which]
    places = np.r_[0, np.cumsum(sizes)]
    return flat[np.arange(places[-1]) + np.repeat(begins[which] - places[:-1], sizes)], places


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<i4"), np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Encode with the tokenizer of a file, which a worker process loads once."""
    return _encoder(path).encode(texts)


def _parts(batch: pa.RecordBatch, column: int, most: int):
    """Slices of a batch with ``most`` bytes of text or, where one text is longer, that text alone."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, n_tokens, tokens`` of each whole text, with the end id; null counts as empty."""

    def each(batches):
        for batch in batches:
            for part in _parts(batch, 1, TEXT_BYTES):
                ids, begins = _encoder(path).encode_array(part.column(1))
                ids, begins = np.insert(ids, begins[1:], end_id), begins + np.arange(len(begins))
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(begins), pa.int64()), lists], names=["doc_id", "n_tokens", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(each, "doc_id long, n_tokens long, tokens array<int>")


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Encode ``docs`` and write ``doc_id, n_tokens, tokens`` to ``folder`` in ascending ``doc_id`` order
    (null first).

    Documents are dealt out by ranges of ids as texts, before they are encoded: the pass that finds
    the ranges then encodes nothing.
    """
    dealt = docs.select("doc_id", "text").repartitionByRange(*([files] if files else []), F.col("doc_id")).sortWithinPartitions("doc_id", F.length("text"))
    (
        tokenise(dealt, path, end_id)
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("compression", "zstd")
        .parquet(folder)
    )


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, n_tokens, start`` without reading a token.

    ``start`` counts the ids of all documents before: a running sum inside each file, plus the total
    of the files before it. The table of files is small; no document passes through one task.
    """
    rows = spark.read.parquet(folder).select("doc_id", "n_tokens", *_place())
    return _with_starts(rows, rows).select("doc_id", "n_tokens", "start")


def _place() -> list[Column]:
    """Where a stored row stands: the number that Spark's writer gave its file (as a number: beyond five
    digits the names do not sort), and its place in there."""
    return [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("place")]


def _with_starts(told: DataFrame, rows: DataFrame) -> DataFrame:
    """``told`` with ``start``; ``rows`` are the store's, from which the files' totals are taken."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    order = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return told.join(before, "file").withColumn("start", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens"))


def read_tokens(spark: SparkSession, folder: str, where: Column | str | None = None) -> DataFrame:
    """``doc_id, n_tokens, tokens``; a condition on ``doc_id`` or ``n_tokens`` reaches the pages."""
    rows = spark.read.parquet(folder).select("doc_id", "n_tokens", "tokens")
    return rows if where is None else rows.where(where)


def checksums(tokens: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``ids_crc32`` of each list as little-endian unsigned 32-bit integers."""
    schema = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)

    def each(batches):
        for batch in batches:
            lists = batch.column(len(keep))
            at, flat = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8)
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    return tokens.select(*keep, "tokens").mapInArrow(each, f"{schema}, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write ``docs``, then report from the files: ``doc_id, start, n_tokens, ids_crc32``.

    Null and empty texts hold the end id alone. Rows that repeat an id are stored each, one after
    the other; a null id sorts first. An empty table gives an empty store and no rows. Columns other
    than ``doc_id`` and ``text`` are not read.
    """
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "tokens")
    write_store(docs, path, folder, end_id)
    stored = spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(folder).select("doc_id", "n_tokens", "tokens", *_place())
    told = checksums(stored, ("doc_id", "n_tokens", "file", "place"))
    return _with_starts(told, stored).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Importance resampling: buckets, gains and ranks against a plain model, for words and longer runs."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest

from alignkit.llm import target_sample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def model(docs, target, ngrams, buckets, least, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]
    of = {i: (len(words(t)), runs(words(t))) for i, (_, t) in enumerate(docs)}
    s, t = [0] * buckets, [0] * buckets
    for counts, every in ((s, [r for _, r in of.values()]), (t, [runs(words(x)) for x in target])):
        for found in every:
            for b in found:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for i, (doc_id, _) in enumerate(docs):
        n, found = of[i]
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    drawn = fit[: percent * len(fit) // 100]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in fit[len(drawn) :] + [r for r in rows if r[4] < least]], key=str)


ODD = [(1, None), (2, ""), (3, "One TWO one, two! É é 9x"), (3, "One TWO one, two! É é 9x"), (4, "..."), (5, "w " * 70000), (None, "one two three four"), (6, "中文 字 one"), (7, "\x00\x7f a\x01b \t"), (8, "one two one two one two")] + [(i, f"one w{i % 7} x{i % 5} two") for i in range(10, 60)]
TARGET = ["one two", "One two three", None, "", "é"]


@pytest.mark.parametrize("ngrams", [1, 3])
def test_importance_matches_the_model(spark, ngrams):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS score", "'r' AS rank", "2 AS weight")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string").selectExpr("*", "3 AS n")
    got = target_sample.importance(docs, target, ngrams=ngrams, buckets=97, least_words=3, percent=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == model(ODD, TARGET, ngrams, 97, 3, 40)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame(ODD[:4], "doc_id long, text string"), spark.createDataFrame([("one",)], "text string")
    assert target_sample.importance(docs.limit(0), target).count() == 0
    rows = target_sample.importance(docs, target.limit(0), least_words=1, percent=100).collect()
    assert sorted(r.rank for r in rows if r.rank) == [1, 2] and all(r.weight <= 0 for r in rows)


def test_resample_keeps_whole_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "doc_id AS _drawn_by")
    target = spark.createDataFrame([("one two",)], "text string")
    kept = target_sample.resample(docs, target, least_words=3, percent=50)
    want = {r.doc_id for r in target_sample.importance(docs, target, least_words=3, percent=50).collect() if r.rank}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want - {None}


def test_documents_like_the_target_are_drawn_more(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat(IF(id % 10 = 0, 'quark lepton boson ', 'apple pear plum '), 8) AS text")
    target = spark.createDataFrame([("quark lepton boson neutrino",)], "text string")
    drawn = [r.doc_id for r in target_sample.importance(docs, target).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 200 and sum(i % 10 == 0 for i in drawn) > 100  # a tenth of all rows


def test_steps_cover_all_texts(monkeypatch):
    monkeypatch.setattr(target_sample, "STEP_BYTES", 10)
    texts = pa.array(["", "a" * 25, "bb", "cc", "", "d" * 9, "e"])
    assert [x for part in target_sample._steps(texts) for x in part.to_pylist()] == texts.to_pylist()

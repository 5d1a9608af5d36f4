import hashlib
import random

import numpy as np
import pytest

from alignkit.llm import suffix_dedup


def brute(rows, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), ids being different."""
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        edges = np.diff(np.r_[0, gone.astype(int)]) == 1
        out[i] = len(b), int(gone.sum()), int(edges.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
    return out


@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in [*range(1, 40), 200, 1000]:
        s = rng.integers(1, alphabet + 1, n)
        if n >= 200:
            s = np.tile(s[: n // 4], 4)
        got = suffix_dedup.suffix_array(s).tolist()
        assert sorted(got) == list(range(n))
        key = [tuple(s[i : i + 50]) for i in got]
        assert key == sorted(key)


def test_long_texts_come_in_parts(monkeypatch):
    import zstandard

    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 128)
    texts = [b"", b"a" * 49, b"b" * 100, "".join(random.Random(1).choices("xyz", k=1000)).encode(), b"c" * 300]
    sizes = np.array([len(t) for t in texts], "<i8")
    batch = suffix_dedup._Batch(np.arange(5, dtype="<i8").tobytes(), sizes.tobytes(), zstandard.ZstdCompressor().compress(b"".join(texts)))
    seen = [(d, at + s) for docs, offsets, parts in batch._groups() for d, at, n in zip(docs, offsets, parts) for s in range(n - 49)]
    assert sorted(seen) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 49)]
    key, _, doc, start, windows = batch.occurrences()
    assert sorted((d, s + k) for d, s, w in zip(doc.tolist(), start.tolist(), windows.tolist()) for k in range(w)) == sorted(seen)


def test_equal_windows_have_equal_anchors_in_any_text():
    rng = random.Random(2)
    passage = "".join(rng.choices("abcd ", k=400))
    one = suffix_dedup.occurrences(np.frombuffer(passage.encode(), np.uint8), np.array([400]))
    other = ("x" * 37 + passage + "".join(rng.choices("abcd ", k=90000))).encode()
    two = suffix_dedup.occurrences(np.frombuffer(other, np.uint8), np.array([len(other)]))
    by_window = lambda o, shift: {s + k - shift: a for a, s, w in zip(o[0].tolist(), o[3].tolist(), o[4].tolist()) for k in range(w)}
    mine, theirs = by_window(one, 0), by_window(two, 37)
    assert all(theirs[i] == a for i, a in mine.items()) and len(mine) == 351


@pytest.mark.parametrize(("batch_bytes", "hot"), [(1000, 4096), (1 << 23, 4096), (3000, 3), (1, 0)])
def test_random_texts(spark, batch_bytes, hot):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))) for _ in range(20)]
    texts = []
    for _ in range(150):
        parts = [rng.choice(passages)[rng.randrange(10) :] if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3][5:], "x" + texts[7] + "y", "a" * 400, "a" * 60, "ab" * 200, "a" * 49, texts[9][:50], texts[9][:49]]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, "w " * 30000), (2003, "w " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs.selectExpr("*", "1 AS n_bytes", "'a' AS texts", "2 AS batch"), batch_bytes, hot).collect()}
    assert got == brute(rows)
    assert any(v[1] for v in got.values())


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    twice = docs.unionAll(docs)
    again = suffix_dedup.remove_repeats(twice).collect()
    assert len(again) == 2 * len(rows) and {r.doc_id: tuple(r)[1:5] for r in again} == got


def test_a_frequent_anchor_is_not_one_task(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    tried = [letters(16) for _ in range(5000)]
    hashes = suffix_dedup.occurrences(np.frombuffer("".join(tried).encode(), np.uint8), np.full(len(tried), 16), 16, 16)[0]
    frequent = tried[int(np.argmin(hashes))]
    endings = [letters(40) for _ in range(40)]
    rows = [(i * 31 % 20011, letters(60) + frequent + (rng.choice(endings) if i % 3 == 0 else "") + letters(60)) for i in range(14000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    verdicts = suffix_dedup._verdicts(suffix_dedup._anchors(suffix_dedup._batches(docs, 1 << 20), 16).repartition("part").sortWithinPartitions("part"), 4096).collect()
    halves = [r.codes[len(r.codes) // 2 :] for r in verdicts]
    assert 0 < sum(b.bit_count() for h in halves for b in h) <= 2 * len({r.batch for r in verdicts})
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute(rows)


def test_no_table_is_left_in_the_catalog(spark, sf, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PARTITIONS", 3)  # many parts a partition give the same
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    few = suffix_dedup.remove_repeats(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
    monkeypatch.undo()
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()), key=str)

import hashlib
import random
import time

import public_tokenizers as P
import pytest
import tiktoken

from alignkit.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.coder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs(bpe):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_random_texts(bpe, theirs):
    rng = random.Random(0)
    words = ["the", " The", "ing", "zz", "é", "漢字", "🙂", "  ", "\n\n", "1234567", "'s", "%%%", "aaaa", "́", "\x00", "q"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", " ", "a" * 3000, "ab" * 1500, "=" * 5000, "x" + "é" * 900, "".join(chr(rng.randrange(97, 123)) for _ in range(4000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(500))]
    for t, ids, digests in zip(texts, bpe.encode(texts), bpe.digests(texts), strict=True):
        want = theirs.encode_ordinary(t)
        got = ids.tolist()
        assert got == want and bpe.decode(got) == t.encode()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert digests == (len(want), sha(" ".join(map(str, want)).encode()), sha(t.encode()))


def test_long_pieces_take_the_same_rounds(bpe, theirs):
    rng = random.Random(1)
    for n in (511, 512, 513, 1024, 1025, 5000, 20000):
        for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz"):
            t = "".join(rng.choice(letters) for _ in range(n))
            assert next(bpe.encode([t])).tolist() == theirs.encode_ordinary(t)


@pytest.mark.parametrize("unit", ["a", "=", "abc", "abcde", "xyxyx", "letters", "漢字", "\n", "-*-"])
def test_long_runs_of_one_unit(bpe, theirs, unit):
    for n in (257, 449, 5000):
        assert next(bpe.encode([unit * n])).tolist() == theirs.encode_ordinary(unit * n)


def test_a_long_piece_does_not_take_a_round_a_byte(bpe, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "_merge_rows", None)  # all rows of such a piece share a token with the next
    rng = random.Random(5)
    t = "".join(chr(rng.randrange(97, 123)) for _ in range(400_000))
    began = time.perf_counter()
    got = next(bpe.encode([t])).tolist()
    assert time.perf_counter() - began < 5  # a tenth of it on an idle core
    assert got == theirs.encode_ordinary(t)


def test_rows_join_exactly_for_any_ranks(monkeypatch):
    """Small rows, few letters and ranks in no order of length: rows that share a token, that share none and
    are joined, and tokens wider than the overlap."""
    monkeypatch.setattr(byte_bpe, "WIDTHS", (4, 16))
    monkeypatch.setattr(byte_bpe, "OVERLAP", 8)
    rng, joined = random.Random(7), []
    for _ in range(150):
        letters = "ab" if rng.random() < 0.6 else "abc"
        words = {"".join(rng.choice(letters) for _ in range(rng.choice((2, 2, 3, 3, 4, 5, 6, 8, 12)))) for _ in range(rng.randrange(3, 30))}
        words = [w.encode() for w in sorted(words | {letters[:1] * 2, letters[:1] * 4}) if rng.random() < 0.95]
        rng.shuffle(words)
        coder = byte_bpe.ByteBPE({bytes([i]): i for i in range(256)} | {w: 256 + i for i, w in enumerate(words)}, r"\w+")
        own = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=coder.ranks, special_tokens={})
        was = coder._merge_rows
        monkeypatch.setattr(coder, "_merge_rows", lambda x, was=was: joined.append(len(x)) or was(x))
        for n in (16, 17, 25, 64, 65, 300):
            unit = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
            for t in ("".join(rng.choice(letters) for _ in range(n)), unit * n, "".join(rng.choice(letters) for _ in range(n)) + unit * n):
                assert next(coder.encode([t])).tolist() == own.encode_ordinary(t)
    assert len(joined) > 50


def test_memory_is_bounded_in_bytes(bpe, theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", 2000)
    monkeypatch.setattr(byte_bpe, "PART_PIECES", 64)
    monkeypatch.setattr(byte_bpe, "PART_CHARS", 1000)
    rng = random.Random(2)
    for _ in range(20):
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(300))
        assert next(bpe.encode([t])).tolist() == theirs.encode_ordinary(t)
        assert bpe.held <= 2000


def test_table_and_odd_rows(spark, sf, theirs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "w " * 40000), (9003, "w " * 40000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = byte_bpe.round_trip(both.selectExpr("*", "1 AS n_tokens", "2 AS ids_sha256"), PATH, P.PATTERN).collect()
    assert len(got) == both.count()
    for r in got:
        want = theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.round_trip(both.limit(0), PATH, P.PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(both, PATH, P.PATTERN), PATH, P.PATTERN)
    assert all(bytes(r.content).decode() == texts[r.doc_id] for r in back.collect())

"""Toxicity lexicon and quality classifier: held-out accuracy, brute force and odd rows."""

import random
import zlib

import numpy as np
import pytest

from alignkit.llm import quality_model, toxicity

ODD = [(9001, None), (9002, ""), (9003, "w " * 30000), (9003, "w " * 30000), (None, "x")]


def brute_density(lexicon, text):
    plain = toxicity.fold(text)
    folded = [" ".join(toxicity.fold(p).split()) for p in lexicon.exceptions]
    shields = [(i, i + len(p)) for p in folded for i in range(len(plain)) if plain.startswith(p, i)]
    total = 0.0
    for term, weight in lexicon.terms.items():
        for i in range(len(plain)):
            if plain.startswith(term, i) and not any(a - 1 <= i and i + len(term) <= b + 1 for a, b in shields):
                total += weight
    return total / (len(plain.split()) + toxicity.LENGTH_PRIOR) if text else 0.0


def test_density_matches_brute_force():
    lexicon = toxicity.Lexicon({" idio": 3.0, " scum ": 2.0, " tras": 1.5})
    rng = random.Random(0)
    words = ["idiot", "1d10t", "іdiоt", "IDIOTS", "scum", "pond scum", "scummy", "trash can", "trash", "$cum", "hello", "can", ",", "\n"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(15)))
        assert lexicon.density(text) == pytest.approx(brute_density(lexicon, text))


def test_folding_finds_disguised_terms_and_spares_exceptions():
    lexicon = toxicity.Lexicon({" idiot": 3.0, " scum": 2.0})
    for text in ("you 1d10t", "you ІDІОТ", "an id​iot"):
        assert lexicon.density(text) > 0, text
    assert lexicon.density("pond scum grows") == 0
    assert lexicon.density("you scum") > 0
    assert lexicon.density("misidiotic") == 0
    assert lexicon.density("you scum " + "word " * 500) < lexicon.density("you scum")


def test_folding_knows_all_separators_and_forms():
    lexicon = toxicity.Lexicon({" idiot ": 3.0})
    for text in ("you “idiot”", "you—idiot—there", "you\xa0idiot\u2003x", "you…idiot…", "ｉｄｉｏｔ", "ïdíôt", "i\u0301diot", "you «idiot»", "idi\u2060ot", "١idiot٢"):
        assert lexicon.density(text) > 0, text
    for text in ("misidiot", "идиidiot", "idiot语"):
        assert lexicon.density(text) == 0, text


def made_up(spark, n=600):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeioustnr") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))]
        bad, junk = i % 5 == 0, i % 4 == 1
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zgrub", "zgrubben", "zgrubx", "Plomfer", "pl0mfer"]))
        if junk:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = made_up(spark)
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    got = toxicity.toxicity(docs.unionByName(odd).selectExpr("*", "1 AS score", "2 AS cell"), labels).collect()
    assert len(got) == docs.count() + len(ODD)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3) == truth.get(r.doc_id, 0)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in truth.items() if not t}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_toxic_terms_of_the_tail_are_learned(spark):
    rows = [(f"the plain talk number {'abcdefgh'[i % 8] * 4} zcommon{i % 2} stays", 1) for i in range(1200)]
    rows = [(f"{t} {''.join('qwertyuiop'[int(d)] for d in str(i))}", y) for i, (t, y) in enumerate(rows)]
    rows += [(f"the plain talk number {'abcdefgh'[i % 8] * 4} you vlarf{'xyz'[i % 3]}", 1) for i in range(6)]
    rows += [(f"the plain talk number {'abcdefgh'[i % 8] * 4} stays", 0) for i in range(1200)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert lexicon.density("you vlarfy") > 0
    assert lexicon.density("a zcommon") > 0
    assert lexicon.density("the plain talk number stays") == 0


def test_words_of_exception_phrases_and_ambiguous_terms_are_learned(spark):
    number = lambda i: "".join("qwertyuiop"[int(d)] for d in str(i))
    rows = [(f"plain talk {number(i)} you {'scum' if i % 2 else 'mildun'} stays", 1) for i in range(200)]
    rows += [(f"plain talk {number(i)} {'pond scum grows' if i % 20 == 0 else 'grows'} {'mildun' if i % 25 == 1 else ''} stays", 0) for i in range(1000)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert lexicon.density("you scum") > 0 and lexicon.density("pond scum grows") == 0
    assert 0 < lexicon.density("you mildun") < lexicon.density("you scum")
    assert lexicon.density("plain talk grows and stays") == 0
    plain = toxicity.fold("class clown fish, pond scummy trash")
    assert toxicity._features(plain) == {" scummy", " scummy ", " tras", " trash", " trash "}


def test_quality_on_held_out_rows(spark):
    docs, labels = made_up(spark)
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    got = quality_model.quality(docs.unionByName(odd).selectExpr("*", "1 AS score", "2 AS label"), labels).collect()
    assert len(got) == docs.count() + len(ODD)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    wrong = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        wrong += r.held_out and r.doc_id in truth and r.predicted != truth[r.doc_id]
    assert wrong <= 2
    assert quality_model.quality(docs.limit(0), labels).count() == 0
    assert len({r.score for r in quality_model.quality(docs, labels.limit(0)).collect()}) == 1


def brute_features(text):
    """Feature buckets of a text, one by one: words, their different n-grams, pairs of neighbours."""
    words, out = text.encode().split(), []
    for w in words:
        marked = b"<" + w + b">"
        grams = {marked} | {marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)}
        out += [zlib.crc32(g) % 65536 for g in grams]
    for a, b in zip(words, words[1:]):
        mixed = (zlib.crc32(a) * 0x9E3779B97F4A7C15 + zlib.crc32(b) * 0xC2B2AE3D27D4EB4F) % 2**64 >> 40
        out.append(1 if a == b else mixed % 65536)
    return out or [0]


@pytest.mark.parametrize("part_bytes", [8, 1 << 20])
def test_scores_by_brute_force(monkeypatch, part_bytes):
    monkeypatch.setattr(quality_model, "PART_BYTES", part_bytes)
    monkeypatch.setattr(quality_model, "GROUP_WORDS", 50)
    monkeypatch.setattr(quality_model, "REMEMBERED", 40)
    rng = np.random.default_rng(1)
    logit = rng.normal(size=65536).astype(np.float32)
    texts = ["", " ", "a", "ab", "abc", "a a a", "<a >b", "é ß 漢字", "x" * 300, "aaaa aaaa bbbb"] + [" ".join("w" * int(rng.integers(1, 9)) + str(rng.integers(0, 40)) for _ in range(rng.integers(0, 40))) for _ in range(60)]
    got = quality_model.Scorer(quality_model.Model(logit, -0.2)).scores(texts)
    for t, score in zip(texts, got, strict=True):
        z = np.mean([float(logit[b]) for b in brute_features(t)]) - 0.2
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)
        buckets, counts = quality_model.document_features(t)
        assert sorted(np.repeat(buckets, counts.astype(int)).tolist()) == sorted(brute_features(t))


def test_training_tells_features_apart_and_repeats():
    rows = [(np.array([3, 9]), np.array([2.0, 1.0]), 1), (np.array([5, 9]), np.array([1.0, 1.0]), 0)]
    model = quality_model.train(rows * 40)
    z = [float((model.logit[b] * c).sum() / c.sum() + model.bias) for b, c, _ in rows]
    assert z[0] > 0.5 and z[1] < -0.5 and abs(model.logit[9]) < max(model.logit[3], -model.logit[5])
    assert quality_model.train(rows * 40).logit.tolist() == model.logit.tolist()


def test_score_is_the_mean_over_all_features():
    rng = np.random.default_rng(0)
    model = quality_model.Model(rng.normal(size=quality_model.BUCKETS).astype(np.float32), 0.3)
    scorer = quality_model.Scorer(model)
    for text in ("", "one", "one two two one", "é ü ß, x" * 30, "y" * 5000):
        buckets, counts = quality_model.document_features(text)
        z = (model.logit[buckets] * counts).sum() / counts.sum() + model.bias
        assert scorer.score(text) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def test_words_without_blanks_are_read_whole():
    rng = np.random.default_rng(3)
    word = bytes(rng.integers(33, 127, 3000, dtype=np.uint8))
    marked = b"<" + word + b">"
    want = {marked} | {marked[i : i + n] for n in quality_model.NGRAMS for i in range(len(marked) - n + 1)}
    assert sorted(quality_model.word_features([word])[1]) == sorted(zlib.crc32(g) % quality_model.BUCKETS for g in want)
    model = quality_model.Model(rng.normal(size=quality_model.BUCKETS).astype(np.float32), 0.3)
    scorer = quality_model.Scorer(model)
    assert scorer.score("文" * 40 + "好的文章" * 50) != scorer.score("文" * 40 + "坏" * 200)
    assert all(len(w) <= quality_model.REMEMBERED_BYTES for w in scorer.known)

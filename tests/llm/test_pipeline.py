"""The pipeline against plain Python on a small table."""

import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from alignkit.llm import byte_bpe, mixing, simhash, toxicity


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "simhash near-dedup", "source mix", "byte-level bpe"]
    out, steps = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, sf).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        steps.append(out.collect())
        if i < 4:
            assert out.columns == docs.columns
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    fine = {r.doc_id for r in scored.where("predicted = 0").collect()}
    assert {r.doc_id for r in steps[0]} == fine
    last = {}
    for r in steps[0]:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in steps[1]) == sorted(last.values())
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in steps[1]}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in steps[2]) == sorted(i for i in fps if find(i) == i)
    taken = {r.row.doc_id: r.copies for r in mixing.with_copies(spark.read.parquet(str(tmp_path / "2"))).collect()}
    got = {}
    for r in steps[3]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in taken.items() if n}
    ranks = byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in steps[3]}
    assert sorted(r.doc_id for r in steps[4]) == sorted(r.doc_id for r in steps[3])
    for r in steps[4]:
        assert r.tokens == theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(r.tokens) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_and_empty_tables_pass_through(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, None), (3, "a b c", "en", "s", 5, 2), (3, "a b c", "en", "s", 5, 2), (4, "w " * 20000, None, "t", 1, 3)]
    for n, table in enumerate((rows, [])):
        out = spark.createDataFrame(table, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, out, sf).write.parquet(str(tmp_path / f"{n}-{i}"))
            out = spark.read.parquet(str(tmp_path / f"{n}-{i}"))
            assert i == 4 or out.columns == schema.replace(",", "").split()[::2]
        assert (out.count() > 0) == bool(table)


CLASHES = ("size", "source_size", "target", "copies", "u", "_u", "p", "_null", "_source", "whole", "cut", "cut_rank", "rank", "row", "missing", "Size_", "no_text", "_no_text", "others", "rest", "salt", "_salt", "digest", "content", "at", "fp", "node", "component_id", "fingerprint", "score", "cell", "copy", "a.b")


def test_clashing_columns_pass_through_unchanged(spark, sf, tmp_path):
    fixed = {c: f"'{c}'" for c in CLASHES}
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).selectExpr("*", *[f"{v} AS `{c}`" for c, v in fixed.items()])
    out = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, out, sf).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in CLASHES)
    assert corpus_pipeline.STAGES[-1][1](spark, out, sf).count() == len(rows)

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from alignkit.llm import token_store

PATH = P.path("word_bpe_49k.json")


def test_pieces_encode_like_whole_texts():
    t = Tokenizer.from_file(PATH)
    texts = ["", " ", "It's the CAT'S, I'll... we're.", "Éá,b. ΑΣ Σ, İstanbul, ß.", "a b c\u0085d\x1ce", "x,. y.,", "12,5 %%%, 漢字, 🙂.", "Á. é ́x", "n't,the'd", "word,word.", "ẞ, ŉ. ﬁ,", "ſ'S", "ÀÉÎ. ªº µ, ÿ ß.", "THE, The. the,. ,the", "don't.", "x1, 1x. x²,"]
    for text, got in zip(texts, token_store.encode_texts(texts, PATH), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_memory_forgets_without_harm():
    t = Tokenizer.from_file(PATH)
    encoder = token_store.Encoder(PATH, remembered=5)
    for i in range(60):
        text = f"The word{i % 7} alpha, beta{i % 5}. Über{'x' * (i % 9)}, 12{i}"
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_table_and_odd_rows(spark, sf):
    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "w " * 40000), (9003, "w " * 40000)], "doc_id long, text string")
    both = docs.unionByName(odd)
    rows = sorted((r.doc_id, r.text or "") for r in both.collect())
    want, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_store.token_files(both.selectExpr("*", "1 AS start", "'x' AS tokens"), PATH)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert token_store.token_files(both.limit(0), PATH).count() == 0


def test_other_tokenizers_are_called_for_whole_texts(tmp_path):
    import json

    spec = json.load(open(PATH))
    spec["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    encoder, t = token_store.Encoder(str(other)), Tokenizer.from_file(str(other))
    assert token_store.Encoder(PATH).by_words and not encoder.by_words
    for text in ("The  word,\nit's", "", "É a"):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_files_are_ordered_by_number_and_rows_by_place(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id div 3 AS doc_id", "text")
    folder = tmp_path / "store"
    token_store.write_store(docs, PATH, str(folder), files=3)
    names = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
    for p, number in zip(names, ("99998", "99999", "100000")):
        p.rename(folder / p.name.replace(p.name.split("-")[1], number, 1))
    import pyarrow.parquet as pq

    want, start = [], 0
    for number in ("99998", "99999", "100000"):
        table = pq.read_table(next(folder.glob(f"part-{number}-*")))
        for i, n in zip(table["doc_id"].to_pylist(), table["n_tokens"].to_pylist()):
            want.append((i, n, start))
            start += n
    got = token_store.read_metadata(spark, str(folder)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.start) for r in got) == sorted(want)


def test_selective_reads(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = str(tmp_path / "store")
    token_store.write_store(docs, PATH, folder, files=3)
    plan = token_store.read_metadata(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "n_tokens:bigint" in plan and ",tokens:" not in plan
    some = token_store.read_tokens(spark, folder, "doc_id BETWEEN 10 AND 12")
    assert "GreaterThanOrEqual(doc_id,10)" in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in some.collect()) == [10, 11, 12]
    import pyarrow.parquet as pq

    file = sorted((tmp_path / "store").glob("*.parquet"))[0]
    column = pq.ParquetFile(file).metadata.row_group(0).column(2)
    assert column.path_in_schema.startswith("tokens") and any("DELTA" in e for e in column.encodings)
    assert column.has_column_index and column.has_offset_index


def test_parts_of_a_batch():
    import pyarrow as pa

    t = Tokenizer.from_file(PATH)
    texts = ["", " lead", "trail ", "\u00a0no\u2003break\u3000 it's", "x" * 50, "a\tb\x0bc", "é,. " * 9, "", "\x1cq\x1f r", "end"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 2)), pa.array(["cut", "off", *texts])], names=["doc_id", "text"]).slice(2)
    encoder = token_store.Encoder(PATH)
    for most in (1, 7, 40, 10_000):
        got, seen = [], []
        for part in token_store._parts(batch, 1, most):
            assert part.num_rows == 1 or sum(len(x.encode()) for x in part.column(1).to_pylist()) <= most
            ids, begins = encoder.encode_array(part.column(1))
            got += [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]
            seen += part.column(0).to_pylist()
        assert seen == list(range(2, len(texts) + 2))
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert list(token_store._parts(batch.slice(0, 0), 1, 7)) == []

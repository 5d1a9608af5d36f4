import numpy as np
import pytest
import xxhash

from alignkit.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, limit=4):
    fps = {i: f for i, f in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A b C d", "a b c d e", "é à ü ß œ Ünter", "x " * 5000, "A\x0bb\x0cc d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_index_finds_all_in_limit():
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 300, 3000):
        base = rng.integers(0, 2**63, max(1, n // 10), dtype=np.uint64)
        fps = base[rng.integers(0, len(base), n)]
        for _ in range(3):
            fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        fps = in_gray_order(fps)
        last = min(5, len(fps))
        want = {(q, i) for q in range(last) for i in range(q + 1, len(fps)) if (int(fps[i]) ^ int(fps[q])).bit_count() <= 4}
        assert set(zip(*[x.tolist() for x in simhash.GrayIndex(fps).search(0, last, 4)])) == want


def in_gray_order(fps):
    fps = np.unique(fps)
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return fps[np.argsort(rank)]


def test_nodes_prune_on_documents(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    fps = simhash.fingerprints(spark.read.parquet(path)).select("fp").distinct().toPandas().fp.to_numpy().view(np.uint64)
    fps = in_gray_order(fps)
    index = simhash.GrayIndex(fps)
    assert len(index.levels) >= 5
    pairs = sum(len(index.search(i, min(i + 256, len(fps)), 4)[0]) for i in range(0, len(fps), 256))
    want = sum(int((np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4).sum()) for i in range(len(fps)))
    assert pairs == want > 0
    assert index.compared < 0.1 * len(fps) ** 2 / 2  # nine of ten members go with a node above them
    bits = simhash.key_bits_for(len(fps))
    assert bits == 5 and simhash.key_bits_for(0) == simhash.key_bits_for(511) == 0 and simhash.key_bits_for(10**11) == 12


@pytest.mark.parametrize(("key_bits", "chunk"), [(None, 1 << 20), (0, 40), (3, 20), (12, 1 << 20)])
def test_components_match_brute_force(spark, key_bits, chunk):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        f = int(rng.integers(0, 2**63))
        for _ in range(25):
            for b in rng.integers(0, 64, int(rng.integers(0, 4))):
                f ^= 1 << int(b)
            rows.append(f)
    rows = [(i * 3, int(np.uint64(f).view(np.int64))) for i, f in enumerate(sorted(set(rows), key=hash))]
    classes = spark.createDataFrame(rows, "node long, fp long")
    from alignkit.llm.components import components

    got = {r.node: r.component for r in components(simhash.near_pairs(classes, 4, key_bits, chunk)).collect()}
    want = brute_components([(i, f & (2**64 - 1)) for i, f in rows])
    assert {i: got.get(i, i) for i, _ in rows} == want


def test_query_on_table_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "w " * 30000), (9004, "w " * 30000), (9005, "one two")], "doc_id long, text string")
    both = docs.unionByName(odd)
    want_fp = {r.doc_id: brute_fingerprint(r.text) for r in both.collect()}
    want = brute_components(list(want_fp.items()))
    got = simhash.near_duplicates(both.selectExpr("*", "1 AS fp", "2 AS salt", "3 AS component_id")).collect()
    assert len(got) == both.count()
    for r in got:
        assert r.fingerprint == f"{want_fp[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(both.limit(0)).count() == 0
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert kept == {i for i, c in brute_components([(i, f) for i, f in want_fp.items() if i < 9000]).items() if i == c}

import hashlib
import random
import re

import pytest

from alignkit.llm import secret_scan

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{'assign access hex'.split()[k]}:{a}:{e}" for a, k, e in spans).encode()).hexdigest()


def check(row, text):
    want = brute(text)
    assert row.base_sha256 == digest(want)
    assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))


def test_automaton_agrees_with_expressions():
    rng = random.Random(3)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "secret", '"', "'", " ", "   ", ":", "=", "AKIA", "ABCDEF012345", "0123456789abcdef", "deadbeef", "x", "é", "🙂", "\n", "ghp_", "a" * 40, "eyJab", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ſecret", "toKen"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(800)]
    for t, spans in zip(texts, secret_scan.scanner().spans(texts), strict=True):
        want = []
        for k, r in enumerate(secret_scan.RULES):
            for m in re.finditer(r.find, t, (re.IGNORECASE if r.any_case else 0) | re.ASCII):
                size = m.end() - m.start(2 if r.tail else 0)
                want += [(m.start(), k, m.end())] if size >= r.least else []
        assert spans == sorted(want)
        assert [s for s in spans if s[1] < 3] == brute(t)


def test_main_path_has_no_regular_expressions():
    import ast
    import inspect

    tree = ast.parse(inspect.getsource(secret_scan))
    assert not {n.name for x in ast.walk(tree) if isinstance(x, ast.Import) for n in x.names} & {"re", "regex"}


@pytest.mark.parametrize("lane_bytes", [1, 7, 64, 1 << 20])
def test_lanes_do_not_matter(lane_bytes):
    import numpy as np

    rng = random.Random(lane_bytes)
    text = "".join(rng.choice(["token=", "abcdef0123456789", "AKIA" + "B7" * 8, "\n", ", ", " ", "secret: ", "zz", "'"]) for _ in range(3000)).encode()
    found = secret_scan.scanner().automaton
    whole = secret_scan.scan(found, np.frombuffer(text + b"\xff", np.uint8), 1 << 30)
    parts = secret_scan.scan(found, np.frombuffer(text + b"\xff", np.uint8), lane_bytes)
    assert sorted(zip(*[x.tolist() for x in whole])) == sorted(zip(*[x.tolist() for x in parts]))


def test_automaton_is_minimal_and_rules_are_checked():
    found = secret_scan.scanner().automaton
    rows = found.table.reshape(-1, found.classes)
    pairs = {(tuple(a), tuple(b)) for a, b in zip(rows.tolist(), found.todo.reshape(rows.shape).tolist())}
    assert len(pairs) == len(rows)
    with pytest.raises(ValueError, match="byte by byte"):
        secret_scan.compile_rules((secret_scan.Rule("x", "ab(cde)?", 6),))
    with pytest.raises(ValueError, match="nothing"):
        secret_scan.compile_rules((secret_scan.Rule("x", "a*", 6),))


def test_few_and_long_texts():
    scanner = secret_scan.scanner()
    for texts in ([""], ["x" * 50_000 + " password=abcdefghijkl"], ["y"] * 20 + ["z" * 9000 + "0123456789abcdef"] * 3):
        assert [[s for s in x if s[1] < 3] for x in scanner.spans(texts)] == [brute(t) for t in texts]


def test_table_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "é token = \"0123456789abcdef0123\" ghp_" + "a" * 40), (9003, "w " * 40000)], "doc_id long, text string")
    both = docs.unionByName(odd)
    texts = {}
    for r in both.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    got = secret_scan.find_secrets(both.selectExpr("*", "1 AS n_hex", "'a' AS spans")).collect()
    assert len(got) == both.count()
    for r in got:
        if len(texts[r.doc_id]) == 1:
            check(r, next(iter(texts[r.doc_id])))
    assert any("github:" in r.spans for r in got if r.doc_id == 9003)
    assert secret_scan.find_secrets(both.limit(0)).count() == 0

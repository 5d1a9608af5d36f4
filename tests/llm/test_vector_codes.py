"""Codes of vectors: Orchard's search and whole codings against brute force, SQL, odd rows."""

import numpy as np
import pytest

from alignkit.llm import vector_codes


def brute(rows, parts, entries, rounds):
    """Rows (id, vector, label) of one length, coded by comparing each part with every entry."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    points = [[int(np.floor(256 * x)) for x in v] for _, v, _ in kept]
    step = len(points[0]) // parts
    cut = [[tuple(p[i * step : (i + 1) * step]) for i in range(parts)] for p in points]
    books = [[c[i] for c in cut[:entries]] for i in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(c[i], e), k) for k, e in enumerate(books[i])) for i in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for i in range(parts):
            for k in range(len(books[i])):
                own = [c[i] for c, f in zip(cut, found, strict=True) if f[i][1] == k]
                if own:
                    books[i][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = assign()
    return [(r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(kept, found, strict=True)], books


@pytest.mark.parametrize("length,size", [(1, 7), (3, 40), (4, 64)])
def test_search_finds_the_nearest(length, size):
    rng = np.random.default_rng(length)
    entries = rng.integers(-5, 6, (3, size, length))  # few values: many ties and equal entries
    points, part = rng.integers(-7, 8, (2000, length)), rng.integers(0, 3, 2000)
    got, distance = vector_codes.Orchard(vector_codes.Codebooks(entries)).nearest(points, part)
    every = ((points[:, None, :] - entries[part]) ** 2).sum(axis=2)
    assert (got == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_search_leaves_most_entries_out():
    """Neighbour lists end early: on clustered entries far fewer distances are taken than there are entries."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (1, 64, 2))
    search = vector_codes.Orchard(vector_codes.Codebooks(centres))
    taken, squares = [], search._squares
    search._squares = lambda p, e: taken.append(len(p)) or squares(p, e)
    points = centres[0][rng.integers(0, 64, 1000)] + rng.integers(-5, 6, (1000, 2))
    search.nearest(points, np.zeros(1000, np.int64))
    assert sum(taken) < 64 * 1000 / 3


ODD = [(5, [0.5, -0.25, 0.1, 0.9], 1), (2, None, 1), (3, [0.1, None, 0.2, 0.3], 2), (4, [0.1, float("nan"), 0.2, 0.3], 2), (6, [float("inf"), 0.1, 0.2, 0.3], None), (7, [0.3, 0.3, 0.3, 0.3], None), (7, [0.3, 0.3, 0.3, 0.3], None), (8, [0.0, -0.0, 0.3, -2.5], 3), (None, [0.2, 0.1, 0.0, 0.4], None), (9, [0.4, 0.2, 0.2, -0.1], 1)]


def test_odd_rows_against_brute_force(spark):
    vectors = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "1 AS error", "2 AS slot")
    rows = vector_codes.compress(vectors, parts=2, entries=3, rounds=2).collect()
    want, books = brute(ODD, 2, 3, 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.vec_id, r.code, r.error) for r in rows], key=key) == sorted(want, key=key)
    labels = {r[0]: r[2] for r in ODD}
    for r in rows:
        assert r.label_error == sum(x.error for x in rows if labels[x.vec_id] == labels[r.vec_id])
    assert {r.codebooks_sha256 for r in rows} == {vector_codes.Codebooks(np.array(books)).sha256()}
    assert vector_codes.compress(vectors.limit(0)).count() == 0
    assert vector_codes.compress(vectors.where("embedding IS NULL")).count() == 0


def test_lengths_that_differ(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [], 0), (3, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    rows = vector_codes.compress(vectors, parts=2, entries=64).orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == [1, 2, 3] and [r.error for r in rows] == [0, 0, 0]
    books = vector_codes.train(vectors, parts=2)
    assert books.width == 4 and books.decode(rows[0].code) == [256, 512, 768, 0] and books.decode(rows[2].code) == [256, 0, 0, 0]
    with pytest.raises(Exception, match="too large"):
        vector_codes.train(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"))


def test_a_hot_vector_and_label(spark):
    same = spark.range(3000).selectExpr("id AS vec_id", "IF(id % 3 = 0, array(0.5f, 0.25f), array(CAST(id % 11 AS FLOAT), CAST(id % 7 AS FLOAT))) AS embedding", "CAST(IF(id % 3 = 0, 0, id) AS INT) AS label")
    rows = vector_codes.compress(same, parts=2, entries=8).collect()
    want, _ = brute([(r.vec_id, r.embedding, r.label) for r in same.collect()], 2, 8, 2)
    assert sorted((r.vec_id, r.code, r.error) for r in rows) == sorted(want)

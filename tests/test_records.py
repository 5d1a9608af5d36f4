"""Records with keys of their own: last lines win, per-product key lists, documents compared path by path."""

import json

from pyspark.sql import functions as F

from alignkit.operators import catalog, records
from alignkit.plans import pipeline

LINES = ['{"label": "a", "Ntimes": 1}', "noise", '  {"label": "b", "nested": {"x": [1, {"y": null}], "é": "ü"}, "n": 2.5}', "{bad", '{"no": 1}', '{"label": "a", "Ntimes": 3, "extra": [true]}', '{"label": "c"}']


def lines(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(LINES)], "line string, at int")


def test_records_keep_their_own_keys(spark):
    got = {r.label: (json.loads(r.j), r["keys"]) for r in records.records_of_lines(lines(spark), "line", "at").select("label", F.to_json("record").alias("j"), records.keys_of(F.col("record")).alias("keys")).collect()}
    assert got == {t["label"]: (t, sorted(t)) for t in (json.loads(LINES[i]) for i in (2, 5, 6))}


def test_each_product_has_its_own_keys(spark):
    products = spark.createDataFrame([(1, "a", ["Ntimes", "absent"]), (2, "b", ["nested", "n"]), (3, "a", []), (4, "zz", ["n"]), (5, None, ["n"]), (6, "a", None)], "id int, meta_label string, meta_keys array<string>")
    joined = records.join_records(products, records.records_of_lines(lines(spark), "line", "at"))
    got = {r.id: json.loads(r.j) for r in joined.select("id", F.to_json("sample_metadata").alias("j")).collect()}
    b = json.loads(LINES[2])
    assert got == {1: {"Ntimes": 3}, 2: {"nested": b["nested"], "n": 2.5}, 3: {}, 4: {}, 5: {}, 6: json.loads(LINES[5])}


def leaves(x, path="$"):
    inside = [(f"{path}.{k}", v) for k, v in x.items()] if isinstance(x, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(x)] if isinstance(x, list) else []
    return {path: x} if not inside else {k: v for p, y in inside for k, v in leaves(y, p).items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, t string").select("k", F.parse_json("t").alias("doc"))


def test_walk_equals_recursion(spark):
    docs = [(1, {"a": {"b": [1, [], {}, {"c": None}]}, "d": "x.y"}), (2, [1, [2, [3, [4]]]]), (None, 5), (3, {})]
    got = records.walked(frame(spark, [(k, json.dumps(d)) for k, d in docs]), ["k"], "doc").collect()
    assert sorted(((r.k is None, r.k or 0, r.path, json.loads(r.value)) for r in got), key=str) == sorted(((k is None, k or 0, p, v) for k, d in docs for p, v in leaves(d).items()), key=str)


def test_a_walk_stores_once_for_several_levels(spark, monkeypatch):
    """Documents of four levels are stored once a walk; deeper ones take another round for what is deeper."""
    stored, store = [], records.materialise
    monkeypatch.setattr(records, "materialise", lambda df, name: (stored.append(name), store(df, name))[1])
    flat = [(1, {"n": 2, "lines": [{"line": 1, "qty": 3}, {"line": 2, "qty": None}]}), (2, {"n": 0, "lines": []}), (3, None)]
    deep = [(4, {"a": [[[[{"b": [1, {}, [], {"c": [[2]]}]}, 3]]]]}), (5, [[[{}]], [[[]]], [[["x"]]], [[[["y"]]]]])]
    for docs, rounds in ((flat, 1), (flat + deep, 3)):
        stored.clear()
        got = records.walked(frame(spark, [(k, json.dumps(d)) for k, d in docs]), ["k"], "doc").collect()
        assert len(stored) == rounds
        assert sorted(((r.k, r.path, json.loads(r.value)) for r in got), key=str) == sorted(((k, p, v) for k, d in docs for p, v in leaves(d).items()), key=str)


def test_documents_compared_path_by_path(spark):
    old = [(1, {"title": "t", "products": [{"product_id": "p", "n": 1}, {"product_id": "q", "n": None}]}), (2, {"x": 1})]
    new = [(1, {"title": "t", "products": [{"product_id": "q", "n": 2}, {"product_id": "p", "n": 1}], "more": [1]}), (3, {"x": 1})]
    a, b = (frame(spark, [(k, json.dumps(d)) for k, d in rows]) for rows in (old, new))
    got = sorted(map(tuple, records.diff_documents(a, b, ["k"], "doc", {"$.products": "product_id"}).collect()))
    assert got == [(1, "$.more[0]", "added", None, "1"), (1, "$.products[q].n", "changed", "null", "2"), (2, "$.x", "removed", "1", None), (3, "$.x", "added", None, "1")]
    assert records.diff_documents(a, a, ["k"], "doc").count() == 0
    assert {r.path for r in records.diff_documents(a, b, ["k"], "doc").where("k = 1 AND path LIKE '$.products%'").collect()} == {"$.products[0].n", "$.products[0].product_id", "$.products[1].n", "$.products[1].product_id"}


def test_inventory_has_census_kinds_and_missing(spark):
    listing = spark.createDataFrame([("d", "zen.LST.5.a", 3, "0_0", False), ("d", "zen.LST.6.b", 4, "0_1", True), ("e", "zen.STD.7.c", 5, "1_2", False)], "dir string, name string, length long, identifier string, has_spectrum boolean")
    products = spark.createDataFrame([("p", "d", "m"), ("q", "e", "none")], "product_id string, path string, meta_label string")
    metadata = spark.createDataFrame([("m", 1)], "label string, quality int")
    parts = pipeline.build_inventory(listing, products, metadata, {"title": "t"})
    assert tuple(parts["census"].first()) == (3, 1, 1, 2, 1)
    assert {r.stem: r.n for r in parts["stems"].collect()} == {"LST": 2, "STD": 1}
    assert [r.product_id for r in parts["missing"].collect()] == ["q"]
    document = parts["manifest"].first()
    assert document.n_products == 2 and document.census.n_cross == 2
    assert catalog.file_census(listing, F.col("has_spectrum")).first().n_cross_without_spectrum == 1

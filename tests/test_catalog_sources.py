import json

from pyspark.sql import functions as F

from alignkit.operators import catalog
from alignkit.sources import tables, writers


def test_last_record_wins(spark, tmp_path):
    lines = ["noise", '  {"label": "a", "Ntimes": 1}', '{"label": "b", "Ntimes": 2}', '{"label": "a", "Ntimes": 3}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = {r.label: r.Ntimes for r in tables.read_metadata_jsonl(spark, str(tmp_path / "m.jsonl")).collect()}
    assert got == {"a": 3, "b": 2}


def test_census_and_histogram(spark):
    listing = spark.createDataFrame([("0_0", False), ("0_1", True), ("0_2", False)], "identifier string, s boolean")
    row = catalog.file_census(listing, F.col("s")).first()
    assert (row.n_files, row.n_spectra, row.n_autos, row.n_cross, row.n_cross_without_spectrum) == (3, 1, 1, 2, 1)
    names = spark.createDataFrame([("x/zen.LST.5.40.uvh5",), ("x/zen.STD.5.40.uvh5",), ("x/zen.LST.6.1.uvh5",)], "path string")
    assert {r.stem: r.n for r in catalog.name_histogram(names, F.col("path")).collect()} == {"LST": 2, "STD": 1}


def test_manifest_diff(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (4, "d", 4)], "id int, x string, y int")
    got = {r.id: (r.change, r.columns) for r in catalog.diff_manifests(old, new, "id").collect()}
    assert got == {2: ("changed", "y"), 3: ("removed", None), 4: ("added", None)}
    assert catalog.diff_manifests(old, old, "id").count() == 0


def test_status_keeps_bad_records(spark):
    rows = spark.createDataFrame([(1, '{"k": 3}'), (2, "{bad"), (3, None)], "id int, line string")
    got = {r.id: (r.status, r.record.k if r.record else None) for r in tables.with_status(rows, "line", "k bigint").collect()}
    assert got == {1: ("ok", 3), 2: ("error", None), 3: ("error", None)}


def test_profile_kind_and_band(spark):
    rows = spark.createDataFrame([("x.pspec.h5",), ("y.skyh5",), ("z.uvh5",)], "p string")
    assert [r[0] for r in rows.select(tables.profile_kind(F.col("p"))).collect()] == ["pspec", "skymodel", "visibility"]
    names = spark.createDataFrame([("sum.aligned.spw07.npz",), ("none.npz",)], "p string")
    assert [r[0] for r in names.select(tables.band_of_file(F.col("p"))).collect()] == [7, None]


def test_manifest_csv_writes_null_as_empty(spark, tmp_path):
    products = spark.createDataFrame([("a", "r", None)], "product_id string, role string, n_files int")
    writers.write_manifest_csv(products, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text == "product_id,role,n_files\na,r,\n"


def test_manifest_document(spark, tmp_path):
    products = spark.createDataFrame([("b", 1), ("a", None)], "product_id string, n_files int")
    writers.write_json(writers.manifest_document(products, {"title": "t"}), str(tmp_path / "doc"), pretty=True)
    got = json.loads(next((tmp_path / "doc").glob("part-*")).read_text())
    assert got["n_products"] == 2 and [p["product_id"] for p in got["products"]] == ["a", "b"] and got["products"][0]["n_files"] is None


def test_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.txt").write_text("x")
    assert [r.length for r in tables.list_files(spark, str(tmp_path)).collect()] == [3]
    assert sorted(r.length for r in tables.list_files(spark, str(tmp_path), recursive=True).collect()) == [1, 3]


def test_manifest_over_many_files_is_one_document(spark, tmp_path):
    rows = [(f"p{i:04d}", None if i % 3 else i, f"a}},[{i}") for i in range(200)]
    products = spark.createDataFrame(rows, "product_id string, n_files int, path string").repartition(7)
    facts = {"title": "t}", "date": "d"}
    writers.write_manifest_parts(products, facts, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    got = json.loads(text)
    assert got == facts | {"n_products": 200, "products": [dict(zip(("product_id", "n_files", "path"), r, strict=True)) for r in rows]}
    read = writers.read_manifest_parts(spark.read.text(str(tmp_path / "m")), "product_id string, n_files int, path string")
    assert sorted(map(tuple, read.collect()), key=str) == sorted(rows, key=str)
    for facts, few in (({}, products.limit(0)), ({}, products.where("n_files = 3")), ({"a": "b"}, products.limit(0))):
        out = tmp_path / f"n{len(facts)}{few.count()}"
        writers.write_manifest_parts(few, facts, str(out))
        document = json.loads("".join(p.read_text() for p in sorted(out.glob("part-*"))))
        assert document["n_products"] == few.count() == len(document["products"])


def test_root_names_stand_for_files_without_a_header(spark):
    rows = [("a.uvh5", "Header", "Ntimes", 0, "3"), ("a.uvh5", "Data", "d", 0, "7"), ("a.uvh5", "Root", "Header", 0, ""), ("b.uvh5", "Root", "x", 0, ""), ("b.uvh5", "Root", "Data", 0, ""), ("b.uvh5", "Data", "v", 0, "7"), ("c.skyh5", "Header", "nside", 0, "64"), ("c.skyh5", "Root", "Header", 0, "")]
    headers = spark.createDataFrame(rows, "file string, part string, key string, at int, value string")
    got = {r.file: r for r in tables.profile_headers(headers.where("file LIKE '%uvh5'")).collect()}
    assert got["a.uvh5"].scalars == {"Ntimes": "3"} and got["a.uvh5"].data_datasets == {"d": [7]} and got["a.uvh5"].root_keys is None
    assert got["b.uvh5"].root_keys == ["Data", "x"] and [v for k, v in got["b.uvh5"].asDict().items() if k not in ("file", "root_keys")] == [None] * (len(got["b.uvh5"]) - 2)
    sky = tables.profile_sky(headers.where("file LIKE '%skyh5'")).first()
    assert sky.root_keys == ["Header"] and sky.scalars == {"nside": "64"}

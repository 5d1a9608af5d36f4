"""Metadata records and documents whose keys are only known from the data, as VARIANT columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Levels of a document that are walked before what is found is stored.
LEVELS = 4


def records_of_lines(lines: DataFrame, text: str, at: str) -> DataFrame:
    """``label, record`` of JSON lines: of several records with a label the last one in order of ``at``.

    A record keeps the keys that its line has, nested ones too. Lines that don't begin with ``{``, that cannot
    be parsed or that have no label are left out.
    """
    json = F.trim(F.col(text))
    seen = lines.where(json.startswith("{")).select(F.try_variant_get(F.try_parse_json(json), "$.label", "string").alias("label"), json.alias("_json"), F.col(at).alias("_at"))
    last = seen.where("label IS NOT NULL").groupBy("label").agg(F.max_by("_json", "_at").alias("_json"))
    return last.select("label", F.parse_json("_json").alias("record"))


def keys_of(record: Column) -> Column:
    """The names at the top of an object, in order; null for anything else."""
    return F.sort_array(F.map_keys(_entries(record)))


def _entries(record: Column) -> Column:
    return F.try_variant_get(record, "$", "map<string,variant>")


def subset(record: Column, keys: Column) -> Column:
    """The object with those of its entries that ``keys`` lists (null: all), in the order of their names."""
    wanted = F.map_filter(_entries(record), lambda k, _: F.coalesce(F.array_contains(keys, k), F.lit(True)))
    return F.to_variant_object(wanted)


def join_records(products: DataFrame, records: DataFrame, label: str = "meta_label", keys: str = "meta_keys") -> DataFrame:
    """Every product with ``sample_metadata``: of the record of its ``label`` the entries that its own list ``keys``
    names and the record has. No label, or one without a record, gives an empty object; a null list all
    entries."""
    own = records.select(F.col("label").alias("_label"), F.col("record").alias("_record"))
    joined = products.join(own, F.col(label) == F.col("_label"), "left")
    return joined.select(*products.columns, F.coalesce(subset(F.col("_record"), F.col(keys)), F.parse_json(F.lit("{}"))).alias("sample_metadata"))


def walked(documents: DataFrame, by: list[str], document: str, named: dict[str, str] | None = None) -> DataFrame:
    """``by, path, value``: the leaves of each document (a VARIANT) with their paths, values as JSON text.

    Paths are ``$.key`` and ``[place]`` in turn. ``named`` gives for a path of an array (``[*]`` for places in it) the
    key of its objects that names an element instead of its place, so that lists can be compared where
    elements came or went. Empty objects and arrays are leaves. A round takes ``LEVELS`` levels of all
    documents in one pass and stores what it comes to; only what is deeper goes on to another round.
    """
    named = named or {}
    level = documents.select(*by, F.lit("$").alias("path"), F.lit("$").alias("kind"), F.col(document).alias("value"))
    out = None
    while True:
        for _ in range(LEVELS):
            level = _opened(level, by, named)
        shape = F.schema_of_variant("value")
        inside = F.coalesce((shape.startswith("OBJECT<") & (shape != "OBJECT<>")) | (shape.startswith("ARRAY<") & (F.to_json("value") != "[]")), F.lit(False))
        level = level.withColumn("_inside", inside)
        # Leaves are stored as text: as variants each would bring the names of its whole document.
        level = materialise(level.select(*by, "path", F.when(F.col("_inside"), F.col("kind")).alias("kind"), F.when(~F.col("_inside"), F.to_json("value")).alias("leaf"), F.when(F.col("_inside"), F.col("value")).alias("value"), "_inside"), "walk")
        leaves = level.where("NOT _inside").select(*by, "path", F.col("leaf").alias("value"))
        out = leaves if out is None else out.unionAll(leaves)
        level = level.where("_inside").select(*by, "path", "kind", "value")
        if level.isEmpty():
            return out


def _opened(level: DataFrame, by: list[str], named: dict[str, str]) -> DataFrame:
    """``by, path, kind, value`` of the elements of each value; a value without any stays as it is."""
    spark, view = level.sparkSession, f"_walk_{uuid.uuid4().hex}"
    level.withColumnRenamed("value", "_outer").createOrReplaceTempView(view)
    names = ", ".join(f"w.`{c}`" for c in by)
    inner = spark.sql(f"SELECT {names}{', ' if by else ''}w.path AS _path, w.kind AS _kind, w._outer, e.pos, e.key, e.value FROM {view} w, LATERAL variant_explode_outer(w._outer) e")
    spark.catalog.dropTempView(view)
    place = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    for path, key in named.items():
        place = F.when((F.col("_kind") == path) & F.col("key").isNull(), F.concat(F.lit("["), F.coalesce(F.try_variant_get("value", f"$.{key}", "string"), F.col("pos").cast("string")), F.lit("]"))).otherwise(place)
    step, leaf = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))), F.col("pos").isNull()
    below = lambda outer, step: F.when(leaf, F.col(outer)).otherwise(F.concat(outer, step))
    return inner.select(*by, below("_path", F.coalesce(step, place)).alias("path"), below("_kind", F.coalesce(step, F.lit("[*]"))).alias("kind"), F.when(leaf, F.col("_outer")).otherwise(F.col("value")).alias("value"))


def diff_documents(old: DataFrame, new: DataFrame, by: list[str], document: str, named: dict[str, str] | None = None) -> DataFrame:
    """``by, path, change, old, new``: paths whose leaves were added, removed or changed from one set of documents
    (keyed by ``by``) to another."""
    a, b = (walked(d, by, document, named) for d in (old, new))
    a = a.select(*[F.col(c).alias(f"_a_{c}") for c in by], F.col("path").alias("_a_path"), F.col("value").alias("old"), F.lit(True).alias("_in_old"))
    b = b.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("path").alias("_b_path"), F.col("value").alias("new"), F.lit(True).alias("_in_new"))
    on = F.col("_a_path") == F.col("_b_path")
    for c in by:
        on = on & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    both = a.join(b, on, "full").withColumn("change", change).where("change IS NOT NULL")
    key = lambda c: F.when(F.col("_in_old"), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")).alias(c)
    return both.select(*[key(c) for c in by], F.coalesce("_a_path", "_b_path").alias("path"), "change", "old", "new")

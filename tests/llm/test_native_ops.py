"""Exact dedup, source mixing and quality rules: brute force on odd rows, SQL on a whole table."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from alignkit.llm import exact_dedup, mixing, quality_rules, queries

ODD = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (5, "a  b"), (6, "w " * 30000), (7, "é ñ\nx\nx\n\nx"), (8, " \t\n"), (None, "q")]


def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.selectExpr("*", "if(doc_id % 3 = 0, null, concat('s', doc_id % 3)) AS source", "1 AS kept", "'x' AS digest", "2 AS salt", "3 AS size", "map('k', 1) AS extra")


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_source_mix", "op10_quality_rules", "op11_vector_codes", "op12_target_sample", "op13_chat_format"])
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(object).astype(str).replace({r"\.0$": "", "^(<NA>|nan)$": ""}, regex=True)
    assert order(got).equals(order(want))


def test_exact_duplicates(spark):
    got = exact_dedup.exact_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(t or "", []).append(i)
    texts = {(i, hashlib.sha256((t or "").encode()).hexdigest()): t or "" for i, t in ODD}
    for r in got:
        ids = groups[texts[r.doc_id, r.text_sha256]]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (max(known) if known else None)
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_duplicates(odd(spark).limit(0)).count() == 0


def test_deduplicate_keeps_whole_rows(spark):
    docs = odd(spark)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["2", "4", "5", "6", "7", "8", "None"])
    assert {r.doc_id: r.text for r in rows}[2] == "" and all(r.extra == {"k": 1} for r in rows)
    both = docs.where("doc_id = 1")
    assert exact_dedup.deduplicate(both).first().text is None


def test_hot_class_is_dealt_over_salts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_duplicates(docs).where("text_sha256 = sha2('same', 256)").agg(F.count("*"), F.min("keep_id"), F.max("group_size"), F.count_if("kept")).first()
    assert tuple(got) == (1000, 2997, 1000, 1)


def test_mixing_odd_rows(spark):
    got = mixing.mix_report(odd(spark)).collect()
    assert len(got) == len(ODD)
    sizes = sum(r.size for r in got)
    assert sum({(r.source_size, r.target) for r in got} and [t for _, t in {(r.source_size, r.target) for r in got}]) <= 1.5 * sizes + 1e-6
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in got)
    again = mixing.mix_report(odd(spark).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_report(odd(spark).limit(0)).count() == 0
    mixed = mixing.mix(odd(spark))
    assert mixed.columns == odd(spark).columns
    assert mixed.agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")))).first()[0] == sum(r.taken for r in got)


def test_odds_differ_within_a_source_and_expect_the_target(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    slim = mixing.document_sizes(docs)
    plan = mixing.mixing_plan(slim)
    rows = slim.join(plan, ["_null", "_source"]).where("p > 0").select("_source", "size", "source_size", "p", mixing.inclusion().alias("pi"), mixing._rank(F.col("u"), mixing.inclusion()).alias("rank"), "u").collect()
    assert all(0 < r.pi < 1 for r in rows)
    moved = 0
    for s in {r._source for r in rows}:
        own = [r for r in rows if r._source == s]
        assert sum(r.size * r.pi for r in own) == pytest.approx(own[0].p * own[0].source_size, rel=1e-9)
        by_size = sorted(own, key=lambda r: r.size)
        assert by_size[-1].pi > by_size[0].pi and len({r.pi for r in own}) > len({r.size for r in own}) // 2
        moved += [r.u for r in sorted(own, key=lambda r: r.rank)] != [r.u for r in sorted(own, key=lambda r: r.u)]
    assert moved  # dividing by inclusion odds changes the order that the draws alone would give
    for s, taken, target, longest in mixing.mix_report(docs.withColumnRenamed("lang", "rank")).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken"), F.first("target"), F.max("size")).collect():
        assert abs(taken - target) <= longest / 2 + 1e-6, s


def test_cut_by_digits_equals_a_sorted_sample(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source", "repeat('w ', cast(pmod(hash(id), 40) AS int)) AS text")
    slim = mixing.document_sizes(docs)
    plan = mixing.mixing_plan(slim)
    rows = slim.join(plan, ["_null", "_source"]).select("*", F.when(F.col("p") > 0, mixing._rank(F.col("u"), mixing.inclusion())).alias("rank"), mixing._copies().alias("copies")).collect()
    for s in {r._source for r in rows}:
        own, so_far = [r for r in rows if r._source == s], 0
        missing = own[0].target - own[0].whole * own[0].source_size
        for r in sorted(own, key=lambda r: (r.rank or 0, r.doc_id)):
            so_far += r.size
            assert r.copies == r.whole + (r.p > 0 and so_far - r.size / 2 <= missing)


def test_targets_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 500), (True, "", 100)], "_null boolean, _source string, source_size long")
    got = {(r._null, r._source): r.target for r in mixing.source_targets(sizes).collect()}
    left, caps, weight = 1.5 * 1610, {("a"): 20.0, "b": 2000.0, "c": 1000.0, None: 200.0}, {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}
    want, open_ = {}, set(caps)
    while open_:
        level = (left - sum(want.values())) / sum(weight[k] for k in open_)
        over = {k for k in open_ if weight[k] * level > caps[k]}
        if not over:
            want |= {k: weight[k] * level for k in open_}
            break
        want |= {k: caps[k] for k in over}
        open_ -= over
    assert {(k[1] if not k[0] else None): v for k, v in got.items()} == pytest.approx(want)


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    covered = {p for i, g in enumerate(grams) if counts[g] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_of_odd_rows(spark):
    texts = [t for _, t in ODD] + ["a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x", "one\ntwo\none\n one", "#a *b $ % & | < >", "a b c d e", "p q r s t p q r s t p q r s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit(5))
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_measures(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_order_of_rules_does_not_change_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality_rules.default_rules()
    ordered = quality_rules.order_rules(docs, rules)
    assert {r.name for r in ordered} == {r.name for r in rules}
    verdicts = [quality_rules.measure(docs).select("doc_id", quality_rules.cascade(o).alias("kept")).collect() for o in (rules, rules[::-1])]
    assert sorted(verdicts[0]) == sorted(verdicts[1])
    left = quality_rules.apply_rules(docs).where("kept").count()  # a filter on the verdict is pushed into the measures
    assert 0 < left < docs.count()


def test_a_dear_rule_goes_behind_a_cheap_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    longest = F.char_length(F.regexp_replace("content", r"\s", "")) > 2000
    dear, cheap = quality_rules.Rule("dear", longest, {"content": 2}), quality_rules.Rule("cheap", F.col("word_chars") > 2000)
    never = quality_rules.Rule("never", F.col("n_words") < 0)
    for rules in ([dear, cheap, never], [never, cheap, dear], [cheap, dear, never]):
        names = [r.name for r in quality_rules.order_rules(docs, rules)]
        assert names[0] == "cheap" and names == [r.name for r in quality_rules.order_rules(docs, rules)]  # the same in each run
    picky = quality_rules.Rule("picky", (F.col("word_chars") > 2000) | (F.col("n_words") < 200), {"content": 1})
    assert quality_rules.order_rules(docs, [picky, never])[0].name == "picky"  # cost alone doesn't decide

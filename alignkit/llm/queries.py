"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import byte_bpe, chat_format, exact_dedup, mixing, quality_model, quality_rules, secret_scan, simhash, suffix_dedup, target_sample, token_store, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_target_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sample.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(more)
    return chat_format.report(turns).drop("n_attachments", "expanded_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_source_mix": op3_source_mix,
    "op4_token_files": op4_token_files,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_model": op9_quality_model,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_target_sample": op12_target_sample,
    "op13_chat_format": op13_chat_format,
}

# One round over vector parts p: from codebooks b{i} the nearest entries n{j}, then codebooks b{j}.
_NEAREST = """
n{j} AS (SELECT vec_id, part, any_value(label) AS label, any_value(x) AS x, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist
         FROM (SELECT p.*, entry, list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - y[k]) * (x[k] - y[k])))::BIGINT AS dist FROM p JOIN b{i} USING (part)) GROUP BY vec_id, part)"""
_MEANS = """
b{j} AS (SELECT part, entry, coalesce(m.y, b{i}.y) AS y FROM b{i} LEFT JOIN (
         SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY k) AS y
         FROM (SELECT part, entry, k, sum(x[k])::BIGINT AS total, count(*) AS n FROM n{j}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS k) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry))"""
_LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in chat_format.Template().controls:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM (SELECT doc_id, content, max(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS content FROM documents))
""",
    "op3_source_mix": r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT nul, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY nul, src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
                 - coalesce(sum(lim) OVER (ORDER BY lim / weight, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY lim / weight, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT level FROM l WHERE weight * level <= lim ORDER BY lim / weight, nul, src LIMIT 1),
t AS (SELECT nul, src, source_size, coalesce(least(lim, weight * (SELECT level FROM o)), lim) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
             CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p FROM t),
x AS (SELECT d.*, source_size, target, whole, p, target - whole * source_size AS missing,
             CASE WHEN source_size > 0 THEN floor(size::DOUBLE * 4096.0::DOUBLE / (size::DOUBLE + source_size::DOUBLE / n_docs::DOUBLE))::BIGINT ELSE 0 END AS step
      FROM d JOIN p USING (nul, src) JOIN (SELECT nul, src, count(*) AS n_docs FROM d GROUP BY ALL) USING (nul, src)),
y AS (SELECT nul, src, CASE WHEN sum(size) > 0 THEN sum(size * step)::BIGINT::DOUBLE / (sum(size)::BIGINT::DOUBLE * 4096.0::DOUBLE) ELSE 0 END AS mean_step FROM x GROUP BY ALL),
q AS (SELECT x.*, p + least(p, 1.0::DOUBLE - p) * (step::DOUBLE / 4096.0::DOUBLE - mean_step) AS pi FROM x JOIN y USING (nul, src)),
o2 AS (SELECT *, u / (1.0::DOUBLE - u) AS random_odds, CASE WHEN p > 0 THEN pi / (1.0::DOUBLE - pi) END AS wanted_odds FROM q),
k AS (SELECT *, floor(random_odds / (random_odds + wanted_odds) * 1099511627776.0::DOUBLE)::BIGINT AS rnk FROM o2),
c AS (SELECT *, sum(size) OVER (PARTITION BY nul, src ORDER BY rnk, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached FROM k)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN p > 0 AND reached - size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
""",
    "op10_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c
      FROM (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS gram
            FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM g, (SELECT unnest(range(5)) AS o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(t, '[^\p{Lu}\p{Ll}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS uppers,
             length(t) - length(replace(t, '!!', '!')) AS shouts
      FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR shouts > 0.3 * n_words OR uppers > 0.6 * letters) AS kept
FROM b
""",
    "op11_vector_codes": f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, e[part * (len(e) // 16) + 1 : (part + 1) * (len(e) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_NEAREST.format(i=0, j=1)}, {_MEANS.format(i=0, j=1)}, {_NEAREST.format(i=1, j=2)}, {_MEANS.format(i=1, j=2)}, {_NEAREST.format(i=2, j=3)},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM n3 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h
""",
    "op12_target_sample": f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS w FROM documents), b AS (SELECT {_LOWERED} AS w FROM benchmark),
tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
v AS (SELECT word, xor(list_reduce(list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT),
                                   lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d UNION ALL SELECT w FROM b)), tab),
f AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM f JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM f JOIN v USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)
             + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score, coalesce(weight, 0) AS weight FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM r
""",
    "op13_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length('[INST]' || {_ESCAPED.format('role')} || '[/INST]' || {_ESCAPED.format('text')} || '</s>'))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""",
}

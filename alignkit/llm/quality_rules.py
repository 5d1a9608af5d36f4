"""Rule-based quality filter as a short-circuit cascade, in DataFrame operations only.

The measures of the contract are computed for every document. The verdict is an ordered cascade of
rejection rules: a sample of the documents tells each rule's cost (characters that it reads a row) and
what it rejects, and the rules are ordered by rejection per cost among the documents that the rules
before them let pass. The order changes what a row costs, never the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows that the cascade's cost and selectivity are estimated on.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean column over the measures and ``content``; it is never null. ``reads`` tells how often
    it goes through each text column; a rule that reads none compares numbers."""

    name: str
    rejects: Column
    reads: dict[str, int] = field(default_factory=dict)


def default_rules() -> list[Rule]:
    """Thresholds apply to whole documents; each rule aims at one kind of junk."""
    content, n = F.col("content"), F.col("n_words")
    letters = F.regexp_replace(content, r"[^\p{Lu}\p{Ll}]", "")
    upper = F.char_length(F.regexp_replace(letters, r"\p{Ll}", ""))
    return [
        Rule("symbols", F.col("n_symbols") > 0.3 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("dup_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("shouted_ends", F.char_length(content) - F.char_length(F.replace(content, F.lit("!!"), F.lit("!"))) > 0.3 * n, {"content": 3}),
        Rule("upper_case", upper > 0.6 * F.char_length(letters), {"content": 4}),
    ]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, even if the optimiser copies this expression (as
    it does when it pushes a filter on the result down)."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more in the array, first ones included.

    Windows are first compared by a 64-bit hash; only where a hash repeats are they compared as
    strings, so a collision costs time and not correctness.
    """
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    window = lambda i: [F.get(words, i + j) for j in range(WINDOW)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*window(i)))
    named = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("k"), i.alias("p"))))

    def places(of: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(of, j)["k"] == x["k"], F.lit(False))
        return F.sort_array(F.transform(F.filter(of, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    # Length of the union of the intervals [p, p + 5), taken in ascending order.
    covered = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n")),
        lambda a: a["n"],
    )
    exact = _let(named, lambda of: covered(places(of)))
    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, some).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, content`` and the measures of the contract, a row for each row of ``docs``."""
    content = F.col("content")
    lines = F.filter(F.split(content, "\n"), lambda s: F.trim(s, F.lit(BLANKS)) != "")
    base = docs.select("doc_id", text_or_empty().alias("content")).select("*", words_of(content).alias("_words"), lines.alias("_lines"))
    return base.select(
        "doc_id",
        "content",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate(content, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(content) - F.char_length(F.translate(content, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _let(F.col("_words"), _repeat_words).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: What a rule costs besides the characters that it reads, in characters.
LEAST_COST = 8.0


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Order rules by rejection per cost on a hash sample of about ``sample_rows`` documents.

    A cost is the mean number of characters that a rule goes through a row of the sample, so it is the
    same in each run and on each machine. Rejection is conditional: one job reduces the sample to
    counts per pattern of verdicts (at most 2^rules rows), from which the best next rule among the
    survivors is taken greedily. An empty sample keeps the given order.
    """
    total = docs.count()
    if not total or len(rules) < 2:
        return rules
    share = min(1.0, sample_rows / total)
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    texts = sorted({c for r in rules for c in r.reads})
    sizes = [F.sum(F.char_length(c)).alias(f"_chars_{c}") for c in texts]
    found = measure(picked).where(~base_failed()).groupBy(*[r.rejects.alias(r.name) for r in rules]).agg(F.count(F.lit(1)).alias("_rows"), *sizes).collect()
    if not found:
        return rules
    patterns = [(*r[: len(rules)], r["_rows"]) for r in found]
    rows = sum(p[-1] for p in patterns)
    mean = {c: sum(r[f"_chars_{c}"] for r in found) / rows for c in texts}
    cost = {r.name: LEAST_COST + sum(times * mean[c] for c, times in r.reads.items()) for r in rules}
    left, out = list(enumerate(rules)), []
    while left:
        gain = {i: sum(p[-1] for p in patterns if p[i]) / cost[r.name] for i, r in left}
        i, best = max(left, key=lambda x: (gain[x[0]], -x[0]))
        out.append(best)
        left.remove((i, best))
        patterns = [p for p in patterns if not p[i]]
    return out


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; CASE evaluates its branches in order and stops at the first hit."""
    out = F
    for r in rules:
        out = out.when(r.rejects, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures and verdict for each row of ``docs``; no row is dropped.

    Null text: no words, so ``base_failed``. Repeated rows are measured each on their own; an empty
    table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    ordered = order_rules(docs, default_rules() if rules is None else rules, sample_rows)
    measured = measure(docs).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))

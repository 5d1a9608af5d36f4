"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts and lexicon are folded alike: compatible forms and accents to plain letters (NFKD without its
marks), lower case, homoglyphs and digit substitutions to plain letters, every other character that is
not a letter to a space, invisible ones to nothing. The lexicon is learned from labelled documents: word
beginnings and whole words that toxic documents have and others lack, weighted by their log-odds.
One automaton finds its terms and the exception phrases in one pass; a term inside an exception
phrase does not count. A document's score is a logistic function of its summed weights divided by
its length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_or_empty

# Letters of other scripts that look like Latin ones, and the letters they fold to.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "i", "ԛ": "q", "ԝ": "w", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ſ": "s",
}
# Digits and signs written for letters. "1" stands for i and for l, so both fold to i.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
#: Phrases in which a lexicon term is not an insult, for lack of others: every function takes its own.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "class clown", "pond scum", "soap scum", "sore loser", "village idiot")

#: Lengths of the word beginnings that are tried as terms.
PREFIXES = range(4, 9)
#: Toxic documents that a term must occur in, whatever their number.
MIN_DOCS = 3
#: Least log-odds of a term (what it adds to the odds of a document to be toxic, labels of either kind
#: weighing alike), by the levels at which terms are looked for: clear insults first, so that words beside
#: them are not taken for one; ambiguous terms then serve the toxic documents that have no clear one.
LEVELS = tuple(math.log(x) for x in (99, 19, 4))
#: Terms that a counting task holds before it hands them on.
HELD_TERMS = 500_000
#: Words that every document counts as longer, so that a short one needs no less than a full hit.
LENGTH_PRIOR = 20
#: Cells of the density histogram that calibrates the score.
CELLS = 512
THRESHOLD = 0.3


class _Fold(dict):
    """Code points and what they fold to; those not given are looked up by their category once met."""

    def __missing__(self, c: int) -> str | None:
        kind = unicodedata.category(chr(c))
        self[c] = None if kind[0] == "M" or kind == "Cf" else chr(c) if kind[0] == "L" else " "
        return self[c]


def _fold_table() -> _Fold:
    table = {c: " " for c in range(128) if not chr(c).isalpha()}
    table |= {ord(c): c.lower() for c in "ABCDEFGHIJKMNOPQRSTUVWXYZ"} | {ord("L"): "i"}
    table |= {ord(k): v for k, v in SUBSTITUTES.items()}
    return _Fold(table | {ord(x): v for k, v in HOMOGLYPHS.items() for x in (k, k.upper()) if len(x) == 1 and ord(x) > 127})


FOLD = _fold_table()


def fold(text: str | None) -> str:
    """Folded text with a space at each end; runs of separators stay runs."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return f" {text.translate(FOLD).lower()} "


@dataclass(frozen=True)
class Lexicon:
    """``terms``: folded term, from the space before a word on, with a closing space for a whole word."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = 0.0
    _built: list = field(default_factory=list, compare=False, repr=False)

    def automaton(self):
        if not self._built:
            import ahocorasick

            found = ahocorasick.Automaton()
            for phrase in self.exceptions:
                found.add_word(" ".join(fold(phrase).split()), (0.0, len(" ".join(fold(phrase).split()))))
            for term, weight in self.terms.items():
                found.add_word(term, (weight, len(term)))
            if len(found):
                found.make_automaton()
            self._built.append(found)
        return self._built[0]

    def density(self, text: str | None) -> float:
        """Summed weights of the terms outside exception phrases, for each word of the text."""
        found = self.automaton()
        if not text or not len(found):
            return 0.0
        plain = fold(text)
        hits, shields = [], []
        for end, (weight, size) in found.iter(plain):
            (hits if weight else shields).append((end - size + 1, end, weight))
        if not hits:
            return 0.0
        if shields:
            # A term is shielded by a phrase that begins a character after it at the latest and ends a character
            # before it at the earliest: the furthest end of all phrases that begin in time tells.
            shields.sort()
            starts, ends = [a - 1 for a, _, _ in shields], list(accumulate((b + 1 for _, b, _ in shields), max))
            hits = [h for h in hits if not ((n := bisect_right(starts, h[0])) and h[1] <= ends[n - 1])]
        return sum(w for _, _, w in hits) / (len(plain.split()) + LENGTH_PRIOR)

    def score(self, density: float) -> float:
        z = self.slope * _cell(density) - self.offset
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    def __reduce__(self):
        return Lexicon, (self.terms, self.exceptions, self.slope, self.offset)


def _cell(density: float) -> float:
    """A density on a log scale from 0 to 1; 0 for none."""
    return 0.0 if density <= 0 else min(1.0, max(0.05, 0.05 + 0.95 * math.log(density * 1e4 + 1) / math.log(1e5)))


def _features(plain: str, exceptions: tuple[str, ...] = EXCEPTIONS) -> set[str]:
    """Terms that occur in a folded text outside exception phrases, as the lexicon would count them."""
    out = set()
    shields = [(m.start(), m.end(1) - 1) for m in _phrases(exceptions).finditer(plain)] if exceptions else []
    words = {(m.group(), m.start()) for m in _WORD.finditer(plain)} if shields else {(w, 0) for w in plain.split()}
    for word, at in words:
        if len(word) >= 3:
            # A term from the space before the word on is shielded if it ends no later than a character after the phrase.
            until = max((b + 1 for a, b in shields if a <= at <= b + 1), default=-1)
            if at + len(word) > until:
                out.add(f" {word} ")
            out.update(f" {word[:n]}" for n in PREFIXES if n <= len(word) and at + n - 1 > until)
    return out


_WORD = re.compile(r"\S+")


@lru_cache
def _phrases(exceptions: tuple[str, ...]) -> re.Pattern:
    """Finds each place where an exception phrase begins; group 1 is the longest phrase there."""
    folded = sorted((" ".join(fold(p).split()) for p in exceptions), key=len, reverse=True)
    return re.compile(f"(?=({'|'.join(map(re.escape, folded))}))")


def _count_terms(labelled: DataFrame, exceptions: tuple[str, ...]) -> DataFrame:
    """``term, toxic, clean``: documents of each kind that have each term, summed within a task before
    they are shuffled."""

    def table(seen):
        counts = zip(*seen.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["term", "toxic", "clean"])

    def each(batches):
        seen = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in _features(fold(text), exceptions):
                    seen.setdefault(term, [0, 0])[1 - toxic] += 1
                if len(seen) > HELD_TERMS:
                    yield table(seen)
                    seen = {}
        if seen:
            yield table(seen)

    rows = labelled.select(text_or_empty().alias("text"), F.col("toxic").cast("int").alias("toxic"))
    return rows.mapInArrow(each, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _candidates_of(toxic_rows: DataFrame, candidates: frozenset[str], exceptions: tuple[str, ...]) -> DataFrame:
    """``terms``: the candidates that each toxic document has."""

    def each(batches):
        for batch in batches:
            found = [sorted(_features(fold(t), exceptions) & candidates) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["terms"])

    return toxic_rows.select(text_or_empty().alias("text")).mapInArrow(each, "terms array<string>")


def _without(rows: DataFrame, kept: frozenset[str]) -> DataFrame:
    """The rows whose ``terms`` has none of ``kept``, nor a term that begins with one."""

    def covered(terms):
        return any(t[:n] in kept for t in terms for n in range(2, len(t) + 1))

    def each(batches):
        for batch in batches:
            yield batch.filter(pa.array([not covered(t) for t in batch.column(0).to_pylist()], pa.bool_()))

    return rows.mapInArrow(each, rows.schema)


def learn(labelled: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn terms, weights and calibration from ``labelled(text, toxic)``; null labels are ignored.

    All labelled rows count; of equal toxic texts one does, so that a large group of copies does not
    make its words look toxic. Occurrences inside exception phrases count on neither side. Terms are
    counted and chosen where they are: only those that ``MIN_DOCS`` toxic documents have, and that are
    clearly likelier there, come to the driver. Each round takes the most frequent terms of a level of
    log-odds and then looks only at the toxic documents that have none yet; a term must reach the level
    on those documents alone, less a standard error, so that words which merely stand beside a term are not learned. The
    rounds go on until no term of any level is left. The calibration sees a histogram of ``CELLS``
    cells. Without toxic rows or others the lexicon is empty.
    """
    labelled = labelled.where("toxic IN (0, 1)")
    toxic_rows = materialise(labelled.where("toxic = 1").dropDuplicates(["text"]), "toxic-rows")
    labelled = labelled.where("toxic = 0").unionByName(toxic_rows)
    sizes = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, exceptions, offset=2.0)

    def odds(toxic: int, clean: int) -> float:
        return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))

    def spread(toxic: int, clean: int) -> float:
        return math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))

    in_spark = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    counts = {r.term: (r.toxic, r.clean) for r in _count_terms(labelled, exceptions).where((F.col("toxic") >= MIN_DOCS) & (in_spark >= LEVELS[-1])).collect()}
    left = materialise(_candidates_of(toxic_rows, frozenset(counts), exceptions).where(F.size("terms") > 0), "toxic-terms")
    kept: dict[str, float] = {}
    for level in LEVELS:
        while True:
            found = {r.term: r.n for r in left.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS).collect()}
            # The clearest insults are rare in few labels: there a term without any clean use reaches each level.
            found = {t: n for t, n in found.items() if not counts[t][1] or odds(n, counts[t][1]) - spread(n, counts[t][1]) >= level}
            if not found:
                break
            most = max(found.values())
            for term in sorted(found, key=lambda t: (len(t.rstrip()), t)):
                if 2 * found[term] >= most and not any(term[:n] in kept for n in range(2, len(term))):
                    kept[term] = odds(*counts[term])
            left = materialise(_without(left, frozenset(kept)), "toxic-terms")
    cells = np.zeros((CELLS + 1, 2))
    scored = densities(labelled, Lexicon(kept, exceptions), ("toxic",))
    for r in scored.groupBy(F.col("toxic"), F.floor(F.col("cell") * CELLS).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        cells[r.cell, r.toxic] += r.n
    slope, offset = _calibrate(cells)
    return Lexicon(kept, exceptions, slope=slope, offset=offset)


def _calibrate(cells: np.ndarray) -> tuple[float, float]:
    """Logistic regression with a small ridge on (cell, label) counts, by Newton steps."""
    x = np.stack([np.arange(len(cells)) / (len(cells) - 1), np.ones(len(cells))], axis=1)
    n, y, w = cells.sum(axis=1), cells[:, 1], np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (y - n * p) - 0.01 * w)
        w += np.clip(step, -10, 10)
    return max(float(w[0]), 0.0), -float(w[1])


def densities(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns with ``cell`` (density on its log scale) and ``score`` for each row."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def each(batches):
        for batch in batches:
            found = [lexicon.density(t) for t in batch.column(len(keep)).to_pylist()]
            cells, scores = [_cell(d) for d in found], [lexicon.score(d) for d in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(cells, pa.float64()), pa.array(scores, pa.float64())], names=[*keep, "cell", "score"])

    return docs.select(*keep, text_or_empty().alias("_text")).mapInArrow(each, f"{schema}, cell double, score double")


def held_out(remainder: int = 2, of: int = 4):
    """True for rows whose labels must not be learned from: crc32(doc_id as text) mod ``of``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == remainder


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of the labelled documents outside the held-out part, written once: learning reads
    them several times, and the join that finds them moves texts. Labels grow with the documents, so the
    join is the same sort-merge join at every size."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return materialise(docs.where(~held_out()).select("doc_id", "text").join(train.hint("merge"), "doc_id").select("text", "toxic"), "labelled")


def toxicity(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts have no term, thus the lowest score. Rows that repeat an id are each
    scored; a null id counts as not held out; an empty table gives no rows. Columns other than
    ``doc_id`` and ``text`` are not read.
    """
    lexicon = learn(training_rows(docs, labels), exceptions)
    scored = densities(docs, lexicon, ("doc_id",))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns unchanged.

    Texts pass through the scoring tasks, so rows are filtered where they are and nothing is joined.
    """
    lexicon = learn(training_rows(docs, labels), exceptions)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))

    def each(batches):
        for batch in batches:
            fine = [lexicon.score(lexicon.density(t)) < THRESHOLD for t in batch.column(1).to_pylist()]
            yield batch.select([0]).filter(pa.array(fine, pa.bool_()))

    kept = rows.mapInArrow(each, T.StructType([rows.schema["row"]]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

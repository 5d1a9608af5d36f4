"""Mixing sources to target weights by Pareto order sampling.

A source whose target is e times its size wants e copies of each word. Every document gets floor(e)
certain whole copies. One more copy goes to an unequal-probability sample: with p = e - floor(e), a
document's inclusion probability is p moved up or down by its length, longer documents being likelier,
so that the words expected from the sample are still p times the source's. Pareto order sampling ranks
the documents by random odds (u / (1 - u)) divided by inclusion odds (p / (1 - p)) and takes the lowest
ranks until the words still missing are met.

u comes from the MD5 of the document's id: reruns and retries agree. No group is ever sorted: the rank
at which a source's words are met is found by its binary digits, ten at a time, from sums that Spark
combines before it shuffles them. What results is one cut per source, which each row is then compared
with, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, discard, materialise, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
#: Bits of a rank, and bits of it that a round of sums tells apart.
RANK_BITS, ROUND_BITS = 40, 10
#: Steps in which inclusion probabilities grow with a document's length.
STEPS = 4096

_KEY = ["_null", "_source"]


def _source_key() -> list[Column]:
    return [F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source")]


def _draw() -> Column:
    """u in (0, 1): 52 bits of an MD5, in steps that doubles hold exactly."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix"))), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def _step() -> Column:
    """How a document's size compares with its source's mean: 0 for an empty one, below ``STEPS`` for all."""
    size = F.col("size").cast("double")
    return F.when(F.col("source_size") > 0, F.floor(size * float(STEPS) / (size + F.col("source_size") / F.col("n_docs")))).otherwise(F.lit(0)).cast("long")


def inclusion() -> Column:
    """A document's inclusion probability from its size and its source's ``p`` and ``mean_step`` (weighted
    by size, so that the expected words are p times the source's)."""
    p = F.col("p")
    return p + F.least(p, 1.0 - p) * (_step() / float(STEPS) - F.col("mean_step"))


def _rank(u: Column, p: Column) -> Column:
    """The ratio of random to inclusion odds, in ``RANK_BITS`` bits of its share of their sum."""
    random, wanted = u / (1.0 - u), p / (1.0 - p)
    return F.floor(random / (random + wanted) * F.lit(float(1 << RANK_BITS))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (``_null, _source, source_size`` and more) with ``target``: weights repeat over the sources
    in code point order (null last) and share ``share`` times all words; a target stops at ``cap`` times
    its source, and the excess is shared again by weight until none is above.

    That end is found without iterating: sources ordered by (cap * size / weight) are capped from
    the front as long as the level of the rest exceeds their own. The table has a row per source, so
    its unpartitioned windows stay small.
    """
    turn = (F.row_number().over(Window.orderBy(*_KEY)) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    w = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), *_KEY)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = w.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).alias("_left"),
        F.sum("weight").over(onward).alias("_heavy"),
    ).withColumn("_level", F.col("_left") / F.col("_heavy"))
    # Levels rise while sources are capped; the first source under its limit sets the level of all after it.
    open_level = F.min(F.when(F.col("weight") * F.col("_level") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), *_KEY, "_level"))).over(everything)
    return level.withColumn("_open", open_level["_level"]).select(
        *sizes.columns, F.coalesce(F.least("limit", F.col("weight") * F.col("_open")), F.col("limit")).alias("target")
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, _null, _source, size, u`` of each row, written once: texts are read for it once."""
    return materialise(docs.select("doc_id", *_source_key(), count_words(text_or_empty()).alias("size"), _draw().alias("u")), "mix-sizes")


def mixing_plan(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: ``_null, _source, source_size, n_docs, target, whole, p, mean_step, cut_rank,
    cut``.

    A document has a further copy if its rank is below ``cut_rank``, or equal to it and its (doc_id,
    size) at most ``cut``. The row at which the missing words are reached is taken if at least half of
    it fits, so a source misses its target by half a document at most. Rows that repeat id, source and
    size are taken together or not at all.
    """
    sums = slim.groupBy(*_KEY).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(sums, weights, share, cap)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = targets.withColumn("wanted", wanted).select(
        "*", F.floor("wanted").alias("whole"), (F.col("wanted") - F.floor("wanted")).alias("p"), (F.col("target") - F.floor("wanted") * F.col("source_size")).alias("missing")
    )
    shares = materialise(shares.drop("wanted"), "mix-targets")
    steps = slim.join(shares, _KEY).groupBy(*_KEY).agg((F.sum(F.col("size") * _step()) / (F.first("source_size") * float(STEPS))).alias("mean_step"))
    plan = materialise(shares.join(steps, _KEY).withColumn("mean_step", F.coalesce("mean_step", F.lit(0.0))), "mix-shares")
    ranked = materialise(slim.join(plan, _KEY).where("p > 0").select(*_KEY, "doc_id", "size", _rank(F.col("u"), inclusion()).alias("rank")), "mix-ranks")
    cuts = plan.where("p > 0").select(*_KEY, F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), "missing")
    for shift in range(RANK_BITS - ROUND_BITS, -1, -ROUND_BITS):
        # Of each source the rows whose rank begins like the cut, summed by the next digits of it.
        digits = F.shiftright("rank", shift)
        first = shift + ROUND_BITS == RANK_BITS
        inside = ranked.join(cuts, _KEY) if first else ranked.join(cuts, _KEY).where(F.shiftright("rank", shift + ROUND_BITS) == F.col("prefix"))
        words = inside.groupBy(*_KEY, digits.alias("digits")).agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("missing").alias("missing"))
        order = Window.partitionBy(*_KEY).orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)
        reached = words.withColumn("so_far", F.col("before") + F.sum("words").over(order) - F.col("words")).where("so_far <= missing")
        last = F.max(F.struct(F.col("digits"), F.col("so_far"))).alias("c")
        found = reached.groupBy(*_KEY).agg(last, F.first("missing").alias("missing"))
        old, cuts = cuts, materialise(found.select(*_KEY, F.col("c.digits").alias("prefix"), F.col("c.so_far").alias("before"), "missing"), "mix-cuts")
        discard(old)
    # Rows of one rank: a handful, unless an id is repeated, and such rows are one group here.
    ties = ranked.join(cuts, _KEY).where(F.col("rank") == F.col("prefix")).groupBy(*_KEY, "doc_id", "size").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("missing").alias("missing"))
    order = Window.partitionBy(*_KEY).orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    fits = ties.withColumn("reached", F.col("before") + F.sum("words").over(order)).where(F.col("reached") - F.col("words") / 2.0 <= F.col("missing"))
    last = fits.groupBy(*_KEY).agg(F.max(F.struct("doc_id", "size")).alias("cut"))
    out = plan.join(cuts.select(*_KEY, F.col("prefix").alias("cut_rank")), _KEY, "left").join(last, _KEY, "left").drop("missing")
    out = materialise(out, "mix-plan")
    discard(ranked)
    return out


def _copies() -> Column:
    """Copies of a row that has its source's plan beside its own ``doc_id, size, u``."""
    rank = F.when(F.col("p") > 0, _rank(F.col("u"), inclusion()))
    extra = (rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & (F.struct("doc_id", "size") <= F.col("cut")))
    return F.col("whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row per row of ``docs``; no row is dropped.

    Null text counts as empty (size 0); a null source is a source of its own, last in order. Rows that
    repeat an id share its draw. An empty table gives no rows. Columns other than ``doc_id``, ``text``
    and ``source`` are not read, whatever their names.
    """
    slim = document_sizes(docs)
    return slim.join(mixing_plan(slim), _KEY).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def with_copies(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``copies`` for each row of ``docs``.

    The columns travel in one struct, so none of their names meets one of the plan's.
    """
    plan = mixing_plan(document_sizes(docs))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), *_source_key(), count_words(text_or_empty()).alias("size"), _draw().alias("u"))
    return own.join(plan, _KEY).select("row", _copies().alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it was taken, columns unchanged."""
    taken = with_copies(docs).where(F.col("copies") > 0)
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

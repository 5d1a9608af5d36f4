"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows with equal texts form a class; the row with the largest ``doc_id`` stays. Texts are combined
in three steps, and each step groups by the digest *and the whole text*, so a digest alone never
decides that two texts are equal:

1. inside each map task (the partial aggregation),
2. per (digest, salt, text): a class that holds a third of all rows is dealt over 64 salts,
3. per (digest, text): at most 64 salt winners of a class meet.

Only the salt winners travel to step 3. Members learn their class by a join on (digest, salt), so
no join key holds more than about 1/64 of a hot class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salt_bit, salt_of, salts_in, text_or_empty


def _salted(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.sha2(text, 256).alias("digest"), salt_of().alias("salt"), text.alias("content"), F.col("doc_id"))


def text_classes(docs: DataFrame) -> DataFrame:
    """One row per different text: ``digest, keep_id, group_size, salt_mask`` (bit i: salt i occurs)."""
    winners = _salted(docs).groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return (
        winners.groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(salt_bit(F.col("salt"))).alias("salt_mask"))
        .select("digest", "keep_id", "group_size", "salt_mask")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null text counts as empty. Rows that repeat a ``doc_id`` with the same text are each reported,
    with the same verdict (``deduplicate`` returns one of them). A class whose ids are all null has a
    null ``keep_id`` and is kept. An empty table gives no rows. Columns other than ``doc_id`` and
    ``text`` are not read. Should two different texts ever share a SHA-256, the query fails instead
    of answering wrongly.
    """
    by_digest = text_classes(docs).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.bit_or("salt_mask").alias("salt_mask"), F.count(F.lit(1)).alias("texts"))
    checked = by_digest.select(
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share one SHA-256"))).otherwise(F.col("digest")).alias("digest"),
        F.explode(salts_in(F.col("salt_mask"))).alias("salt"),
        "keep_id",
        "group_size",
    )
    members = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("digest"), salt_of().alias("salt"))
    return members.join(checked, ["digest", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per different text, with all their columns.

    The text is the grouping key itself, so it needs no join to come back; the other columns ride
    along with the largest ``doc_id``. Of rows that repeat id and text, one stays.
    """
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select(F.sha2(text_or_empty(), 256).alias("digest"), salt_of().alias("salt"), text_or_empty().alias("content"), order.alias("at"), rest.alias("rest"))
    best = F.max_by("rest", "at").alias("rest")
    kept = rows.groupBy("digest", "salt", "content").agg(best, F.max("at").alias("at")).groupBy("digest", "content").agg(best)
    text = F.when(~F.col("rest.no_text"), F.col("content")).alias("text")
    return kept.select(*[text if c == "text" else F.col("rest.others").getField(c).alias(c) for c in docs.columns])

"""Helpers shared by the text operators: shared scratch space, words, salted classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise, scratch_path

__all__ = ["discard", "materialise", "scratch_path"]

#: Characters that separate words in every contract of this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Bits of a salt mask, thus the number of salts that a hot group is dealt over.
SALTS = 64


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the runs of non-blank characters (blanks: space and 0x09-0x0D)."""
    trimmed = _trim(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def count_words(text: Column) -> Column:
    trimmed = _trim(text)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


def salt_of(id_col: str = "doc_id") -> Column:
    """A salt from 0 to SALTS - 1 that depends on the document only, so that retries agree."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int")


def salt_bit(salt: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), salt)


def salts_in(mask: Column) -> Column:
    """The salts whose bits are set in a mask made with ``bit_or(salt_bit(salt))``."""
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return F.filter(every, lambda i: F.getbit(mask, i) == 1)

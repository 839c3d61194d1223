"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word rule: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often a lambda inside ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` is used where the text is ASCII, as it is much faster than ``translate``."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words_of(col: Column) -> Column:
    """Maximal runs of characters outside the white-space class."""
    return F.array_remove(F.split(col, SPACE_CLASS + "+"), "")


def sha256_hex(col: Column) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)

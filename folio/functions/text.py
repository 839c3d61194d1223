"""Name cleaning.  White space and word characters are Unicode's, as names are multilingual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.magnet import bound


def strip(col: Column) -> Column:
    """Without white space at the ends; ``trim`` would keep wide spaces."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def longest_first(literals: Sequence[str]) -> list[str]:
    return sorted((x for x in literals if x), key=len, reverse=True)


def normalize_name(name: Column, literals: Sequence[str] = ()) -> Column:
    """Each literal becomes a space, runs of white space one space; null becomes empty."""
    out = F.coalesce(name, F.lit(""))
    for literal in literals:
        if literal:
            out = F.replace(out, F.lit(literal), F.lit(" "))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def remove_literals(name: Column, literals: Sequence[str]) -> Column:
    """Longest literals first; the name is stripped after each that it has."""
    out = name
    for literal in longest_first(literals):
        out = F.when(F.contains(out, F.lit(literal)), strip(F.replace(out, F.lit(literal), F.lit("")))).otherwise(out)
    return out


def contains_any(name: Column, literals: Sequence[str]) -> Column:
    out = F.lit(False)
    for literal in literals:
        out = out | F.contains(name, F.lit(literal))
    return out


def without_hyphens(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit(""))


def hyphens_to_spaces(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit(" "))


def words_only(name: Column) -> Column:
    """Word characters and white space stay."""
    return F.regexp_replace(name, r"(?U)[^\w\s]", "")


def from_first_bracket(name: Column) -> Column:
    """Text before the first ``[`` goes, unless the name begins with it."""
    return bound(name, lambda n: F.when(F.instr(n, "[") > 1, F.substring(n, F.instr(n, "["), F.length(n))).otherwise(n))


def before_plus(name: Column) -> Column:
    return F.regexp_replace(name, r"(?Us)\s*\+.*$", "")


#: Symbols that comparison drops (fixed values).
DROPPED_SYMBOLS = "・♡❤♥~～！："
#: A file size (fixed value).
SIZE = r"\s*\d+(?:\.\d+)?\s*(?:kb|mb|gb|tb)\s*"
#: Parts that comparison drops, in this order (fixed values): disc numbers, long numeric tags, sizes, patches, extras.
DROPPED_PARTS = [
    r"\b(disc|disk)\s*\d+\b",
    r"\[(\d{7,})\]",
    rf"\[{SIZE}\]",
    r"\b(?:crack|patch|update)\b",
    r"\bmini\s*adv\b",
]


def comparable(name: Column) -> Column:
    """The form in which file names and titles are compared."""
    out = F.lower(before_plus(from_first_bracket(strip(name))))
    out = F.translate(out, DROPPED_SYMBOLS, "")
    for part in DROPPED_PARTS:
        out = F.regexp_replace(out, f"(?U){part}", "")
    return strip(F.regexp_replace(out, r"(?U)[\s\-_.]+", " "))


def search_keyword(title: Column) -> Column:
    """``[date] [first]`` of a title's bracket tags, or what there is of them; else 30 characters before a plus sign.

    The date is the first tag of six digits; longer numbers and sizes are no tags.
    """
    bracketed = lambda x: F.concat(F.lit("["), x, F.lit("]"))

    def keyword(name: Column, tags: Column) -> Column:
        date = F.get(F.filter(tags, lambda t: t.rlike(r"(?U)^\d{6}$")), 0)
        other = F.get(F.filter(tags, lambda t: ~t.rlike(r"(?U)^\d{6,}$") & ~F.lower(t).rlike(f"(?U)^{SIZE}$")), 0)
        # A null stays null in its brackets, and concat_ws leaves it out.
        found = F.concat_ws(" ", bracketed(date), bracketed(other))
        return bound(found, lambda f: F.when(f != "", f).otherwise(F.substring(strip(before_plus(name)), 1, 30)))

    # The name and its tags are each evaluated once.
    tags = lambda name: F.transform(F.regexp_extract_all(name, F.lit(r"\[([^\]]+)\]"), F.lit(1)), strip)
    return bound(from_first_bracket(strip(title)), lambda name: bound(tags(name), lambda t: keyword(name, t)))


def month_tag(date: Column) -> Column:
    """YYMM of a YYYY-MM date."""
    return F.substring(F.replace(date, F.lit("-"), F.lit("")), 3, 100)


def month_text(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))

"""Lenient values: numbers from text, first values in nested JSON, months, paths and run ids."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.sources.shipping import ship_package


#: A number as lenient reading knows it (fixed value): digits with a point or an exponent, between white space.
NUMBER = r"^[ \t\n\r\x0B\f]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0B\f]*$"


def lenient_int(col: Column, default: int = 0) -> Column:
    """The number of a text, cut at its point; null, empty and other texts (``1d``, ``0x1``, ``NaN``) give the default."""
    number = F.when(col.rlike(NUMBER), F.trim(F.translate(col, "\t\n\r\x0b\f", "     ")).try_cast("double").try_cast("long"))
    return F.coalesce(number, F.lit(default).cast("long"))


def month_of(col: Column) -> Column:
    """struct<year, month> of a ``YYYY-M`` text, null if it is none."""
    part = lambda i: F.nullif(F.regexp_extract(col, r"^(\d{4})-(\d{1,2})$", i), F.lit("")).try_cast("int")
    return F.when(col.rlike(r"^\d{4}-\d{1,2}$"), F.struct(part(1).alias("year"), part(2).alias("month")))


def month_shift(date: Column, months: int) -> Column:
    """The YYYY-MM text some months on."""
    return F.date_format(F.add_months(F.to_date(date, "yyyy-MM"), months), "yyyy-MM")


def save_path(root: str, year: Column) -> Column:
    return F.concat(F.lit(f"{root.rstrip('/')}/"), year.cast("string"))


def epoch_seconds(at: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, as status rows carry them."""
    return F.unix_timestamp(at)


def run_id(*parts: Column) -> Column:
    return F.concat_ws(":", *(p.cast("string") for p in parts))


def _first(value, keys: Sequence[str], fits):
    """Depth first: the given keys of an object in their order, then its values; lists item by item."""
    todo = [value]
    while todo:
        item = todo.pop()
        if isinstance(item, dict):
            for k in keys:
                found = fits(item.get(k))
                if found is not None:
                    return found
            item = list(item.values())
        if isinstance(item, list):
            todo += reversed(item)
    return None


def _words(v):
    return v.strip() if isinstance(v, str) and v.strip() else None


def _number(v):
    """Whole numbers of up to 64 bits; larger ones are passed over."""
    if isinstance(v, str) and v.strip().isdecimal() and len(v.strip()) <= 4000:
        v = int(v.strip())
    return int(v) if isinstance(v, int) and -(1 << 63) <= v < 1 << 63 else None


def _loads(raw):
    """The value of a JSON text; malformed text, and text nested too deep for the parser, has none."""
    try:
        return json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None


def first_text(col: Column, keys: Sequence[str]) -> Column:
    """The first non-blank text under any of the keys at any depth of a JSON text; malformed JSON gives null."""
    ship_package()
    keys = list(keys)

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([_first(_loads(x), keys, _words) for x in raw], dtype=object)

    return run(col)


def first_int(col: Column, keys: Sequence[str]) -> Column:
    """The first whole number, or text of digits, under any of the keys at any depth; numbers of more than 64 bits are passed over."""
    ship_package()
    keys = list(keys)

    @F.pandas_udf("long")
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([_first(_loads(x), keys, _number) for x in raw], dtype="Int64")

    return run(col)

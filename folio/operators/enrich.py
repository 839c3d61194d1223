"""Enrichment: the best candidate of each item by tiers, and lookups with a fallback key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(name: Column, month: Column, tags: Sequence[str]) -> Column:
    """1, 2, ... for a tag (in order of preference) with the month, then the month alone, then anything."""
    has_month = F.contains(name, month)
    out = F.lit(len(tags) + 2)
    out = F.when(has_month, F.lit(len(tags) + 1)).otherwise(out)
    for i, tag in reversed(list(enumerate(tags))):
        out = F.when(F.contains(name, F.lit(tag)) & has_month, F.lit(i + 1)).otherwise(out)
    return out


def month_before_tag(name: Column, month: Column, tag: str) -> Column:
    """The tiers of the variant that narrows to the month first, if any candidate has it, and prefers the tag among what is left."""
    has_month, has_tag = F.contains(name, month), F.contains(name, F.lit(tag))
    return F.when(has_month & has_tag, 1).when(has_month, 2).when(has_tag, 3).otherwise(4)


def best_candidates(rows: DataFrame, keys: Sequence[str], tier_col: Column, date: Column, ties: Sequence[str], values: Sequence[str], link: str = "link", last_tier: int | None = None, first: Sequence[str] = ()) -> DataFrame:
    """Per key the candidate with the least ``first`` columns, then of the least tier, newest first (no date last), then by ``ties``; in ``last_tier`` its link is cleared.

    One aggregation with map-side combination: no group is sorted.
    """
    newest = F.struct(*first, F.col("_t"), F.col("_d").isNull(), -F.coalesce("_d", F.lit(0)), *ties)
    marked = rows.withColumns({"_t": tier_col, "_d": F.unix_micros(date.cast("timestamp"))})
    best = marked.groupBy(*keys).agg(F.min_by(F.struct(F.col("_t").alias("tier"), *values), newest).alias("b"))
    out = best.select(*keys, "b.*")
    return out if last_tier is None else out.withColumn(link, F.when(F.col("tier") < last_tier, F.col(link)))


def older_than_month(released: Column, date: Column) -> Column:
    """Whether a release lies before the first day of a YYYY-MM month; null if either is unknown."""
    return released < F.try_to_timestamp(date, F.lit("yyyy-MM"))


def lookup_with_fallback(items: DataFrame, first: DataFrame, second: DataFrame, keys: Sequence[str], fallback_keys: Sequence[str], item: str) -> DataFrame:
    """Inner join on ``keys``; items without any match join ``second`` on ``fallback_keys``.  ``level`` says which."""
    found = items.join(first, list(keys)).withColumn("level", F.lit(1))
    rest = items.join(found.select(item).distinct(), item, "left_anti").join(second, list(fallback_keys)).withColumn("level", F.lit(2))
    return found.unionByName(rest, allowMissingColumns=True)

"""Catalog views: listing, years, latest month, pages and totals.  Filters sit on the date text, so partitions prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.joins import join_by_weight
from folio.operators.ranks import ranked
from folio.sources.staging import staged

PAGE = ["year", "month", "name", "company", "download_url", "match_name", "comment", "downloaded"]


def listing(catalog: DataFrame) -> DataFrame:
    """Rows with year and month texts; ``downloaded`` is never null."""
    return catalog.select(
        F.substring("date", 1, 4).alias("year"),
        F.substring("date", 6, 2).alias("month"),
        "name",
        "company",
        F.col("link").alias("download_url"),
        "match_name",
        "comment",
        F.coalesce("downloaded", F.lit(0)).alias("downloaded"),
        "infohash_hex",
    )


def years(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.substring("date", 1, 4).try_cast("int").alias("year")).distinct().orderBy(F.desc("year"))


def latest_month(catalog: DataFrame) -> DataFrame:
    """One row; nulls for an empty catalog."""
    last = F.max(F.struct(F.substring("date", 1, 4).alias("y"), F.substring("date", 6, 2).alias("m"))).alias("last")
    return catalog.agg(last).select(F.col("last.y").try_cast("int").alias("year"), F.col("last.m").try_cast("int").alias("month"))


def in_month(catalog: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Rows of a year, a month of any year, or both; 0 and None ask for all."""
    if year and month:
        return catalog.where(F.col("date") == f"{year:04d}-{month:02d}")
    if year:
        return catalog.where((F.col("date") >= f"{year:04d}-") & (F.col("date") < f"{year:04d}."))
    if month:
        return catalog.where(F.substring("date", 6, 2).try_cast("int") == month)
    return catalog


def catalog_page(catalog: DataFrame, page: int = 1, year: int | None = None, month: int | None = None, per_page: int = 50) -> DataFrame:
    """A page of the listing, newest month first; names break ties, so pages don't overlap."""
    rows = listing(in_month(catalog, year, month)).withColumns({"year": F.col("year").try_cast("int"), "month": F.col("month").try_cast("int")})
    return rows.select(*PAGE).orderBy(F.desc("year"), F.desc("month"), "name", "company").offset((max(page, 1) - 1) * per_page).limit(per_page)


def totals_by_month(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("date").agg(F.count(F.lit(1)).alias("total"))


def page_count(total: Column, per_page: int = 50) -> Column:
    return F.ceil(total / per_page)


def has_link(link: Column) -> Column:
    """Null and empty both mean that the link is missing."""
    return F.coalesce(link, F.lit("")) != ""


def links_to_check(catalog: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """date, name and link of rows with a link; the month counts only if year and month are both given, and may be written without its zero."""
    rows = catalog
    if year and month:
        number = F.regexp_extract(F.substring("date", 6, 100), r"^\s*([+-]?\d{1,9})", 1).try_cast("int")
        rows = catalog.where((F.col("date") >= f"{year:04d}") & (F.col("date") < f"{year + 1:04d}") & (F.substring("date", 1, 4) == f"{year:04d}") & (number == month))
    return rows.where(has_link(F.col("link"))).select("date", "name", "link")


def missing_links(catalog: DataFrame, year: int, month: int) -> DataFrame:
    return in_month(catalog, year, month).where(~has_link(F.col("link")))


def with_link_uses(df: DataFrame, key: str, link: str, alias: str = "uses") -> DataFrame:
    """``key`` and how many rows share each link that more than one row has; counted before the join, whose rows of a frequent link stay where they are."""
    hashed = df.where(has_link(F.col(link))).select(key, F.xxhash64(link).alias("_h"), F.xxhash64(F.lit(1), link).alias("_g"))
    shared = staged(hashed.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias(alias)).where(F.col(alias) > 1), "shared")
    total = shared.agg(F.coalesce(F.sum(alias), F.lit(0)).alias("n")).first()["n"]
    return join_by_weight(hashed, shared, ["_h", "_g"], alias, total).select(key, alias)


def deep_page(ordered: DataFrame, page: int, per_page: int = 50) -> DataFrame:
    """A page of a table of :func:`with_places`, however far back: a range of places, of which no task reads the rows before."""
    first = (max(page, 1) - 1) * per_page
    return ordered.where((F.col("place") > first) & (F.col("place") <= first + per_page))


def with_places(catalog: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """The listing with each row's ``place``, newest month first, as :func:`catalog_page` orders it; rows equal in all of the order are told apart by their link."""
    rows = listing(in_month(catalog, year, month)).withColumns({"year": F.col("year").try_cast("int"), "month": F.col("month").try_cast("int")})
    return ranked(rows.select(*PAGE), [F.desc("year"), F.desc("month"), F.col("name"), F.col("company"), F.col("download_url")], "place")

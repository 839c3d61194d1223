"""Whole flows: ingest of stored listing pages, enrichment of a catalog, and reports on magnet links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.html import listings
from folio.functions.magnet import parse_magnet, with_mismatch
from folio.functions.text import hyphens_to_spaces, month_tag, without_hyphens, words_only
from folio.operators.catalog import has_link
from folio.operators.changes import insert_counts, insert_or_ignore
from folio.operators.editions import dedup_editions
from folio.operators.enrich import best_candidates, tier
from folio.operators.joins import dealt_rows


def ingest(catalog: DataFrame, pages: DataFrame, skip: Sequence[str] = (), delete: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The catalog with the new items of listing pages (date, html, and where a date has several pages their order ``page``), and one row of counts.

    The run is a success if it fetched anything, whether or not that was new.
    """
    found = listings(pages, list(skip))
    items = dedup_editions(found, delete).withColumn("ordinal", F.length("name"))
    return insert_or_ignore(catalog, items), insert_counts(catalog, items).withColumn("success", F.col("fetched") > 0)


def ingest_months(catalog: DataFrame, pages: DataFrame, skip: Sequence[str] = (), delete: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Like :func:`ingest`, with the counts of each month."""
    items = dedup_editions(listings(pages, list(skip)), delete).withColumn("ordinal", F.length("name"))
    return insert_or_ignore(catalog, items), insert_counts(catalog, items, by=["date"])


def with_search_keys(catalog: DataFrame) -> DataFrame:
    """Adds ``search`` (name without hyphens, and company) and ``relaxed`` (its word characters, and the company with spaces for hyphens)."""
    bare = without_hyphens(F.col("name"))
    return catalog.withColumns({"search": F.concat_ws("+", bare, "company"), "relaxed": F.concat_ws("+", words_only(bare), hyphens_to_spaces(F.col("company")))})


def enrich(catalog: DataFrame, candidates: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """Fills size, link and match_name of rows without a link that have a candidate; all other rows stay as they are.

    ``candidates`` has ``query``, name, link, size, date (timestamp) and ordinal.  The relaxed query
    counts only for items whose own query has no candidate.  Without a candidate of the month the
    newest one is noted without its link.  A row with a null in its key is left alone, too.
    """
    is_open = ~has_link(F.col("link"))
    patch = _chosen(with_search_keys(catalog.where(is_open).select("date", "name", "company")), candidates, tags)
    joined = catalog.select("*", is_open.alias("_open")).join(patch, (F.col("date") == F.col("_date")) & (F.col("name") == F.col("_name")) & F.col("_open"), "left")
    found = F.col("_date").isNotNull()
    return joined.select(*(F.when(found, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in ("size", "link", "match_name") else F.col(c) for c in catalog.columns))


def enrich_months(catalog: DataFrame, candidates: DataFrame, tags: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """:func:`enrich`, and how many records of each month have a candidate now."""
    is_open = catalog.where(~has_link(F.col("link")))
    updated = _chosen(with_search_keys(is_open.select("date", "name", "company")), candidates, tags).where("_date IS NOT NULL AND _name IS NOT NULL")
    return enrich(catalog, candidates, tags), updated.groupBy(F.col("_date").alias("date")).agg(F.count(F.lit(1)).alias("updated"))


def _chosen(keyed: DataFrame, candidates: DataFrame, tags: Sequence[str]) -> DataFrame:
    """The best candidate of each key without nulls that has one; those of both queries are read once, and one of the own query comes first.

    Candidates of a query that very many have are dealt out, whether or not any key asks it.
    """
    queries = F.explode(F.array(F.struct(F.lit(1).alias("level"), F.col("search").alias("query")), F.struct(F.lit(2).alias("level"), F.col("relaxed").alias("query")))).alias("q")
    # Rows with a null in their key are never filled, and without a name all those of a company would ask the same.
    asked = keyed.where("date IS NOT NULL AND name IS NOT NULL").select(F.col("date").alias("_date"), F.col("name").alias("_name"), queries).select("_date", "_name", "q.*")
    c = candidates.where("query IS NOT NULL").select("query", F.col("name").alias("new_match_name"), F.col("link").alias("new_link"), F.col("size").alias("new_size"), F.col("date").alias("released"), "ordinal")
    month = tier(F.col("new_match_name"), month_tag(F.col("_date")), tags)
    counts = c.groupBy("query").agg(F.count(F.lit(1)).alias("uses"))
    return best_candidates(dealt_rows(c, asked, "query", counts, "uses", by="ordinal"), ["_date", "_name"], month, F.col("released"), ["ordinal"], ["new_match_name", "new_link", "new_size"], link="new_link", last_tier=len(tags) + 2, first=["level"])


def answers(requests: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One JSON text per request line (``value``: a JSON object with ``magnet``); a line that is no such object asks for a null link."""
    return magnet_report(requests.select(F.get_json_object("value", "$.magnet").alias("magnet")), metadata)


def magnet_report(requests: DataFrame, metadata: DataFrame | None = None, magnet: str = "magnet") -> DataFrame:
    """One JSON text per request: the parsed link and, where ``metadata`` (rows of parsed files) has its hash or claims it by ``magnet``, the metadata."""
    parsed = requests.select(F.col(magnet).alias("magnet"), parse_magnet(F.col(magnet)).alias("p"))
    out = parsed.select("magnet", "p.*")
    if metadata is None:
        return out.select(F.to_json(F.struct(*out.columns)).alias("value"))
    meta = metadata.select(F.col("magnet").alias("_m"), F.struct("infohash_hex", "name", "total_size", "files").alias("metadata"))
    joined = out.join(meta, out["magnet"] == meta["_m"], "left").drop("_m")
    joined = joined.withColumn("errors", with_mismatch(F.col("errors"), F.col("infohash_hex"), F.col("metadata.infohash_hex")))
    return joined.select(F.to_json(F.struct(*joined.columns)).alias("value"))

"""Verification of all links of a catalog against a file list, resumable by a ledger."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.catalog import links_to_check
from folio.operators.changes import set_downloaded
from folio.operators.match import match_existing, parsed_links
from folio.operators.progress import check_summary
from folio.sources.catalog import KEY
from folio.sources.staging import staged

#: Columns of the ledger: which link of a record was checked against which files, and what came of it.
LEDGER = "date string, name string, link_hash string, snapshot string, exists boolean, confidence string, infohash_hex string, message string"


class Verified(NamedTuple):
    catalog: DataFrame
    ledger: DataFrame
    summary: DataFrame


def snapshot(*tables: DataFrame) -> str:
    """A text that stands for what tables hold, whatever the order of their rows."""
    parts = []
    for df in tables:
        h = [F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in sorted(df.columns))) for seed in (0, 1)]
        # Sums as well, so that a row that comes twice is not the same as none.
        parts += map(str, df.agg(F.count(F.lit(1)), *(F.bit_xor(x) for x in h), *(F.sum(x.cast("decimal(20, 0)")) for x in h)).first())
    return "/".join(parts)


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[c])
    return on


def check_all(catalog: DataFrame, files: DataFrame, tasks: DataFrame, ledger: DataFrame | None = None, *, year: int | None = None, month: int | None = None, folders: DataFrame | None = None, save_path: str | None = None, most_errors: int = 10) -> Verified:
    """The catalog with the found records marked, the ledger after the run, and one row of what the run did.

    Links that the ledger knows as checked against the same files, tasks and folder are not checked again;
    others are, so a run that was broken off, or one with a few new records, does only what is left.
    Marks stay: a record that is not found keeps the mark that it has.  A link that can't be parsed is a
    check without a match and leaves its message in the ledger.  Rows with a null in their key are
    checked but can't be marked.  ``ledger`` is what the run before returned.
    """
    spark = catalog.sparkSession
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    shot = snapshot(files, tasks) if folders is None else f"{snapshot(files, tasks, folders)}|{save_path}"
    links = links_to_check(catalog, year, month).withColumn("link_hash", F.sha2(F.encode("link", "UTF-8"), 256))
    ledger = ledger.hint("merge")  # it has a row for every link, too
    known = ledger.where(F.col("snapshot") == shot).select(*KEY, "link_hash")
    todo = links.join(known, _same(links, known, [*KEY, "link_hash"]), "left_anti")
    # The hint keeps tables of many rows in a small file from being sent through the driver to every task.
    parsed = staged(parsed_links(todo).withColumn("magnet_id", F.monotonically_increasing_id()), "links").hint("merge")
    said = match_existing(parsed.select("magnet_id", "magnet", "dn", "infohash_hex", "errors"), files, tasks, folders=folders, save_path=save_path, most_files=1)
    results = said.select("magnet_id", "exists", "confidence", "message").join(parsed.select("magnet_id", *KEY, "link_hash", "infohash_hex"), "magnet_id")
    results = staged(results.select(*KEY, "link_hash", F.lit(shot).alias("snapshot"), "exists", "confidence", "infohash_hex", "message"), "results").hint("merge")
    marks = results.where("exists").groupBy(*KEY).agg(F.lit(1).alias("new_downloaded"), F.max("infohash_hex").alias("new_infohash_hex"))
    summary = check_summary(results.withColumn("error", F.lit(None).cast("string")), most_errors)
    again = results.select(*KEY).distinct()
    return Verified(set_downloaded(catalog, marks), ledger.join(again, _same(ledger, again, KEY), "left_anti").unionByName(results), summary)

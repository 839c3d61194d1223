"""WARC archives: writing pages with revisit records, and reading by boundary-chain verification.

The reader cuts the files at every occurrence of the record magic, which the text source does in
splits of any size.  Each piece is a candidate: its header gives the offset of its successor.  Pieces
that begin inside a payload are candidates too, so candidates alone prove nothing.  A task follows the
successors inside its split and tells for each candidate where the chain leaves the split.  Pointer
jumping from the start of each archive over these exits, some for each split, finds where the real chain
enters every split, and from there a task marks the records of its split.  Only they are records, and
the pieces between one record and the next are put together again as its payload.  No task holds more
of an archive than a split of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.joins import HEAVY_PART
from folio.sources.shipping import ship_package
from folio.sources.staging import free, scratch_path, staged

MAGIC = "WARC/1.1\r\n"
END, BREAK = "\r\n\r\n", "\r\n"
#: Rows of a key table that may be sent to every task; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
#: Records of one archive at most, as written here; archives of any size are read.
ARCHIVE_RECORDS = 100_000
_CRAWLED = "2000-01-01T00:00:00Z"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(col: Column) -> Column:
    """The SHA-1 of a string's bytes in upper-case base32: 40 bits give ten hexadecimal or eight base32 digits."""
    digits = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *_BASE32)


def _one_line(col: Column) -> Column:
    return F.regexp_replace(col, r"[\r\n]+", " ")


def _records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, payload, digest, ``target`` (id of the response that a revisit points to) and ``revisit``."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    digests = staged(keyed.select("id", "digest"), "digests")
    copied = staged(digests.groupBy("digest").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copied")
    if copied.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = keyed.join(F.broadcast(copied.select("digest", "target")), "digest", "left")
    else:
        # Payloads with very many copies, as the empty one, get their target where they are; the shuffle deals them by their id.
        heavy = F.col("n") > HEAVY_PART * digests.count()
        first = keyed.join(F.broadcast(copied.where(heavy).select("digest", F.col("target").alias("t1"))), "digest", "left")
        key = F.when(F.col("t1").isNull(), F.col("digest")).otherwise(F.xxhash64("id").cast("string"))
        light = copied.where(~heavy).select(F.col("digest").alias("key"), F.col("target").alias("t2"))
        out = first.withColumn("key", key).join(light, "key", "left").withColumn("target", F.coalesce("t1", "t2")).drop("key", "t1", "t2")
    return out.withColumn("revisit", F.col("target").isNotNull() & ~F.col("id").eqNullSafe(F.col("target")))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record per row: of rows with equal payloads, those with the largest id are responses and the others revisits of it.

    A null payload is empty; a null id is smaller than any other (rows of a group without ids are all
    responses); repeated rows are equal records; an empty table gives no record.
    """
    r = _records(pages, id_col, url_col, html_col)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"), F.lit(END))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    head = F.concat_ws(
        BREAK,
        F.concat(F.lit(f"{MAGIC}WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.lit(f"WARC-Date: {_CRAWLED}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("target"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    )
    r = r.select("*", block.alias("block"))
    # The writer's line separator is the end of a record, so each part file is an archive.
    r.select(F.concat(head, F.lit(END), F.col("block")).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, in file order by (file, start of the split, row)."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")


def _parsed(pieces: DataFrame, body: str = "value") -> DataFrame:
    """Header fields, length and payload facts of pieces (or of whole records in ``body``)."""
    split = pieces.withColumn("head", F.substring_index(body, END, 1))
    rest = split.withColumn("rest", F.expr(f"substring({body}, char_length(head) + 5)"))
    block = rest.withColumn("block", F.expr("left(rest, greatest(0, char_length(rest) - 4))"))
    http = block.withColumn("http", F.substring_index("block", END, 1)).withColumn("payload", F.expr("substring(block, char_length(http) + 5)"))
    record = F.nullif(_header("WARC-Type"), F.lit(""))
    length = F.try_to_number(F.nullif(F.regexp_extract("head", r"(?i)(?:^|\r\n)Content-Length:[ \t]*(\d{1,17})(?:\r\n|$)", 1), F.lit("")), F.lit("9" * 17)).cast("long")
    page = lambda field: F.regexp_extract(_header(field), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return http.select(
        *(c for c in ("file", "split", "row", "off") if c in pieces.columns),
        F.octet_length(body).cast("long").alias("size"),
        (F.octet_length("head") + 4 + length + 4).alias("claims"),
        record.alias("record_type"),
        page("WARC-Record-ID").alias("id"),
        page("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_header("WARC-Payload-Digest"), r"^sha1:([A-Z2-7]{32})", 1).alias("claimed_digest"),
        F.regexp_extract("http", r"(?i)Content-Length:[ \t]*(\d{1,17})", 1).try_cast("long").alias("claimed_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("digest"),
    )


def _placed(parsed: DataFrame) -> DataFrame:
    """Adds the offset of each piece and of its successor (-1 if it has no length): sums of whole splits, and running sums inside a split."""
    width = F.col("size") + len(MAGIC)
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    splits = parsed.groupBy("file", "split").agg(F.sum(width).alias("bytes"))  # one row a split
    begins = splits.select("file", "split", F.coalesce(F.sum("bytes").over(earlier("file").orderBy("split")), F.lit(0)).alias("begin"))
    inside = parsed.withColumn("before", F.coalesce(F.sum(width).over(earlier("file", "split").orderBy("row")), F.lit(0)))
    # A piece begins where the magic before it begins; the first of a file is what stands before any magic.
    placed = inside.join(begins, ["file", "split"]).withColumn("off", F.col("begin") + F.col("before") - len(MAGIC)).where("off >= 0")
    return placed.drop("begin", "before").withColumn("after", F.coalesce(F.col("off") + len(MAGIC) + F.col("claims"), F.lit(-1)))


def _steps(off: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted candidates the number of the successor among them, their own where they have none, and whether they have one."""
    at = np.minimum(np.searchsorted(off, after), len(off) - 1)
    inside = (off[at] == after) & (after > off)
    return np.where(inside, at, np.arange(len(off))), inside


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of each candidate of a split leaves the split: the first offset behind its last candidate, or -1 if the chain breaks before."""
    group = group.sort_values("off")
    off, after = group["off"].to_numpy(), group["after"].to_numpy()
    jump, _ = _steps(off, after)
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return pd.DataFrame({"file": group["file"].to_numpy(), "off": off, "next": np.where(after > off[-1], after, -1)[jump]})


def _records_of_split(group: pd.DataFrame) -> pd.DataFrame:
    """Marks what the chain reaches from where it enters the split; ``owner`` is the record that a piece belongs to, -1 if that began before the split."""
    group = group.sort_values("off")
    off, reach = group["off"].to_numpy(), group["entry"].to_numpy(bool)
    jump, _ = _steps(off, group["after"].to_numpy())
    while True:
        grown = reach.copy()
        grown[jump[reach]] = True
        if (grown == reach).all():
            break
        reach, jump = grown, jump[jump]
    owner = np.maximum.accumulate(np.where(reach, off, -1))
    return pd.DataFrame({"file": group["file"].to_numpy(), "split": group["split"].to_numpy(), "row": group["row"].to_numpy(), "off": off, "owner": owner, "reached": reach})


def _entries(placed: DataFrame) -> DataFrame:
    """file, off of the candidates where the chain that begins at offset 0 enters a split; at most a few a split."""
    exits = staged(placed.select("file", "split", "off", "after").groupBy("file", "split").applyInPandas(_exits, "file string, off long, next long"), "exits")
    targets = exits.where("next >= 0").select("file", F.col("next").alias("off")).union(exits.where("off = 0").select("file", "off")).distinct()
    links = staged(exits.join(targets, ["file", "off"]), "links")
    free(exits)
    reached = staged(links.where("off = 0").select("file", "off"), "entries")
    known = reached.count()
    while True:
        step = links.join(reached, ["file", "off"]).select("file", F.col("next").alias("off")).join(links.select("file", "off"), ["file", "off"], "left_semi")
        grown = staged(reached.union(step).distinct(), "entries")
        free(reached)
        reached, before, known = grown, known, grown.count()
        if known == before:
            return reached
        ahead = links.select("file", F.col("off").alias("next"), F.col("next").alias("further"))
        doubled = staged(links.join(ahead, ["file", "next"], "left").select("file", "off", F.coalesce("further", F.lit(-1)).alias("next")), "links")
        free(links)
        links = doubled


def _chain(placed: DataFrame) -> DataFrame:
    """file, row, off, ``owner`` (offset of the record that a piece belongs to), ``reached`` (the piece begins a record)."""
    entries = _entries(placed).withColumn("entry", F.lit(True))
    few = entries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = placed.select("file", "split", "row", "off", "after").join(F.broadcast(entries) if few else entries, ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    chain = staged(marked.groupBy("file", "split").applyInPandas(_records_of_split, "file string, split long, row long, off long, owner long, reached boolean"), "chain")
    # A record that goes on in later splits owns the pieces there up to the next record.
    last = chain.groupBy("file", "split").agg(F.nullif(F.max("owner"), F.lit(-1)).alias("tail"))
    open_record = last.select("file", "split", F.last("tail", True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    return chain.join(open_record, ["file", "split"]).select("file", "row", "off", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("open")).alias("owner"), "reached")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``id``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest``, ``verified``.

    ``verified`` says that the payload read back has the digest and length that its header claims; a
    revisit has the claims of its own headers.  An archive without records gives no rows.  What lies
    behind a broken link of an archive's chain is not read.
    """
    ship_package(spark)
    # Rows are numbered by how files are cut into splits, which another read may do otherwise: the pieces are kept.
    pieces = staged(_pieces(spark, path), "pieces")
    parsed = staged(_parsed(pieces), "candidates")
    placed = staged(_placed(parsed), "placed")
    free(parsed)
    chain = staged(_chain(placed), "chain")
    facts = placed.drop("split", "off").join(chain, ["file", "row"])
    whole = facts.where("reached AND size = claims")
    torn = facts.where("reached AND size <> claims").select("file", F.col("off").alias("owner"))
    columns = ["id", "record_type", "refers_to", "claimed_digest", "claimed_bytes", "payload_bytes", "digest"]
    out = whole.select(*columns)
    if torn.limit(1).count():
        parts = staged(chain.join(torn, ["file", "owner"]).select("file", "row", "owner", "off"), "parts")
        few = parts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        joined = pieces.drop("split").join(F.broadcast(parts) if few else parts, ["file", "row"]).groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
        rebuilt = staged(_parsed(joined.select("file", F.col("owner").alias("off"), "value")), "rebuilt")
        if rebuilt.count() != torn.count():
            raise RuntimeError(f"{path}: {rebuilt.count()} records put together of {torn.count()} that are in pieces")
        out = out.unionByName(rebuilt.select(*columns))
    free(pieces)
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "id",
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("claimed_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("claimed_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        (revisit | ((F.col("digest") == F.col("claimed_digest")) & (F.col("payload_bytes") == F.col("claimed_bytes")))).alias("verified"),
    )


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns for ``pages``, from archives written to the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")

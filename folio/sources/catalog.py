"""The catalog table's schema, its additive evolution, configuration, and stored inputs."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("match_name", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("downloaded", T.IntegerType()),
        T.StructField("infohash_hex", T.StringType()),
    ]
)
KEY = ["date", "name"]
DEFAULTS = {"downloaded": 0}


def evolved(df: DataFrame, schema: T.StructType = CATALOG, defaults: dict | None = None) -> DataFrame:
    """Missing columns are added with their default, else null; others keep their place and values."""
    defaults = DEFAULTS if defaults is None else defaults
    missing = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return evolved(spark.read.parquet(path))


def write_months(catalog: DataFrame, path: str) -> None:
    """Replaces the months that ``catalog`` has, each as one partition; other months stay.

    Rows are dealt by month first, and a large month to several tasks, so each file is of a good size.
    """
    catalog.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_config(path: str) -> dict:
    """A JSON file on the driver; unreadable or malformed files give an empty configuration."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def write_shared_status(spark: SparkSession, path: str, status: dict) -> None:
    """A status object as a JSON file on the cluster's storage, by its own rename: readers see the old file or the new one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, beside = fs_path(path), fs_path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).makeQualified(target).toUri(), conf)
    out = beside.getFileSystem(conf).create(beside, True)
    try:
        out.write(bytearray(json.dumps(status, ensure_ascii=False).encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(beside, target, options)


def write_status(path: str, status: dict) -> None:
    """A status object as a JSON file on the driver.  Readers see the old file or the new one, never a part: it is written beside and then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, beside = tempfile.mkstemp(prefix=".tmp-", dir=target.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(status, f, ensure_ascii=False)
        os.replace(beside, target)
    finally:
        Path(beside).unlink(missing_ok=True)


def read_status(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Status rows (one JSON object a line); a path without files gives no rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def status_rows(lines: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` from JSON objects in ``value``; malformed lines give nulls."""
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("s")).select("s.*")


def read_torrents(spark: SparkSession, path: str) -> DataFrame:
    """path and parsed metadata of every ``.torrent`` file below a folder."""
    from folio.functions.bencode import parse_torrent

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.torrent").option("recursiveFileLookup", "true").load(path)
    return files.select("path", parse_torrent(F.col("content")).alias("meta")).select("path", "meta.*")


def first_torrents(torrents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of rows of :func:`read_torrents`, for each ``infohash_hex`` of ``wanted`` the first file by path that has it; files with an error have none."""
    found = torrents.where("error IS NULL").join(wanted.select("infohash_hex").distinct(), "infohash_hex")
    values = F.struct(*(c for c in torrents.columns if c != "infohash_hex"))
    return found.groupBy("infohash_hex").agg(F.min_by(values, "path").alias("f")).select("infohash_hex", "f.*")


def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))

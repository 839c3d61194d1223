"""Tables that cut lineage, written to the folder shared by driver and executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that exist, in the order of their making.
_made: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = "file://" + tempfile.mkdtemp(prefix="folio-")
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_folio_scratch"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends if not before."""
    folder = f"{scratch_root(spark)}/folio-{uuid.uuid4().hex}"
    _made[folder] = spark
    return f"{folder}/{name}"


def _remove(folder: str) -> None:
    spark = _made.pop(folder, None)
    if spark is None:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter did
        return


@atexit.register
def _remove_all() -> None:
    for folder in list(_made):
        _remove(folder)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: later uses neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_folder = path.rsplit("/", 1)[0]
    return out


def free(*tables: DataFrame) -> None:
    """Removes tables of :func:`staged` that no later action reads."""
    for table in tables:
        _remove(getattr(table, "_folio_folder", ""))


@contextmanager
def scratch() -> Iterator[None]:
    """What is staged inside the block is removed at its end; results that read it must be written by then."""
    before = set(_made)
    try:
        yield
    finally:
        for folder in [f for f in _made if f not in before]:
            _remove(folder)

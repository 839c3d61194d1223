"""Substring search over names by a stored index of their character grams, month by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.match import character_grams
from folio.sources.catalog import KEY


def write_grams(catalog: DataFrame, path: str, months: Sequence[str] | None = None) -> None:
    """Writes the index of the catalog's months, or of ``months`` alone, in place of what the index has of them; other months stay.

    A month's part of the index depends on the month's rows only, so inserts, edits and deletes are kept
    up by writing the months that they touch; a month that has lost all rows leaves a mark without
    names.  Rows are dealt by ranges of month and gram and sorted, so a search reads the files and
    row groups of its grams.  Rows with a null in their key are left out.
    """
    rows = catalog.select(*KEY).where("date IS NOT NULL AND name IS NOT NULL")
    if months is not None:
        rows = rows.where(F.col("date").isin(list(months)))
        marks = catalog.sparkSession.createDataFrame([(m,) for m in months], "date string")
    else:
        marks = rows.select("date").distinct()
    grams = rows.distinct().select(*KEY, F.explode(character_grams(F.col("name"))).alias("gram"))
    both = grams.unionByName(marks.distinct().select("date", F.lit(None).cast("string").alias("name"), F.lit("").alias("gram")))
    both.repartitionByRange("date", "gram", "name").sortWithinPartitions("date", "gram", "name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, gram string, date string").parquet(path)


def names_with(index: DataFrame, part: str) -> DataFrame:
    """date and name of the names that have a text as a part; an empty text is part of all.

    Only the rows of the text's grams are read: those of three characters, or the text itself if it is
    shorter.  A name must have all of them, and the text.
    """
    if not part:
        return index.where("name IS NOT NULL").select(*KEY).distinct()
    size = min(3, len(part))
    wanted = sorted({part[i : i + size] for i in range(len(part) - size + 1)})
    hits = index.where(F.col("gram").isin(wanted)).groupBy(*KEY).agg(F.count_distinct("gram").alias("n"))
    return hits.where((F.col("n") == len(wanted)) & F.contains("name", F.lit(part))).select(*KEY)

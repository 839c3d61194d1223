"""Progress of ingest, enrichment and verification runs, and grids of months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_grid(spark: SparkSession, start_year: int, end_year: int, start_month: int = 1, end_month: int = 12) -> DataFrame:
    """The same months of every year; reversed bounds are swapped, month 0 asks for all twelve."""
    (a, b), (c, d) = sorted((start_year, end_year)), sorted((start_month, end_month))
    if not c:
        c, d = 1, 12
    months = F.explode(F.sequence(F.lit(c), F.lit(d)))
    return spark.range(a, b + 1).select(F.col("id").cast("int").alias("year"), months.alias("month")).withColumn("date", F.format_string("%04d-%02d", "year", "month"))


def month_grid_between(bounds: DataFrame) -> DataFrame:
    """:func:`month_grid` of each row of bounds (start_year, end_year, start_month, end_month), made in the plan; a row with a null gives none."""
    a, b = F.least("start_year", "end_year"), F.greatest("start_year", "end_year")
    c, d = F.least("start_month", "end_month"), F.greatest("start_month", "end_month")
    known = bounds.where("start_year IS NOT NULL AND end_year IS NOT NULL AND start_month IS NOT NULL AND end_month IS NOT NULL")
    months = F.when(c == 0, F.sequence(F.lit(1), F.lit(12))).otherwise(F.sequence(c, d))
    grid = known.select(months.alias("_m"), F.explode(F.sequence(a, b)).alias("year")).select("year", F.explode("_m").alias("month"))
    return grid.select(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).withColumn("date", F.format_string("%04d-%02d", "year", "month"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100, 2)).otherwise(F.lit(0.0))


def counters(rows: DataFrame, group: str, inserted: Column) -> DataFrame:
    """Per group fetched, inserted, skipped, and the share inserted in percent."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(inserted).alias("inserted"))
    return counts.withColumns({"skipped": F.col("fetched") - F.col("inserted"), "progress": percent(F.col("inserted"), F.col("fetched"))})


def run_summary(months: DataFrame, ok: str = "ok") -> DataFrame:
    """One row: finished and total months, and whether all went well."""
    return months.agg(F.count(F.col(ok)).alias("finished_months"), F.count(F.lit(1)).alias("total_months"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("success"))


def check_summary(results: DataFrame, most_errors: int = 10) -> DataFrame:
    """One row of a verification run: checked, found, and the first errors by name.

    The errors come from an ordered limit, so no task or row ever holds more than ``most_errors`` of them.
    """
    none = F.array().cast("array<string>")
    counts = results.agg(F.count(F.lit(1)).alias("checked"), F.count_if("exists").alias("found_downloaded")).withColumn("errors", none)
    first = results.where("error IS NOT NULL").select("error").orderBy("error").limit(most_errors).agg(F.array_sort(F.collect_list("error")).alias("errors"))
    zero = F.lit(0).cast("long")
    both = counts.unionByName(first.select(zero.alias("checked"), zero.alias("found_downloaded"), "errors"))
    return both.agg(F.sum("checked").alias("checked"), F.sum("found_downloaded").alias("found_downloaded"), F.flatten(F.collect_list("errors")).alias("errors"))

"""Places of rows in an order, without one task sorting them all."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.sources.staging import staged

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the place (1, 2, ...) of each row in the order; rows equal in all of ``order`` get neighbouring places.

    Rows are dealt to partitions by range, sorted and numbered inside them; the driver adds up one size
    a partition, and each row's place is its number plus the sizes before.  The numbered rows are kept,
    so a lost task can't deal them differently.  A column called like ``rank`` is replaced.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    numbered = dealt.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.monotonically_increasing_id().alias("at"))
    numbered = staged(numbered.select("row", F.shiftright("at", _ROW_BITS).alias("part"), F.col("at").bitwiseAND((1 << _ROW_BITS) - 1).alias("at")), "ranks")
    sizes = sorted(map(tuple, numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()))
    starts = spark.createDataFrame([(p, n) for (p, _), n in zip(sizes, accumulate([0, *(n for _, n in sizes)]), strict=False)], "part long, before long")
    placed = numbered.join(F.broadcast(starts), "part")
    return placed.select(*(F.col(f"row.`{c}`") for c in df.columns if c != rank), (F.col("before") + F.col("at") + 1).alias(rank))

"""Joins that no frequent key can burden."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has more than this part of all rows; there can be no more heavy keys than its inverse.
HEAVY_PART = 1 / 20_000
#: Rows of a key that are never dealt to several slices.
SLICE_ROWS = 1000
#: Rows of a key that :func:`dealt_rows` leaves together.
DEALT_ROWS = 100_000


def join_by_weight(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Inner join where ``right`` has one row per key and in ``weight`` how many rows ``left`` has of it, ``total`` being all of them.

    Heavy keys are sent to every task, so their rows stay where they are; the others are shuffled.  Null
    keys match nothing.
    """
    keys = list(keys)
    heavy = F.broadcast(right.where(F.col(weight) > HEAVY_PART * total))  # at most 1 / HEAVY_PART rows
    light = right.where(F.col(weight) <= HEAVY_PART * total)
    rest = left.join(F.broadcast(right.where(F.col(weight) > HEAVY_PART * total).select(*keys)), keys, "left_anti")
    return left.join(heavy, keys).unionByName(rest.join(light, keys))


def left_join_by_weight(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Like :func:`join_by_weight`, but every row of ``left`` stays, with nulls where ``right`` has nothing for it."""
    keys = list(keys)
    heavy = F.broadcast(right.where(F.col(weight) > HEAVY_PART * total).withColumn("_heavy", F.lit(True)))  # at most 1 / HEAVY_PART rows
    near = left.join(heavy, keys, "left")
    rest = near.where("_heavy IS NULL").select(*left.columns).join(right.where(F.col(weight) <= HEAVY_PART * total), keys, "left")
    return near.where("_heavy").drop("_heavy").unionByName(rest)


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int, by: str) -> DataFrame:
    """Like :func:`join_by_weight`, for a ``right`` with rows too large to send to every task.

    A heavy key's rows of ``left`` are dealt to slices by a hash of ``by``, and its row of ``right`` goes to each
    slice: one copy for every HEAVY_PART of all rows, and for SLICE_ROWS of them at least.
    """
    keys, each = list(keys), float(max(HEAVY_PART * total, SLICE_ROWS))
    slices = F.ceil(F.col(weight) / each).cast("int")
    heavy = F.broadcast(right.where(F.col(weight) > each).select(*keys, slices.alias("_m")))  # at most 1 / HEAVY_PART rows
    dealt = left.join(heavy, keys, "left").withColumn("_s", F.pmod(F.xxhash64(by), F.coalesce("_m", F.lit(1)))).drop("_m")
    copied = right.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), slices.cast("long") - 1)))
    return dealt.join(copied, [*keys, "_s"]).drop("_s")


def dealt_rows(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, weight: str, by: str) -> DataFrame:
    """Inner join where ``right`` may have many rows of a key, too; ``counts`` has one row per key and in ``weight`` how many rows ``left`` has of it.

    A key's rows of ``left`` beyond DEALT_ROWS are dealt to slices by a hash of ``by``, and its rows of ``right`` go
    to each slice.
    """
    heavy = F.broadcast(counts.where(F.col(weight) > DEALT_ROWS).select(key, F.ceil(F.col(weight) / DEALT_ROWS).cast("int").alias("_m")))  # at most a row for every DEALT_ROWS
    dealt = left.join(heavy, key, "left").withColumn("_s", F.pmod(F.xxhash64(by), F.coalesce("_m", F.lit(1))).cast("int")).drop("_m")
    copied = right.join(heavy, key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_m", F.lit(1)) - 1))).drop("_m")
    return dealt.join(copied, [key, "_s"]).drop("_s")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out by a hash of its rows, so that costly columns made of it keep all tasks busy though its file has few row groups."""
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]  # those have no hash
    # Named, the number of partitions stays: else a small table, however costly its columns, would be put together to one task.
    spark = df.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, F.xxhash64(*hashed))

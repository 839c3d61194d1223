"""Folder trees: paths, and what lies below a folder, by pointer jumping over parent ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.joins import left_join_by_weight
from folio.sources.staging import free, staged


def _jumped(folders: DataFrame, state, joined) -> DataFrame:
    """Folders with what ``joined`` makes of their state and that of the folder they point at, until none points at any.

    Each round doubles how far up a pointer goes, so a tree of depth d takes log d rounds.  A pointer
    at a folder that isn't there ends, and so do those of folders in a circle, after as many rounds as the number of folders has bits.
    """
    at = staged(folders.select(F.col("folder_id").alias("id"), F.nullif("parent_id", "folder_id").alias("next"), state.alias("state")), "folders")
    total = at.count()
    for _ in range(total.bit_length() + 1):
        if not at.where("next IS NOT NULL").limit(1).count():
            break
        uses = at.where("next IS NOT NULL").groupBy("next").agg(F.count(F.lit(1)).alias("uses"))
        above = at.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("state").alias("_state")).join(uses, "next")
        fresh = staged(left_join_by_weight(at, above, ["next"], "uses", total).select("id", F.col("_next").alias("next"), joined(F.col("state"), F.col("_state")).alias("state")), "folders")
        free(at)
        at = fresh
    return at


def folder_paths(folders: DataFrame) -> DataFrame:
    """``folder_id`` and ``path`` (``/a/b``) of each folder (``folder_id``, ``parent_id``, ``name``).

    A folder whose parent is null, itself or not there hangs below the root.  Ids are unique; a row with
    a null id is left out.  Folders in a circle get a path that ends somewhere on it.
    """
    named = folders.where("folder_id IS NOT NULL")
    longer = lambda own, above: F.concat(F.coalesce(above, F.lit("")), own)
    return _jumped(named, F.concat(F.lit("/"), F.coalesce("name", F.lit(""))), longer).select(F.col("id").alias("folder_id"), F.col("state").alias("path"))


def folder_of(folders: DataFrame, path: str):
    """The id of the folder with a path (the least, if several have it); None if there is none."""
    wanted = "/" + path.strip("/")
    return folder_paths(folders).where(F.col("path") == wanted).agg(F.min("folder_id").alias("id")).first()["id"]


def subtree(folders: DataFrame, root) -> DataFrame:
    """``folder_id`` of the root and of all folders below it; of none if the root isn't there."""
    named = folders.where("folder_id IS NOT NULL")
    inside = F.col("folder_id") == F.lit(root)
    return _jumped(named, inside, lambda own, above: own | F.coalesce(above, F.lit(False))).where("state").select(F.col("id").alias("folder_id"))

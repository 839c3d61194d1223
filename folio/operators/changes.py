"""Keyed changes as overlays: each returns a new table; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.catalog import KEY
from folio.sources.staging import staged


def insert_or_ignore(existing: DataFrame, batch: DataFrame, keys: Sequence[str] = KEY, ordinal: str = "ordinal") -> DataFrame:
    """``existing`` and the batch's rows with new keys; the first of a batch's rows with one key counts.

    Keys with a null are never equal to others, so all such rows are inserted.
    """
    columns = [c for c in existing.columns if c in batch.columns]
    null_key = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) == 1
    firsts = batch.where(~null_key).groupBy(*keys).agg(F.min_by(F.struct(*(c for c in columns if c not in keys), F.lit(0).alias("_0")), F.struct(ordinal)).alias("_row"))
    firsts = firsts.select(*keys, *(F.col("_row")[c].alias(c) for c in columns if c not in keys))
    fresh = firsts.join(existing.select(*keys), list(keys), "left_anti").select(*columns)
    return existing.unionByName(fresh, allowMissingColumns=True).unionByName(batch.where(null_key).select(*columns), allowMissingColumns=True)


def insert_counts(existing: DataFrame, batch: DataFrame, keys: Sequence[str] = KEY, by: Sequence[str] = ()) -> DataFrame:
    """One row: fetched, inserted, skipped; or one for each value of the key columns ``by``."""
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(known, list(keys), "left")
    has_null = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) == 1
    inserted = F.when(has_null, F.col("n")).when(F.col("_known").isNull(), 1).otherwise(0)
    return per_key.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"), F.coalesce(F.sum(inserted), F.lit(0)).alias("inserted")).withColumn("skipped", F.col("fetched") - F.col("inserted"))


def _one_patch(patch: DataFrame, fields: Sequence[str], keys: Sequence[str], ordinal: str | None) -> DataFrame:
    """One row per key: of each field the last value that is not null."""
    if ordinal is None:
        last = [F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a key has several patches; their order must be named"))).otherwise(F.first(f"new_{f}")).alias(f"new_{f}") for f in fields]
    else:
        last = [F.max_by(f"new_{f}", F.when(F.col(f"new_{f}").isNotNull(), F.struct(ordinal, f"new_{f}"))).alias(f"new_{f}") for f in fields]
    return patch.groupBy(*keys).agg(*last)


def update_rows(df: DataFrame, patch: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEY, ordinal: str | None = None) -> DataFrame:
    """Each patch row has the keys and ``new_<field>``; null leaves a field as it is, an empty text is a value.

    Several patches of one key apply in the order of ``ordinal`` (equal ordinals by value), as if one
    after the other; without ``ordinal`` they fail the job.  A row of ``df`` stays one row.  Where keys
    are among the fields this may give two rows one key (:func:`checked` raises then);
    :func:`update_outcomes` refuses such patches and says which they are.
    """
    return _updated(df, _one_patch(patch, fields, keys, ordinal), fields, keys)


def _updated(df: DataFrame, one: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    new = one.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(f"new_{f}") for f in fields))
    joined = df.join(new, _equal(df, new, keys), "left")
    return joined.select(*(F.coalesce(F.col(f"new_{c}").cast(df.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))


def _equal(df: DataFrame, new: DataFrame, keys: Sequence[str]):
    on = F.lit(True)
    for k in keys:
        on = on & (df[k] == new[f"_{k}"])
    return on


#: Outcomes of a request.
AFFECTED, NOT_FOUND, COLLISION, EMPTY = "affected", "not_found", "collision", "empty"


def _judged(df: DataFrame, patch: DataFrame, fields: Sequence[str], keys: Sequence[str], ordinal: str | None) -> DataFrame:
    """One row per key of the patch with its fields and ``outcome``, kept.

    ``df`` is read once, for its keys: those that a patch names or wants.  A patch moves its row if it
    names another key than the row's; the first by ``ordinal``, then by key, of those that want a free
    key gets it.
    """
    one = _one_patch(patch, fields, keys, ordinal)
    order = F.struct(*([F.col("_at")] if ordinal else []), *keys)
    if ordinal:
        at = patch.groupBy(*keys).agg(F.min(ordinal).alias("_at"))
        one = one.join(at, _null_safe(one, at, keys)).select(one["*"], "_at")
    wanted = [F.coalesce(F.col(f"new_{k}").cast(df.schema[k].dataType), F.col(k)).alias(f"_to_{k}") if k in fields else F.col(k).alias(f"_to_{k}") for k in keys]
    one = staged(one.select("*", *wanted, order.alias("_order")), "patch")
    own = one.select(*(F.col(k) for k in keys))
    goals = one.select(*(F.col(f"_to_{k}").alias(k) for k in keys))
    held = staged(own.unionByName(goals).distinct().join(df.select(*keys), list(keys), "left_semi"), "held")
    there = held.select(*keys, F.lit(True).alias("_there"))
    taken = held.select(*(F.col(k).alias(f"_to_{k}") for k in keys), F.lit(True).alias("_taken"))
    found = one.join(there, list(keys), "left").join(taken, [f"_to_{k}" for k in keys], "left")
    moves = F.lit(False)
    for k in keys:
        moves = moves | (F.col(k) != F.col(f"_to_{k}"))
    moved = found.withColumns({"_moves": F.coalesce(moves, F.lit(False)) & F.coalesce("_there", F.lit(False))})
    first = moved.where("_moves AND _taken IS NULL").groupBy(*(f"_to_{k}" for k in keys)).agg(F.min("_order").alias("_first"))
    given = F.lit(False)
    for f in fields:
        given = given | F.col(f"new_{f}").isNotNull()
    outcome = F.when(~given, EMPTY).when(F.col("_there").isNull(), NOT_FOUND).when(F.col("_moves") & (F.col("_taken").isNotNull() | (F.col("_order") != F.col("_first"))), COLLISION).otherwise(AFFECTED)
    judged = moved.join(first, [f"_to_{k}" for k in keys], "left").select(*keys, *(f"new_{f}" for f in fields), outcome.alias("outcome"))
    return staged(judged, "judged")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def update_outcomes(df: DataFrame, patch: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEY, ordinal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table of :func:`update_rows` without the patches that are refused, and the patch's rows with what became of each: ``outcome``.

    ``affected``: the row is there and has the values now; ``not_found``: no row has the key (a null in
    it is equal to nothing); ``empty``: no field is given; ``collision``: the patch names a key that
    another row has, or that an earlier patch takes; the whole patch is refused, the row stays as it is.
    A batch is judged against the table as it was before it, so a key that a patch of the batch frees is
    not free yet.  Patches of one key are one patch and share its outcome.
    """
    judged = _judged(df, patch, fields, keys, ordinal)
    table = _updated(df, judged.where(F.col("outcome") == AFFECTED), fields, keys)
    said = judged.select(*(F.col(k).alias(f"_{k}") for k in keys), "outcome")
    on = F.lit(True)
    for k in keys:
        on = on & patch[k].eqNullSafe(said[f"_{k}"])
    return table, patch.join(said, on).select(*(patch[c] for c in patch.columns if c != "outcome"), "outcome")


def delete_outcomes(df: DataFrame, requests: DataFrame, keys: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """The table of :func:`delete_rows`, and the requests with ``outcome``: ``affected`` where a row has gone, else ``not_found``.  Repeated requests share theirs."""
    there = requests.select(*keys).distinct().join(df.select(*keys), list(keys), "left_semi").withColumn("_there", F.lit(True))
    outcome = F.when(F.col("_there"), AFFECTED).otherwise(NOT_FOUND)
    asked = requests.join(there, list(keys), "left").select(*(c for c in requests.columns if c != "outcome"), outcome.alias("outcome"))
    return delete_rows(df, requests, keys), asked


def collisions(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Keys that more than one row has."""
    filled = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) == 0
    return df.where(filled).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def checked(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """``df``, or ValueError if a key occurs twice."""
    if collisions(df, keys).limit(1).count():
        raise ValueError("the change would give two rows the same key")
    return df


def delete_rows(df: DataFrame, keys_df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.join(keys_df.select(*keys), list(keys), "left_anti")


def set_downloaded(df: DataFrame, marks: DataFrame, keys: Sequence[str] = KEY, ordinal: str | None = None) -> DataFrame:
    """Marks have the keys, ``new_downloaded`` and ``new_infohash_hex``; an empty hash leaves the old one."""
    marks = marks.withColumn("new_infohash_hex", F.nullif("new_infohash_hex", F.lit("")))
    return update_rows(df, marks, ["downloaded", "infohash_hex"], keys, ordinal)


#: Fields of an edit that an empty text leaves as they are, and those that it empties.
KEPT_WHEN_EMPTY, EMPTIED = ["date", "name", "company"], ["link", "match_name"]


def edits_as_patch(edits: DataFrame) -> DataFrame:
    """The patch of edit requests: ``date``, ``old_name`` and any of ``new_date``, ``new_name``, ``new_company``, ``new_link``, ``new_match_name``, ``new_downloaded``.

    An empty date, name or company is not supplied; an empty link or match name is a value; a
    ``new_downloaded`` that is not null becomes 0 or 1.  Further columns (an ordinal) stay.
    """
    kept = {f"new_{f}": F.nullif(F.col(f"new_{f}"), F.lit("")) for f in KEPT_WHEN_EMPTY if f"new_{f}" in edits.columns}
    if "new_downloaded" in edits.columns:
        kept["new_downloaded"] = (F.col("new_downloaded") != 0).cast("int")
    return edits.withColumns(kept).withColumnRenamed("old_name", "name")


def edit_rows(df: DataFrame, edits: DataFrame, ordinal: str | None = None) -> DataFrame:
    """``df`` after the edits of :func:`edits_as_patch`; an edit to a key that another row has is refused."""
    return edit_outcomes(df, edits, ordinal)[0]


def edit_outcomes(df: DataFrame, edits: DataFrame, ordinal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` after the edits, and what became of each: see :func:`update_outcomes`."""
    patch = edits_as_patch(edits)
    return update_outcomes(df, patch, [f for f in [*KEPT_WHEN_EMPTY, *EMPTIED, "downloaded"] if f"new_{f}" in patch.columns], KEY, ordinal)

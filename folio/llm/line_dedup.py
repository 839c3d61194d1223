"""Line de-duplication by range-partitioned line hashes, returning keep bitmaps (native: JVM only).

Every line becomes a small row (128 bits of its key, document, position); the text itself stays where it
is.  The rows are range-partitioned by (hash, document) and sorted by document and position inside each
range, so one ordered pass meets the first occurrence of a line in every document, and a line that a
third of all documents share is spread over as many ranges as its rows fill.  The few summaries of a
hash, one per range, are then merged.  What a document gets back is a run-length compressed bitmap of
the lines to keep, and its text is cut by that bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.columns import SPACE_CHARS, ascii_lower, let, sha256_hex, text_or_empty
from folio.operators.joins import join_by_weight
from folio.sources.staging import staged

_DOC = ["_doc", "_s1", "_s2"]
_LINE = ["h1", "h2"]
#: Rows of a key table, and runs of bitmaps, that may be sent to every task; beyond it the join is shuffled.
BROADCAST_ROWS, BROADCAST_RUNS = 200_000, 1_000_000


def _sums(col: Column, *names: str) -> list[Column]:
    """128 bits that stand for a string.  A hash of several values takes each as the seed of the next, so the seed comes first."""
    return [F.xxhash64(*seed, col).alias(n) for n, seed in zip(names, ([], [F.lit(1)]), strict=True)]


def _keep_runs(n: Column, drops: Column) -> Column:
    """The bitmap of ``n`` bits with zeros at the sorted ``drops``, as its runs of ones: array<struct<start, length>>."""

    def runs(ds: Column) -> Column:
        starts = F.filter(ds, lambda x, i: (i == 0) | (F.get(ds, i - 1) != x - 1))
        ends = F.filter(ds, lambda x, i: (i == F.size(ds) - 1) | (F.get(ds, i + 1) != x + 1))
        gaps = F.zip_with(F.concat(F.array(F.lit(-1)), ends), F.concat(starts, F.array(n)), lambda e, s: F.struct((e + 1).alias("start"), (s - e - 1).alias("length")))
        return F.filter(gaps, lambda r: r["length"] > 0)

    return let(drops, runs)


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Documents that lose lines: ``_doc``, ``_s1`` and ``_s2`` (128 bits of the text), and ``keep_runs``, the bitmap of what they keep."""
    text = text_or_empty(text_col)
    split = docs.select(F.col(id_col).alias("_doc"), *_sums(text, "_s1", "_s2"), F.split(text, "\n").alias("_l"))
    lines = (
        split.select(*_DOC, F.size("_l").alias("n"), F.posexplode_outer("_l").alias("pos", "line"))
        .select(*_DOC, "n", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("k"))
        .where(F.char_length("k") >= min_chars)
        .select(*_DOC, "n", "pos", ascii_lower(F.col("k")).alias("k"))
        .select(*_DOC, "n", "pos", *_sums(F.col("k"), *_LINE))
    )
    lines = staged(lines, "line_hashes")
    # One ordered pass over each range: no further exchange stands between the sort and the first occurrence in each document.
    ranged = lines.select(*_LINE, *_DOC, "pos").repartitionByRange(*_LINE, *_DOC)
    by_document = Window.partitionBy(*_LINE, *_DOC).orderBy("pos")
    numbered = ranged.withColumn("nth", F.row_number().over(by_document))
    first = [F.min(F.when(F.col("nth") == 1, F.struct(*_DOC, "pos"))).alias("first")] if keep_first else []
    counts = numbered.groupBy(*_LINE).agg(F.count_if(F.col("nth") == 1).alias("docs"), F.count(F.lit(1)).alias("rows"), *first)
    frequent = staged(counts.where(F.col("docs") >= min_docs), "frequent_lines")
    dropped = _rows_of(lines, frequent)
    if keep_first:
        dropped = dropped.where(~F.struct(*_DOC, "pos").eqNullSafe(F.col("first")))
    return dropped.groupBy(*_DOC).agg(F.max("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("drops")).select(*_DOC, _keep_runs(F.col("n"), F.col("drops")).alias("keep_runs"))


def _rows_of(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of frequent lines.  Few frequent lines go to every task; of many only those with very many rows do, and the others are shuffled."""
    if frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(frequent), _LINE)
    return join_by_weight(lines, frequent, _LINE, "rows", lines.count())


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``n_dropped``, ``keep_runs`` (the bitmap) and ``kept_text``.

    A line is dropped when its key has at least ``min_chars`` code points and occurs in at least
    ``min_docs`` documents; with ``keep_first`` the first occurrence in (id, text hash, position) order
    stays.  A document is a distinct (id, text): rows repeated in full count once and get equal results.
    Lines and texts are told apart by 128 bits of two hashes.  A null or empty text is one empty line; a
    null id is an id like any other; a very long text is one row of as many lines as it has; an empty table gives no rows; of the other columns only
    ``keep_columns`` are read, and returned unless a column of the result has their name.
    """
    marks = staged(keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options).select(F.col("_doc").alias("_d"), F.col("_s1").alias("_m1"), F.col("_s2").alias("_m2"), "keep_runs"), "bitmaps")
    size = marks.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("keep_runs")), F.lit(0)).alias("runs")).first()
    few = size["rows"] <= BROADCAST_ROWS and size["runs"] <= BROADCAST_RUNS  # else the texts are shuffled to their bitmaps
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("_doc"), *_sums(text, "_s1", "_s2"), text.alias("_t"), F.struct(F.lit(0).alias("_0"), *(keep_columns or [])).alias("_more"))
    same = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_s1") == F.col("_m1")) & (F.col("_s2") == F.col("_m2"))
    joined = rows.join(F.broadcast(marks) if few else marks, same, "left")
    split = F.split("_t", "\n")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size(split).alias("length")))
    kept = let(split, lambda ls: F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice(ls, r["start"] + 1, r["length"]))), "\n"))
    keeps = F.aggregate("keep_runs", F.lit(0), lambda n, r: n + r["length"])
    names = [id_col, "n_lines", "n_dropped", "keep_runs", "kept_text"]
    return joined.select(
        F.col("_doc").alias(id_col),
        F.size(split).cast("long").alias("n_lines"),
        F.when(F.col("keep_runs").isNull(), 0).otherwise(F.size(split) - keeps).cast("long").alias("n_dropped"),
        F.coalesce("keep_runs", whole).alias("keep_runs"),
        F.when(F.col("keep_runs").isNull(), F.col("_t")).otherwise(kept).alias("kept_text"),
        *(F.col("_more")[c].alias(c) for c in keep_columns or [] if c not in names),
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))

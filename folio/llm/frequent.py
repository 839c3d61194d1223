"""The most frequent rows of a count table, as a table of bounded size, without sorting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Groups in which rows with equal counts are taken by a hash.
_GROUPS = 4096


def most_frequent(counts: DataFrame, count_col: str, most: int, key: str) -> DataFrame:
    """At most ``most`` rows, those with the highest counts; of rows with the count at the edge those with the least hashes of ``key``.

    The edge comes from histograms: in eighths of powers of two, then by the counts of the eighth in
    which the edge lies, then by groups of a hash.  Each has some hundred rows, or fewer than an eighth
    has different counts, so no task meets the candidates of all others as it would for a sorted limit.
    """
    step, count, group = F.floor(F.log2(count_col) * 8), F.col(count_col), F.pmod(F.xxhash64(key), F.lit(_GROUPS))

    def edge(rows: DataFrame, by: Column, room: int, descending: bool) -> tuple[int | None, int]:
        """The first value that does not fit any more, and the room that is left before it."""
        found = rows.groupBy(by.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(found, key=lambda r: -r["v"] if descending else r["v"]):
            if r["n"] > room:
                return r["v"], room
            room -= r["n"]
        return None, room

    cut, room = edge(counts, step, most, True)
    if cut is None:
        return counts
    at, room = edge(counts.where(step == cut), count, room, True)
    last, _ = edge(counts.where(count == at), group, room, False)
    return counts.where((count > at) | ((count == at) & (group < last)))

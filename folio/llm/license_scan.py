"""License detection by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of those hashes in a set
of templates.  A match at document word i and template word j votes for diagonal i - j; the votes are
counted per document, template and diagonal, neighbouring diagonals are merged, and the spans that gather
enough votes are verified: the words of the template that stand in the span in their order are counted
by a bit-parallel longest common subsequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.arrow_rows import in_chunks
from folio.llm.license_texts import NOTICES
from folio.llm.word_hashes import ALNUM, grams, hash_words
from folio.sources.shipping import ship_package
from folio.sources.staging import staged

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PHRASE_K, NOTICE_K = 2, 4
_SIZES = (PHRASE_K, NOTICE_K)
#: Merged diagonals of a notice lie at most this far apart; a notice needs this share of its votes, and of its words in their order.
NEAR, VOTES, SHARE = 4, 0.3, 0.6
#: Rows of the span table that may be sent to every task.
BROADCAST_DOCS = 200_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _templates(notices: Sequence[tuple[str, str]]) -> list[tuple[str, list[str], int]]:
    """(label, words, size of the grams): the phrases, then the notices of as many words as a gram."""
    own = [(label, WORD.findall(text.translate(_LOWER)), NOTICE_K) for label, text in notices]
    return [(label, text.split(), PHRASE_K) for text, label in PHRASES.items()] + [t for t in own if len(t[1]) >= NOTICE_K]


def _template_grams(templates: list[tuple[str, list[str], int]]) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every k-gram of every template."""
    out = []
    for t, (_, words, k) in enumerate(templates):
        hashes, _ = hash_words([" ".join(words)], ALNUM)
        out += [(int(h), t, j) for j, h in enumerate(grams(hashes, k).view(np.int64))]
    return out


def license_votes(rows: DataFrame, templates: list[tuple[str, list[str], int]]) -> DataFrame:
    """Spans to verify from rows of (id, sum, text): id, sum, ``spans`` array<struct<template, lo, hi>> (range of merged diagonals).

    Each row votes for itself, so rows that repeat have the spans that one of them has.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(_template_grams(templates), "h long, template int, j int")
    key = ["id", "sum", "row"]
    hashed = rows.mapInArrow(_grams_of_rows, "id long, sum long, grams array<long>").withColumn("row", F.monotonically_increasing_id())
    found = hashed.select(*key, F.posexplode("grams").alias("at", "h")).join(F.broadcast(table), "h")  # the templates are fixed
    votes = found.select(*key, "template", (F.floor(F.col("at") / len(_SIZES)).cast("int") - F.col("j")).alias("d"))
    by_diagonal = votes.groupBy(*key, "template", "d").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy(*key, "template").orderBy("d")
    long = F.col("template") >= len(PHRASES)
    begins = F.coalesce(F.col("d") - F.lag("d").over(ordered) > F.when(long, F.lit(NEAR)).otherwise(F.lit(0)), F.lit(True))
    runs = by_diagonal.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(ordered))
    need = F.element_at(F.array(*(F.lit(len(w) - k + 1 if k == PHRASE_K else max(1, int(VOTES * (len(w) - k + 1)))) for _, w, k in templates)), F.col("template") + 1)
    spans = runs.groupBy(*key, "template", "run").agg(F.sum("n").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).where(F.col("n") >= need)
    by_row = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("template", "lo", "hi"))).alias("spans"))
    return by_row.groupBy("id", "sum").agg(F.first("spans").alias("spans"))


def _grams_of_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs() -> Iterator[tuple[tuple[int | None, int], str]]:
        for batch in batches:
            for i, s, t in zip(*(batch.column(c) for c in range(3)), strict=True):
                yield (i.as_py(), s.as_py()), t.as_py() or ""

    # Each word gives one hash of every size, in turn; 0 where the text ends before.
    for chunk in in_chunks(pairs(), 1_000_000):
        hashes, at = hash_words([t for _, t in chunk], ALNUM, lower=True)
        words = np.diff(at)
        own = np.zeros((len(hashes), len(_SIZES)), np.int64)
        left = np.repeat(at[1:], words) - np.arange(len(hashes))  # words from here to the end of the text
        for c, k in enumerate(_SIZES):
            every = grams(hashes, k).view(np.int64)
            own[: len(every), c] = np.where(left[: len(every)] >= k, every, 0)
        lists = pa.ListArray.from_arrays(pa.array(at * len(_SIZES), pa.int32()), pa.array(own.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([i for (i, _), _ in chunk], pa.int64()), pa.array([s for (_, s), _ in chunk], pa.int64()), lists], ["id", "sum", "grams"])


def common_in_order(template: list[str], words: list[str]) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the first and last place in ``words`` of one such subsequence within the shortest prefix.

    Each bit of ``row`` is a template word; a cleared bit is one more word in common.
    """

    def ends(template: list[str], words: Iterable[str]) -> list[int]:
        """The lengths after each word."""
        where: dict[str, int] = {}
        for j, w in enumerate(template):
            where[w] = where.get(w, 0) | 1 << j
        full = (1 << len(template)) - 1
        row, out = full, []
        for w in words:
            hit = row & where.get(w, 0)
            row = (row + hit | row - hit) & full
            out.append(len(template) - row.bit_count())
        return out

    lengths = ends(template, words)
    if not lengths or not lengths[-1]:
        return 0, 0, 0
    last = lengths.index(lengths[-1])
    back = ends(template[::-1], reversed(words[: last + 1]))
    return lengths[-1], last - back.index(lengths[-1]), last


def _verify(text: str, spans: list[dict], templates: list[tuple[str, list[str], int]]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Exact phrase places (start, label), and the notices found: (first word, word behind the last, label, share of the notice's words in order).

    Of two notices where one covers more than half of the other's words, the one with more words found stays.
    """
    words = WORD.findall(text.translate(_LOWER))
    places, found = [], []
    for span in spans:
        label, template, k = templates[span["template"]]
        if k == PHRASE_K:
            at = span["lo"]
            if at >= 0 and words[at : at + len(template)] == template:
                places.append((at, label))
            continue
        lo = max(0, span["lo"])
        n, first, last = common_in_order(template, words[lo : max(lo, span["hi"] + len(template))])
        if n >= SHARE * len(template):
            found.append((n, lo + first, lo + last + 1, label, n / len(template)))
    kept: list[tuple[int, int, str, float]] = []
    for _, a, b, label, share in sorted(found, key=lambda x: (-x[0], x[1], x[3], -x[4])):
        if all(2 * (min(b, d) - max(a, c)) <= min(b - a, d - c) for c, d, _, _ in kept):
            kept.append((a, b, label, share))
    return places, sorted(kept)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``places`` (array<struct<start, label>>), ``spans`` (array<struct<start, end, label, share>>).

    ``places`` are those of the fixed phrases.  ``spans`` are the notices found, (label, text) pairs of
    ``notices``, which go to every task: ``start`` is the first word, ``end`` the word behind the last,
    and ``share`` the share of the notice's words that stand there in order.  A null or empty text has no
    words; null ids and repeated rows pass through; an empty table gives no rows; only the two named
    columns are read; notices of fewer than four words are left out.
    """
    templates = _templates(notices)
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("sum"), text.alias("text"))
    spans = staged(license_votes(rows, templates).select(F.col("id").alias("_i"), F.col("sum").alias("_s"), "spans"), "license_spans")
    few = spans.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS  # else a shuffled join
    joined = rows.join(F.broadcast(spans) if few else spans, F.col("id").eqNullSafe(F.col("_i")) & (F.col("sum") == F.col("_s")), "left")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], 0
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts: list[int] = []
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 1_000_000:
                    size += len(texts[end])
                    end += 1
                raw = hash_words(texts[at:end], ALNUM, lower=True)[1]
                counts += np.diff(raw).tolist()
                at = end
            for i, t, spans_of, n in zip(batch.column("id").to_pylist(), texts, batch.column("spans").to_pylist(), counts, strict=True):
                places, notices_of = _verify(t, spans_of, templates) if spans_of else ([], [])
                out.append((i, n, [{"start": a, "label": b} for a, b in sorted(places)], [dict(zip(("start", "end", "label", "share"), x, strict=True)) for x in notices_of]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(_OUT)], ["id", "n_words", "places", "spans"])

    return joined.select("id", "text", "spans").mapInArrow(check, "id long, n_words long, places array<struct<start: long, label: string>>, spans array<struct<start: long, end: long, label: string, share: double>>").withColumnRenamed("id", id_col)


_OUT = [
    pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())])),
]


def license_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``; ``score`` is the largest share of a template found, 1 for a phrase."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("spans", lambda x: x["label"]))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0))).alias("score"),
        F.array_join(F.transform("spans", lambda x: F.format_string("%s:%d-%d", x["label"], x["start"], x["end"])), ",").alias("notices"),
    )

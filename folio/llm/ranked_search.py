"""Ranked lexical search: the best documents of each item, term at a time, with limited accumulators.

Documents are cut into words once and kept as an index of the items' terms only (term numbers and how
often each occurs).  Tasks take the index a block of documents at a time, turn the block into posting
lists, and go through each item's terms, rarest first, adding to one accumulator a document.  Let the
bound of a term be the most it adds to any document of the block.  Once the bounds of the terms that are
left sum to less than the k-th best score so far, no document without an accumulator can get among the
best, and none is created any more; accumulators that can't reach that score either are dropped, and the
rest are updated exactly.  A task keeps the k best of each item over its blocks, so that later blocks
stop sooner; its best rows, at most k an item, are merged with those of the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.arrow_rows import text_rows
from folio.llm.word_pieces import word_pieces
from folio.sources.shipping import ship_package
from folio.sources.staging import staged

#: Terms of the items that are sent to the tasks at a time, repeats between items included; more items make more blocks of items.
ITEM_TERMS = 200_000
#: Documents and postings of a block of documents.
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 500_000
#: Groups in which an item's best rows of all tasks are merged before the last merge.
MERGE = 64
_NO_ID = np.iinfo(np.int64).max


def _index(vocabulary: dict[bytes, int]):
    """Rows (id, n, terms, times) of the documents with a word: how many words it has, and which terms how often."""
    size = len(vocabulary)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, terms, times = [], [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in terms])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "times"])

        for i, text in text_rows(batches):
            n, found, often = 0, np.empty(0, np.int64), np.empty(0, np.int64)
            for piece in word_pieces(text):
                n += len(piece)
                own = np.fromiter(map(vocabulary.get, piece, repeat(size)), np.int64, len(piece))
                own, count = np.unique(own[own < size], return_counts=True)
                if len(found):  # a further piece of a long text
                    own, place = np.unique(np.concatenate([found, own]), return_inverse=True)
                    count = np.bincount(place, np.concatenate([often, count])).astype(np.int64)
                found, often = own, count
            if not n:
                continue
            ids.append(i), lengths.append(n), terms.append(found), times.append(often)
            held += len(found)
            if len(ids) == 1024 or held > 100_000:
                yield out()
                ids, lengths, terms, times, held = [], [], [], [], 0
        if ids:
            yield out()

    return rows


class _Block:
    """Posting lists of a block of documents: per term its documents (ascending) and what one occurrence in the item adds."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, n_docs: int, n_words: int):
        doc = np.repeat(np.arange(len(lengths)), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs, times, terms = doc[order], times[order], terms[order]
        damp = np.array([100 - 25 + 25 * int(n) * n_docs // n_words for n in lengths], np.int64)
        self.adds = (1_000_000_000 * times) // (1000 * times + 12 * damp[self.docs])
        own, starts = np.unique(terms, return_index=True)
        self.place = {int(t): (int(a), int(b)) for t, a, b in zip(own, starts, [*starts[1:], len(terms)], strict=True)}
        self.most = dict(zip(map(int, own), map(int, np.maximum.reduceat(self.adds, starts) if len(own) else []), strict=True))
        self.sums = np.zeros(len(lengths), np.int64)

    def best(self, terms: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block, with their exact scores, among which are all that have a place among the ``k`` best if only scores of ``least`` or more count.

        ``terms`` are (term, weight times occurrences in the item), rarest first.
        """
        here = [(t, w) for t, w in terms if w and t in self.place]
        bounds = [w * self.most[t] for t, w in here]
        left = np.cumsum(bounds[::-1])[::-1].tolist() if bounds else []
        sums, at, check = self.sums, 0, 1
        sums[:] = 0
        while at < len(here) and left[at] >= least:  # creating
            t, w = here[at]
            a, b = self.place[t]
            sums[self.docs[a:b]] += w * self.adds[a:b]
            at += 1
            if at == check and at < len(here) and len(sums) > k:  # the k-th best so far, looked for ever more rarely
                least = max(least, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
                check = at + max(1, at // 4)
        rest = left[at] if at < len(here) else 0
        alive = np.flatnonzero(sums >= max(least - rest, 1))
        scores = sums[alive]
        for t, w in here[at:]:  # updating
            a, b = self.place[t]
            docs = self.docs[a:b]
            place = np.searchsorted(docs, alive)
            place[place == len(docs)] = 0
            hit = docs[place] == alive
            scores[hit] += w * self.adds[a + place[hit]]
        keep = scores >= max(least, 1)
        return alive[keep], scores[keep]


def _search(items: list[tuple[int, list[tuple[int, int]]]], n_docs: int, n_words: int, k: int):
    """Rows (item, id, score): at most ``k`` of each item that a task's documents have."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = {item: (none, none) for item, _ in items}  # scores, ids

        def take(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["id"].fill_null(_NO_ID).to_numpy()
            lists = table["terms"].combine_chunks() if table.num_rows else None
            sizes = np.diff(lists.offsets.to_numpy())
            block = _Block(table["n"].to_numpy(), sizes, lists.flatten().to_numpy(), table["times"].combine_chunks().flatten().to_numpy(), n_docs, n_words)
            for item, terms in items:
                scores, docs = best[item]
                found, new = block.best(terms, k, int(scores[-1]) if len(scores) == k else 1)
                if len(found):
                    scores, docs = np.concatenate([scores, new]), np.concatenate([docs, ids[found]])
                    order = np.lexsort((docs, -scores))[:k]
                    best[item] = scores[order], docs[order]

        held, n, size = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                n, size = n + part.num_rows, size + len(part.column(2).flatten())
                if n >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    take(held)
                    held, n, size = [], 0, 0
        if held:
            take(held)
        some = [(np.full(len(s), item), d, s) for item, (s, d) in best.items() if len(s)]
        if some:
            item, docs, scores = (np.concatenate(x) for x in zip(*some, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(docs, pa.int64(), mask=docs == _NO_ID), pa.array(scores, pa.int64())], ["item", "id", "score"])

    return rows


def term_weight(n_docs: int, df: int) -> int:
    """Thousandths of the logarithm of how rare a term is, rounded down; never below 0."""
    return math.floor(1000 * math.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0)))


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times), kept; ``item`` numbers the rows, so repeated rows are items of their own."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, text in text_rows(batches):
            for piece in word_pieces(text):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(piece), pa.int64()), pa.array(piece, pa.binary()).cast(pa.string())], ["item", "term"])

    rows = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col(text_col).cast("string").alias("text"), F.col(item_col).alias("item_id")), "items")
    terms = rows.select("item", "text").mapInArrow(cut, "item long, term string").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    return staged(terms.join(rows.select("item", "item_id"), "item"), "terms")


def top_documents(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """``item_id``, ``rank`` (1 to ``k``), ``doc_id``, ``score``: each item's best documents, equal scores by id.

    A document's score sums, over the item's terms with their repeats, the term's weight times its
    saturated frequency in the document, damped by the document's length.  Only scores above 0 count, so
    an item without terms, or a table without documents, gives no rows.  Null texts have no terms.
    Repeated rows of either table are documents and items of their own; null ids come last among equal
    scores.  Very long texts are cut piece by piece.  Columns other than those named are not read, so
    their names don't matter.

    Items go to the tasks in blocks of about ``item_terms`` terms, each a pass over the documents, so
    what is sent does not grow with the items; an item is in one block.
    """
    ship_package(docs.sparkSession)
    terms = _item_terms(items, item_col, item_text)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n_blocks = max(1, -(-terms.count() // item_terms))
    found = None
    for block in range(n_blocks):
        own = [(r["item"], r["term"].encode(), r["times"]) for r in terms.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).select("item", "term", "times").toLocalIterator()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, t, _ in own}))}
        index = staged(texts.mapInArrow(_index(vocabulary), "id long, n long, terms array<int>, times array<long>"), "index")
        whole = index.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words")).first()
        df = {r["term"]: r["df"] for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # at most the block's vocabulary
        by_item: dict[int, list[tuple[int, int]]] = {}
        for item, term, times in own:
            if (number := vocabulary[term]) in df:
                by_item.setdefault(item, []).append((number, times * term_weight(whole["n_docs"], df[number])))
        rarest_first = [(item, sorted(own_terms, key=lambda x: (df[x[0]], x[0]))) for item, own_terms in sorted(by_item.items())]
        rows = index.select("id", "n", "terms", "times").mapInArrow(_search(rarest_first, whole["n_docs"], whole["n_words"], k), "item long, id long, score long")
        rows = staged(rows, "best") if n_blocks > 1 else rows
        found = rows if found is None else found.unionByName(rows)
    return _merged(found, terms.groupBy("item").agg(F.first("item_id").alias("item_id")), k, id_col, item_col)


def _merged(found: DataFrame, items: DataFrame, k: int, id_col: str, item_col: str) -> DataFrame:
    """The ``k`` best of each item of all tasks' rows, first in groups, so that no task meets an item's rows of all tasks."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(MERGE)))
    parts = parts.withColumn("place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("place") <= k).drop("place", "part")
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(items, "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")

"""Token counts under a piece (sentencepiece) model, without materialising ids.

No piece of the model spans the place before a word mark that follows another character, nor a line
feed, so those places cut a text into pre-tokens whose pieces can be counted apart.  Each distinct
pre-token is counted once; the counts are joined to the pre-token frequencies of each document and
summed.  The most frequent pre-tokens, a table of bounded size, are joined on the map side, which
leaves only the rare ones to be shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow_rows import in_chunks, row_numbers, text_rows
from folio.llm.frequent import most_frequent
from folio.sources.shipping import ship_package
from folio.sources.staging import staged

#: Bound of the table that is sent to every task: entries, and characters of each key.
HOT_ENTRIES, KEY_CHARS = 1 << 18, 64
_MARK = "▁"
_PRETOKEN = re.compile(r" *[^ \n]+| +|\n")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
        raise ValueError("a piece spans a word mark or a line feed; pre-tokens can't be counted apart")
    return model


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text with the leading word mark that the model adds; the empty text has none."""
    return _PRETOKEN.findall(" " + text.replace(_MARK, " ")) if text else []


def key_of(piece: str) -> str:
    """The pre-token, or if it is long a line feed (no other pre-token begins with one) and 128 bits that stand for it."""
    return piece if len(piece) <= KEY_CHARS else "\n" + hashlib.blake2b(piece.encode(), digest_size=16).hexdigest()


def count_pieces(model, pieces: list[str]) -> list[int]:
    """Pieces of each pre-token; behind a line feed the model adds no word mark of its own to it."""
    return [len(ids) - 2 for ids in model.encode(["\n" + p for p in pieces], num_threads=1)]


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``.

    ``model_path`` is at the same place on every machine.  A null or empty text has no tokens; null
    ids and repeated rows are rows of their own; an empty table gives no rows; only the two named
    columns are read.  Pre-tokens of more than KEY_CHARS characters are told apart by 128 bits.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for chunk in in_chunks(text_rows(batches)):
            for _, text in chunk:
                seen.update(pretokens(text))
            if len(seen) > 400_000:
                yield _count_batch(seen)
                seen = Counter()
        yield _count_batch(seen)

    def pieces_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                pieces = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(map(key_of, pieces), pa.string()), part.column(1), pa.array(count_pieces(model, pieces), pa.int64())], ["key", "freq", "tokens"])

    found = rows.mapInArrow(distinct, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    counts = staged(found.mapInArrow(pieces_of, "key string, freq long, tokens long"), "pretoken_counts")
    hot = most_frequent(counts, "freq", hot_entries, "key").select("key", "tokens").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(hot["key"].to_pylist(), hot["tokens"].to_pylist(), strict=True)))

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_tokens, numbers = sent.value, row_numbers()
        for chunk in in_chunks(text_rows(batches)):
            out = []
            for i, text in chunk:
                total, rare = 0, Counter()
                for piece, n in Counter(pretokens(text)).items():
                    key = piece if len(piece) <= KEY_CHARS else key_of(piece)
                    known = hot_tokens.get(key)
                    if known is None:
                        rare[key] = n
                    else:
                        total += n * known
                out.append((next(numbers), i, len(text.encode()), total, list(rare), list(rare.values())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FREQ_TYPES, strict=True)], _FREQ_NAMES)

    freq = staged(rows.mapInArrow(frequencies, "row long, id long, n_bytes long, tokens long, rare array<string>, n array<long>"), "pretoken_frequencies")
    tail = freq.select("row", F.explode(F.arrays_zip("rare", "n")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.n").alias("n"))
    rare_sums = tail.join(counts.select("key", F.col("tokens").alias("each")), "key").select("row", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n_bytes"), (F.col("n") * F.col("each")).alias("tokens"))
    sums = freq.select("row", "id", "n_bytes", "tokens").unionByName(rare_sums).groupBy("row").agg(F.max("id").alias(id_col), F.sum("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return sums.drop("row")


_FREQ_NAMES = ["row", "id", "n_bytes", "tokens", "rare", "n"]
_FREQ_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]


def _count_batch(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "freq"])


def token_count_digest(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """The contract's columns for ``documents``."""
    return token_counts(docs, model_path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

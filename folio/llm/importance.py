"""Importance resampling towards a target corpus, by bit-sliced sums over hashed n-gram counts.

A text's features (runs of one to three words) fall into 10,000 buckets by their CRC-32.  Its bucket
counts are kept as bit planes: plane j has the bit of every bucket whose count has bit j set.  The
buckets' gains, logarithms of how much likelier a bucket is in the target, are planes of their
magnitude's bits too, apart for both signs.  A text's weight, the sum of gain times count, is then the
sum of ``2 ** (j + k)`` times the number of bits that count plane j and gain plane k share: whole
numbers throughout, so it is exact and does not depend on any order.

Texts are cut into words once: the planes are kept, with the sums of each task's counts, from which the
gains come.  What a task holds beside a text is a piece of it and a bounded memo of words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow_rows import text_rows
from folio.llm.word_pieces import word_pieces
from folio.operators.ranks import ranked
from folio.sources.shipping import ship_package
from folio.sources.staging import staged

BUCKETS = 10_000
#: Bytes of a plane: whole 64-bit words.
PLANE = -(-BUCKETS // 64) * 8
#: Distinct words, and word lengths, whose checksums are remembered.
MEMO_WORDS, MEMO_LENGTHS = 200_000, 1024
#: Texts whose planes are cut at a time.
SLICE = 32
_ONES = 0xFFFFFFFF


@lru_cache(maxsize=MEMO_LENGTHS)
def _shift_table(n: int) -> np.ndarray:
    """By byte of a checksum, what ``n`` further bytes make of it before their own checksum is added."""
    basis = [zlib.crc32(bytes(n), (1 << i) ^ _ONES) ^ _ONES for i in range(32)]
    table, values = np.zeros((4, 256), np.uint32), np.arange(256)
    for i, b in enumerate(basis):
        table[i // 8] ^= np.where(values >> i % 8 & 1, np.uint32(b), np.uint32(0))
    return table


class _Words(dict):
    """Numbers of words, with the checksum of each, that of a space and the word, and which table shifts past those."""

    def __init__(self, room: int):
        self.own, self.spaced, self.kind = np.zeros(room, np.uint32), np.zeros(room, np.uint32), np.zeros(room, np.int32)
        self.lengths: dict[int, int] = {}
        self.stack = np.empty((0, 4, 256), np.uint32)

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.own[code], self.spaced[code] = zlib.crc32(word), zlib.crc32(word, zlib.crc32(b" "))
        self.kind[code] = self.lengths.setdefault(len(word) + 1, len(self.lengths))
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > len(self.own):
            room = len(self) + len(words)
            self.own, self.spaced, self.kind = (np.concatenate([a, np.zeros(room - len(a), a.dtype)]) for a in (self.own, self.spaced, self.kind))
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.stack) < len(self.lengths):
            self.stack = np.stack([_shift_table(n) for n in self.lengths])
        return out

    def followed(self, sums: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Checksums of texts with the checksums ``sums``, a space and the words ``codes``."""
        kind, table = self.kind[codes], self.stack
        out = self.spaced[codes].copy()
        for i in range(4):
            out ^= table[kind, i, sums >> np.uint32(8 * i) & np.uint32(255)]
        return out


def bucket_counts(text: str | None, words: _Words) -> tuple[int, np.ndarray]:
    """The number of a text's words, and its feature counts by bucket."""
    n, counts, last = 0, np.zeros(BUCKETS, np.int64), []
    for piece in word_pieces(text):
        if len(words) > MEMO_WORDS or len(words.lengths) > MEMO_LENGTHS:
            words.__init__(MEMO_WORDS)
            words.clear()
        n += len(piece)
        codes = words.codes(last + piece)  # with the two words before the piece
        one = words.own[codes]
        two = words.followed(one[:-1], codes[1:])
        three = words.followed(two[:-1], codes[2:])
        for sums, before in ((one, len(last)), (two, len(last) - 1), (three, len(last) - 2)):
            counts += np.bincount(sums[max(before, 0) :] % BUCKETS, minlength=BUCKETS)
        last = (last + piece)[-2:]
    return n, counts


def count_planes(counts: np.ndarray) -> list[bytes]:
    """The bit planes of each row of a count matrix, lowest bit first, one after the other; none for a row of zeros."""
    most = counts.max(axis=1, initial=0)
    padded = np.zeros((len(counts), PLANE * 8), np.int64)
    padded[:, : counts.shape[1]] = counts
    planes = [np.packbits((padded >> j & 1).astype(np.uint8), axis=1, bitorder="little") for j in range(int(most.max(initial=0)).bit_length())]
    return [b"".join(planes[j][i].tobytes() for j in range(int(m).bit_length())) for i, m in enumerate(most)]


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(factor, plane) of the signed gains: plus or minus a power of two, and the buckets it counts for."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gains, 0)
        for k in range(int(size.max(initial=0)).bit_length()):
            out.append((sign << k, np.frombuffer(count_planes((size >> k & 1)[None, :])[0] or bytes(PLANE), np.uint64)))
    return out


def plane_weights(planes: list[bytes], gains: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The weight of each text from its planes."""
    n_planes = np.array([len(p) // PLANE for p in planes], np.int64)
    rows = np.frombuffer(b"".join(planes), np.uint64).reshape(-1, PLANE // 8)
    sums = np.zeros(len(rows), np.int64)
    for factor, plane in gains:
        sums += factor * np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64)
    ends = np.cumsum(n_planes)
    place = np.arange(len(rows)) - np.repeat(ends - n_planes, n_planes)
    total = np.concatenate([[0], np.cumsum(sums << place)])
    return total[ends] - total[ends - n_planes]


def _planes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, total = _Words(MEMO_WORDS), np.zeros(BUCKETS, np.int64)
    waiting: list[tuple] = []

    def out() -> pa.RecordBatch:
        counts = np.stack([c for _, _, c in waiting])
        grams = [max(n, 0) + max(n - 1, 0) + max(n - 2, 0) for _, n, _ in waiting]
        arrays = [pa.array([i for i, _, _ in waiting], pa.int64()), pa.array([n for _, n, _ in waiting], pa.int64()), pa.array(grams, pa.int64()), pa.array(count_planes(counts), pa.binary()), pa.nulls(len(waiting), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_features", "planes", "sums"])

    for i, text in text_rows(batches):
        n, counts = bucket_counts(text, words)
        total += counts
        waiting.append((i, n, counts))
        if len(waiting) == SLICE:
            yield out()
            waiting = []
    if waiting:
        yield out()
    # One row a task holds the sums of its texts; it has no planes.
    row = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tolist()], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(row, ["id", "n_words", "n_features", "planes", "sums"])


def _counted(df: DataFrame, id_col: Column, text_col: str) -> DataFrame:
    rows = df.select(id_col.cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.mapInArrow(_planes, "id long, n_words long, n_features long, planes binary, sums array<long>"), "planes")


def _sums(counted: DataFrame) -> np.ndarray:
    """All counts by bucket: as many rows as there are buckets, whatever the corpus."""
    sums = counted.where("sums IS NOT NULL").select(F.posexplode("sums").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share of the target over that of the corpus, rounded down."""
    s, t = float(corpus.sum()), float(target.sum())
    ratio = lambda own, goal: ((goal + 1.0) * (s + BUCKETS)) / ((own + 1.0) * (t + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(float(a), float(b)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_features``, ``weight``, how much likelier the text is in the target.

    A null or empty text has no features and weight 0; repeated rows count in the corpus as often as
    they occur and get equal rows; a very long text is read in pieces; an empty table gives an empty one
    and an empty target the gains of its smoothing.  Other columns are not read, so their names don't matter.
    """
    ship_package(docs.sparkSession)
    counted = _counted(docs, F.col(id_col), text_col)
    gains = gain_planes(bucket_gains(_sums(counted), _sums(_counted(target, F.lit(None), target_col))))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                weights = plane_weights(part.column(3).to_pylist(), gains)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(weights, pa.int64())], ["id", "n_words", "n_features", "weight"])

    texts = counted.where("planes IS NOT NULL").select("id", "n_words", "n_features", "planes")
    return texts.mapInArrow(weigh, "id long, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate, rounded down, that a hash of the id draws; a null id is the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("", F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_features``, ``weight``, ``score`` (weight plus a Gumbel variate) and ``rank``.

    ``rank`` numbers the ``percent`` of the texts with ``min_words`` words or more that are drawn, best
    score first, equal scores by id (null ids last); the others have none.  Drawing the highest of such
    scores is drawing without replacement in proportion to the exponential of the weights.
    """
    weighed = importance_weights(docs, target, id_col=id_col, text_col=text_col, target_col=target_col)
    scored = staged(weighed.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)), "weights")
    fits = F.col("n_words") >= min_words
    drawn = percent * scored.where(fits).count() // 100
    placed = ranked(scored.withColumn("fits", fits), [F.desc("fits"), F.desc("score"), F.asc_nulls_last(id_col)], "place")
    return placed.select(id_col, "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))

"""A hidden Markov language model: distributed Baum-Welch, exact likelihood by the scaled forward recursion.

States emit symbols.  The most frequent words are symbols of their own; every other word belongs to a
class given by its last bytes, and its probability is the class's times its smoothed share of the
class.  With as many symbols as there are words no word needs a class.  Training passes over all training
texts: tasks run forward-backward and emit expected counts, Spark sums them, and the driver holds only
the model, whose size is fixed.  The base score is an additively smoothed unigram.

Long texts are cut into segments so that a task holds no more than a block of tokens, and nothing is
forgotten where they are cut: the product of a segment's transitions and emissions is a matrix of states
by states; these matrices carry the forward and backward probabilities of the whole text to the ends of
every segment, and the counts of the segments, with those of the moves between them, are the text's.

Word counts: the most frequent words, a table of bounded size, are looked up on the map side; the rare
ones are shuffled to the whole count table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow_rows import row_numbers
from folio.llm.frequent import most_frequent
from folio.sources.shipping import ship_package
from folio.sources.staging import staged

#: Words looked up on the map side (more, if more have symbols of their own); bytes of a word's key; bytes of a text whose words are held at a time.
HOT_WORDS, KEY_BYTES, PIECE_BYTES = 1 << 18, 64, 1 << 20
#: Words with symbols of their own, classes of all others, and by how many last bytes.
OWN_SYMBOLS, CLASSES, TAIL_BYTES = 8192, 2048, 3
STATES, ITERATIONS = 8, 5
#: Longer texts are cut: in training, in scoring.  The results don't depend on it.
SEGMENT, SCORED_SEGMENT = 1024, 8192
_END = b""  # no word is empty
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """UTF-8 words between white space (U+0020, U+0009 to U+000D), A-Z in lower case, then the end; some at a time."""
    raw, at = (text or "").encode().translate(_LOWER), 0
    while len(raw) - at > PIECE_BYTES and (cut := _SPACE.search(raw, at + PIECE_BYTES)):
        yield raw[at : cut.start()].split()
        at = cut.end()
    yield [*raw[at:].split(), _END]


def key_of(word: bytes) -> bytes:
    """The word, or if it is long a space (no word has one), 128 bits that stand for it, and its last bytes."""
    return word if len(word) <= KEY_BYTES else b" " + (blake2b(word, digest_size=16).hexdigest() + word[-8:].hex()).encode()


def keys_of(words: list[bytes]) -> list[bytes]:
    return [w if len(w) <= KEY_BYTES else key_of(w) for w in words]


@dataclass(frozen=True)
class Symbols:
    """How words become symbols: ``own`` ones for the most frequent, then ``classes``."""

    own: int = OWN_SYMBOLS
    classes: int = CLASSES
    tail_bytes: int = TAIL_BYTES

    @property
    def size(self) -> int:
        return self.own + self.classes

    @property
    def dtype(self) -> type:
        return np.uint16 if self.size <= 1 << 16 else np.uint32

    def class_of(self, key: bytes) -> int:
        tail = bytes.fromhex(key[33:].decode()) if key[:1] == b" " else key
        return self.own + zlib.crc32(tail[-self.tail_bytes :]) % self.classes


def held_out(id_col: str):
    """A tenth of the documents by a checksum of the id; a null id counts as the empty text and is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


@dataclass
class Model:
    """Natural probabilities; rows of ``emit`` are symbols, its columns states."""

    start: np.ndarray  # of a text's first token
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(unigram: np.ndarray, states: int) -> Model:
        """Unigram emissions, bent differently for each state; states tend to stay."""
        noise = np.random.default_rng(7).normal(0, 0.7, (len(unigram), states))
        emit = (unigram[:, None] + 1e-9) * np.exp(noise)
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _blocks(batches: Iterable[pa.RecordBatch], most: int, dtype: type) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows and their symbols, about ``most`` tokens at a time."""
    rows, symbols, size = [], [], 0
    for batch in batches:
        names = [n for n in batch.schema.names if n != "symbols"]
        columns = [batch.column(n).to_pylist() for n in names]
        for *row, raw in zip(*columns, batch.column("symbols"), strict=True):
            rows.append(row)
            symbols.append(np.frombuffer(raw.as_buffer(), dtype))
            size += len(symbols[-1])
            if size >= most:
                yield rows, symbols
                rows, symbols, size = [], [], 0
    if rows:
        yield rows, symbols


def _lanes(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: order, flat symbols, start of each, live lanes at each step."""
    size = np.array([len(s) for s in symbols])
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate([symbols[i] for i in order])
    start = np.concatenate([[0], np.cumsum(size[order])[:-1]])
    return order, flat, start, np.searchsorted(-size[order], -np.arange(size[order][0]), "left")


def _forward(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the likelihood of each sequence, and the states at its end; all sequences take a step together."""
    order, flat, start, live = _lanes(sequences)
    total = np.zeros(len(sequences))
    ends = np.empty((len(sequences), len(model.start)), model.emit.dtype)
    alpha = np.broadcast_to(model.start, ends.shape)
    for t, n in enumerate(live):
        ends[n : len(alpha)] = alpha[n:]
        alpha = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[flat[start[:n] + t]]
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        total[:n] += np.log10(scale)
    ends[: len(alpha)] = alpha
    back = np.argsort(order)
    return total[back], ends[back]


def _transfers(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each sequence the matrix from the state before it to the state at its end, scaled to a sum of 1, and log10 of the scale."""
    order, flat, start, live = _lanes(sequences)
    states = len(model.start)
    total = np.zeros(len(sequences))
    out = np.broadcast_to(np.eye(states, dtype=model.emit.dtype), (len(sequences), states, states)).copy()
    for t, n in enumerate(live):
        ahead = (out[:n].reshape(n * states, states) @ model.move).reshape(n, states, states) * model.emit[flat[start[:n] + t]][:, None]
        scale = ahead.sum((1, 2))
        out[:n] = ahead / scale[:, None, None]
        total[:n] += np.log10(scale)
    back = np.argsort(order)
    return out[back], total[back]


def _cut(sequence: np.ndarray, segment: int) -> list[np.ndarray]:
    return [sequence[i : i + segment] for i in range(0, len(sequence), segment)]


def _carried(model: Model, texts: list[list[np.ndarray]]) -> list[tuple[list[np.ndarray], list[np.ndarray], float]]:
    """Of each text in several segments: the states before each (of the first None), the backward probabilities behind each, and log10 of the likelihood."""
    logs, ends = _forward(model, [t[0] for t in texts])
    matrices, scales = _transfers(model, [s for t in texts for s in t[1:]])
    out, at = [], 0
    for text, log, state in zip(texts, logs, ends, strict=True):
        own, at = range(at, at + len(text) - 1), at + len(text) - 1
        before, behind = [None], [np.full(len(state), 1 / len(state))]
        for k in own:
            before.append(state)
            state = state @ matrices[k]
            log += scales[k] + np.log10(state.sum())
            state = state / state.sum()
        for k in reversed(own):
            ahead = matrices[k] @ behind[-1]
            behind.append(ahead / ahead.sum())
        out.append((before, behind[::-1], log))
    return out


def log10_likelihood(model: Model, sequences: list[np.ndarray], segment: int = SCORED_SEGMENT) -> np.ndarray:
    """Of each whole sequence, by the scaled forward recursion, with the matrices of its segments if it is long."""
    out = np.empty(len(sequences))
    long = np.array([len(s) > segment for s in sequences], bool)
    if not long.all():
        out[~long] = _forward(model, [s for s, cut in zip(sequences, long, strict=True) if not cut])[0]
    if long.any():
        out[long] = [log for _, _, log in _carried(model, [_cut(s, segment) for s, cut in zip(sequences, long, strict=True) if cut])]
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over whole sequences: expected starts, moves and emissions."""
    states = len(model.start)
    narrow = Model(model.start.astype(np.float32), model.move.astype(np.float32), model.emit.astype(np.float32))
    parts, before, behind = [], [], []
    cut = [_cut(s, segment) for s in sequences]
    long = iter(_carried(narrow, [c for c in cut if len(c) > 1]) if any(len(c) > 1 for c in cut) else [])
    for c in cut:
        own = next(long)[:2] if len(c) > 1 else ([None], [np.full(states, 1 / states)])
        parts += c
        before += own[0]
        behind += own[1]
    order, flat, start, live = _lanes(parts)
    first = np.array([before[i] is None for i in order])
    came = np.array([np.zeros(states) if before[i] is None else before[i] for i in order], np.float32)
    last = np.array([behind[i] for i in order], np.float32)
    emit, move = narrow.emit, narrow.move
    alpha = np.where(first[:, None], model.start, came @ move).astype(np.float32)
    alphas, scales, seens = [], [], []
    for t, n in enumerate(live):
        seen = emit[flat[start[:n] + t]]
        alpha = (alpha[:n] @ move if t else alpha[:n]) * seen
        scale = alpha.sum(1, keepdims=True)
        alpha = alpha / scale
        alphas.append(alpha)
        scales.append(scale)
        seens.append(seen)
    gamma = np.empty((len(flat), states), np.float32)
    moves = np.zeros((states, states))
    beta = np.ones((0, states), np.float32)
    for t in range(len(live) - 1, -1, -1):
        n, m = live[t], len(beta)
        if m < n:  # segments that end here
            beta = np.concatenate([beta, last[m:n] / (alphas[t][m:n] * last[m:n]).sum(1, keepdims=True)])
        gamma[start[:n] + t] = alphas[t] * beta
        ahead = seens[t] * beta / scales[t]
        if t:
            moves += alphas[t - 1][:n].T @ ahead
            beta = ahead @ move.T
    moves += came.T @ ahead  # from one segment into the next
    moves *= model.move
    emits = np.stack([np.bincount(flat, gamma[:, s], len(emit)) for s in range(states)], 1)
    return gamma[start][first].sum(0), moves, emits


def _train(texts: DataFrame, unigram: np.ndarray, states: int, iterations: int, dtype: type) -> Model:
    """Baum-Welch over all rows of ``texts`` (``symbols``)."""
    context = texts.sparkSession.sparkContext
    model = Model.first(unigram, states)
    size = states + states * states + len(unigram) * states
    for _ in range(iterations):
        sent = context.broadcast(model)

        def count(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for _, sequences in _blocks(batches, 1_000_000, dtype):
                total += np.concatenate([x.ravel() for x in expected_counts(sent.value, sequences)])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([some], pa.list_(pa.int32())), pa.array([total[some]], pa.list_(pa.float64()))], ["at", "n"])

        parts = texts.select("symbols").mapInArrow(count, "at array<int>, n array<double>")
        sums = parts.select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n")).toArrow()
        total = np.zeros(size)
        total[sums["at"].to_numpy()] = sums["n"].to_numpy()
        start, move, emit = np.split(total, np.cumsum([states, states * states]))
        share = lambda x, axis: (x + 1e-3) / (x + 1e-3).sum(axis, keepdims=True)
        emit = emit.reshape(len(unigram), states) + 0.1 * (unigram[:, None] + 1e-6)
        model = Model(share(start, 0), share(move.reshape(states, states), 1), emit / emit.sum(0))
        sent.unpersist()
    return model


def _counted(batches: Iterable[pa.RecordBatch], symbols: Symbols) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            for words in words_of(text.as_py()):
                seen.update(keys_of(words))
                if len(seen) > 300_000:
                    yield _word_batch(seen, symbols)
                    seen = Counter()
    yield _word_batch(seen, symbols)


def _word_batch(seen: Counter, symbols: Symbols) -> pa.RecordBatch:
    words = list(seen)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([symbols.class_of(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["word", "class", "c"])


def score_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS, symbols: Symbols | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from the rows that are not held out.  ``symbols`` tells how many words are symbols
    of their own, a table that goes to every task, and how the others are classed; with as many as there
    are words nothing is classed.  A null or empty text has one token, its end.  Repeated rows are texts of their
    own; words with equal counts are ranked by their bytes, and where only some of them fit into the table a hash chooses; words of more than KEY_BYTES bytes are told
    apart by 128 bits; a table with no training row scores every word as unknown; an empty table gives no
    rows; only the two named columns are read.
    """
    symbols = symbols or Symbols()
    ship_package(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(id_col).alias("held_out"))
    found = rows.where("NOT held_out").select("text").mapInArrow(lambda batches: _counted(batches, symbols), "word string, class int, c long")
    counts = staged(found.groupBy("word").agg(F.first("class").alias("class"), F.sum("c").alias("c")), "word_counts")
    table = most_frequent(counts, "c", max(HOT_WORDS, symbols.own), "word").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    own = table.slice(0, symbols.own)
    by_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    tokens, vocabulary = sum(by_class["n"].to_pylist()), sum(by_class["v"].to_pylist())
    n, v = np.zeros(symbols.size), np.zeros(symbols.size)
    n[by_class["class"].to_numpy()], v[by_class["class"].to_numpy()] = by_class["n"].to_numpy(), by_class["v"].to_numpy()
    np.subtract.at(n, own["class"].to_numpy(), own["c"].to_numpy())
    np.subtract.at(v, own["class"].to_numpy(), 1)
    share = np.log10(n + 0.1 * (v + 1))  # of a class, what its words' smoothed counts are divided by
    n[: len(own)] = own["c"].to_numpy()
    share[: symbols.own] = 0.0
    index = {w.encode(): i for i, w in enumerate(table["word"].to_pylist())}
    symbol = table["class"].to_numpy().astype(symbols.dtype)
    symbol[: len(own)] = np.arange(len(own))
    sent = context.broadcast((index, symbol, np.log10(table["c"].to_numpy() + 0.1)))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, symbol, log_count = sent.value
        numbers = row_numbers()

        def one(text: str) -> tuple:
            coded, known, size, log_sum, own_sum = [], Counter(), 0, 0.0, 0.0
            for words in words_of(text):
                words = keys_of(words)
                at = np.array([index.get(w, -1) for w in words], np.int64)
                lost = np.flatnonzero(at < 0)
                rare = [words[k] for k in lost.tolist()]
                piece = symbol[at] if len(symbol) else np.zeros(len(at), symbols.dtype)
                piece[lost] = [symbols.class_of(w) for w in rare]
                coded.append(piece.tobytes())
                known.update(rare)
                size += len(words)
                log_sum += float(log_count[at[at >= 0]].sum())
                own_sum += float(log_count[at[(at >= 0) & (at < symbols.own)]].sum())
            return size, size - known.total(), log_sum, own_sum, b"".join(coded), [w.decode() for w in known], list(known.values())

        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i, text, held in zip(*(batch.column(c) for c in range(3)), strict=True):
                out.append((next(numbers), i.as_py(), held.as_py(), *one(text.as_py())))
                size += out[-1][3]
                if size > 300_000:
                    yield _doc_batch(out)
                    out, size = [], 0
            if out:
                yield _doc_batch(out)

    encoded = staged(rows.mapInArrow(encode, _DOC_SCHEMA), "symbols")
    unigram = n / max(n.sum(), 1)
    model = context.broadcast(_train(encoded.where("NOT held_out"), unigram, states, iterations, symbols.dtype))

    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for facts, sequences in _blocks(batches, 4_000_000, symbols.dtype):
            logs = log10_likelihood(model.value, sequences) - np.array([share[s].sum() for s in sequences])
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in facts], pa.int64()), pa.array(logs, pa.float64())], ["row", "forward"])

    scored = encoded.select("row", "symbols").mapInArrow(forward, "row long, forward double")
    tail = encoded.select("row", F.explode(F.arrays_zip("rare", "m")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.m").alias("m"))
    tail = tail.join(counts.select("word", "c"), "word", "left")
    zero, none = F.lit(0.0), F.lit(None)
    parts = (
        encoded.select("row", "id", "held_out", "n_tokens", F.col("known").alias("n_known"), "log_sum", "own_sum", zero.alias("forward"))
        .unionByName(tail.select("row", none.cast("long").alias("id"), none.cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("m")).otherwise(0).alias("n_known"), (F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("log_sum"), zero.alias("own_sum"), zero.alias("forward")))
        .unionByName(scored.select("row", none.cast("long").alias("id"), none.cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), zero.alias("log_sum"), zero.alias("own_sum"), "forward"))
    )
    sums = parts.groupBy("row").agg(F.max("id").alias(id_col), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "log_sum", "own_sum", "forward")))
    return sums.select(
        id_col,
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * float(np.log10(tokens + 0.1 * (vocabulary + 1)))).alias("base_score"),
        (F.col("forward") + F.col("log_sum") - F.col("own_sum")).alias("score"),
    )


_DOC_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
_DOC_NAMES = ["row", "id", "held_out", "n_tokens", "known", "log_sum", "own_sum", "symbols", "rare", "m"]
_DOC_SCHEMA = "row long, id long, held_out boolean, n_tokens long, known long, log_sum double, own_sum double, symbols binary, rare array<string>, m array<long>"


def _doc_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _DOC_TYPES, strict=True)], _DOC_NAMES)

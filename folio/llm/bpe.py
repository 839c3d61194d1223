"""Byte-level BPE: encoding by a bounded-lookahead streaming transducer, decoding by a byte-to-text state machine.

Lookahead.  Take two byte strings with a common prefix and apply the merge rules in order.  Let p be
the last boundary up to which both segmentations agree.  A rule (u, v) can move p to the left only if
the token that ends at p is u, and then by len(u) bytes; the token that now begins at p has u at the
left edge of its merge tree.  The next rule that moves p must come later in the list, and its right
part must have such a u at its left edge.  So the longest weighted chain of rules, each later than the
one before it and linked in that way, bounds how far the end of the input reaches back: tokens that
end at least that many bytes before the end of what has been read can no longer change.

Streams.  Every text is read in windows of the same size, many texts side by side.  After each window a
text's pre-tokens that no further character can change are cut off, and their ids are stable and come
out; the rest waits for the next window, and the end of the text makes all of it stable.  A pre-token
that outgrows a window is a byte stream of its own: the transducer merges what it holds of it, emits the
tokens that end the lookahead or more before the end of what has been read, and reads on.  So what is
held beside a row never depends on the length of its text, and no text takes another path.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow_rows import row_numbers
from folio.sources.shipping import ship_package

#: The published split rule of byte-level BPE vocabularies (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same rule where a text has Latin characters only, none of them a control separator or a numeral outside 0-9.
_LATIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
_MEMO_ENTRIES = 200_000
_SHORT_BYTES = 64
#: Bytes of a text that are read at a time, texts that are read side by side, and ids of a text that are held before they are passed on.
WINDOW, LIVE_TEXTS, BLOCK_IDS = 1024, 512, 1 << 14
#: Characters behind a pre-token that may still change where it ends: two of a contraction, and one behind white space.
_UNSURE = 3
#: What a pre-token that outgrows a piece goes on with, by its second character.
_RUNS = {"letters": regex.compile(r"\p{L}*"), "numbers": regex.compile(r"\p{N}*"), "space": regex.compile(r"\p{White_Space}*"), "other": regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, by their rule: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """The bound of the module's docstring, in bytes; linear in the merge list."""
    left: dict[bytes, bytes] = {}
    chain: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        reach, edge = 0, v
        while edge is not None:
            reach = max(reach, chain.get(edge, 0))
            edge = left.get(edge)
        reach += len(u)
        chain[u] = max(chain.get(u, 0), reach)
        left.setdefault(u + v, u)
        most = max(most, reach)
    return most


class Vocabulary:
    """Merge rules by token id, the bytes of each token, and the literals that split a text first."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model, alphabet = spec["model"], byte_alphabet()
        ids = model["vocab"]
        raw = lambda token: bytes(alphabet[c] for c in token)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rules = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        made: dict[int, int] = {}
        for (a, b), (rank, new) in self.rules.items():
            if new in made:
                raise ValueError("two merge rules make the same token")
            made[new] = rank
        if any(made.get(x, -1) >= rank for pair, (rank, _) in self.rules.items() for x in pair):
            raise ValueError("a merge rule uses a token before it is made")
        self.of_byte = [0] * 256
        for c, b in alphabet.items():
            self.of_byte[b] = ids[c]
        self.literals = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.literals.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            if token not in self.literals:
                self.token_bytes[i] = raw(token)
        for literal, i in self.literals.items():
            self.token_bytes[i] = literal.encode()
        self.token_sizes = np.array([len(b) for b in self.token_bytes], np.int64)
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self._tables()
        self.split_literals = regex.compile("(" + "|".join(map(regex.escape, sorted(self.literals, key=len, reverse=True))) + ")") if self.literals else None

    def merged(self, raw: bytes) -> np.ndarray:
        """Ids of bytes by the rules: always the earliest rule that fits, leftmost first."""
        ids = [self.of_byte[b] for b in raw]
        return np.array(_merged_short(ids, self.rules) if len(ids) <= 40 else _merged_long(ids, self.rules), np.int32)

    def _tables(self) -> None:
        pairs = sorted((a << 32 | b, rank) for (a, b), (rank, _) in self.rules.items())
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int32)
        self.made = np.zeros(len(pairs), np.int32)
        for rank, new in self.rules.values():
            self.made[rank] = new
        self.byte_ids = np.array(self.of_byte, np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NO_RULE)

    def merged_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merged`` for many pieces, short ones side by side: row by row the earliest rule that fits, leftmost first; ids as int32 bytes."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted((i for i in range(len(pieces)) if len(pieces[i]) <= _SHORT_BYTES), key=lambda i: len(pieces[i]))
        for i in range(len(pieces)):
            if len(pieces[i]) > _SHORT_BYTES:
                out[i] = self.merged(pieces[i]).tobytes()
        at = 0
        while at < len(order):
            width = next(w for w in (8, 12, 16, 24, 32, 48, _SHORT_BYTES) if len(pieces[order[at]]) <= w)
            end = at
            while end < len(order) and len(pieces[order[end]]) <= width and end - at < 16384:
                end += 1
            self._merge_block([pieces[i] for i in order[at:end]], order[at:end], width, out)
            at = end
        return out

    def _merge_block(self, pieces: list[bytes], order: list[int], width: int, out: list[bytes]) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width + 1), _PAD, np.int32)
        ids[:, :width][np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        rows, done = np.arange(len(pieces)), []
        while len(rows):
            j = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), j]
            live = best < _NO_RULE
            if not live.all():
                done.append((rows[~live], ids[~live]))
                rows, ids, ranks, j, best = rows[live], ids[live], ranks[live], j[live], best[live]
                if not len(rows):
                    break
            n, cols = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > j[:, None]), 1)
            ids[n, j] = self.made[best]
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols > j[:, None]), ranks.shape[1] - 1)[:, :-1], 1)
            ids = np.pad(ids, ((0, 0), (0, 1)), constant_values=_PAD) if ids.shape[1] < 2 else ids
            ranks = np.full((len(rows), 1), _NO_RULE, np.int32) if not ranks.shape[1] else ranks
            ranks[n, np.minimum(j, ranks.shape[1] - 1)] = self._ranks(ids[n, np.minimum(j, ids.shape[1] - 2)], ids[n, np.minimum(j + 1, ids.shape[1] - 1)])
            k = np.maximum(j - 1, 0)
            ranks[n, k] = self._ranks(ids[n, k], ids[n, k + 1])
        for which, values in done:
            used = values != _PAD
            flat, ends = values[used].tobytes(), (used.sum(1).cumsum() * 4).tolist()
            start = 0
            for r, end in zip(which.tolist(), ends, strict=True):
                out[order[r]] = flat[start:end]
                start = end


_PAD, _NO_RULE = -1, np.int32(2**31 - 1)


def _merged_short(ids: list[int], rules: dict) -> list[int]:
    while len(ids) > 1:
        best, at = None, -1
        for i in range(len(ids) - 1):
            rule = rules.get((ids[i], ids[i + 1]))
            if rule is not None and (best is None or rule < best):
                best, at = rule, i
        if best is None:
            break
        ids[at : at + 2] = [best[1]]
    return ids


def _merged_long(ids: list[int], rules: dict) -> list[int]:
    n = len(ids)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rule, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rule := rules.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        (_, new), i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = new, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if rule := rules.get((new, ids[k])):
                heapq.heappush(heap, (rule, i, new, ids[k]))
        if (h := before[i]) >= 0 and (rule := rules.get((ids[h], new))):
            heapq.heappush(heap, (rule, h, ids[h], new))
    return [x for x in ids if x >= 0]


class Transducer:
    """Reads byte streams in windows and emits ids as soon as no further byte can change them.

    It holds at most lookahead + ``step`` bytes of a stream, whatever the length of the stream.
    """

    def __init__(self, vocabulary: Vocabulary, step: int = 2048):
        self.vocabulary, self.window = vocabulary, vocabulary.lookahead + step

    def advance(self, held: list[bytes], ended: list[bool]) -> list[tuple[bytes, bytes]]:
        """Of each stream the ids that are stable (as int32 bytes), and the bytes that it goes on to hold; at its end all is stable."""
        out = []
        for raw, ids, over in zip(held, self.vocabulary.merged_many(held), ended, strict=True):
            if not over:
                ends = np.cumsum(self.vocabulary.token_sizes[np.frombuffer(ids, np.int32)])
                stable = int(np.searchsorted(ends, len(raw) - self.vocabulary.lookahead, "right"))
                ids, raw = ids[: 4 * stable], raw[int(ends[stable - 1]) :] if stable else raw
            out.append((ids, b"" if over else raw))
        return out

    def run(self, streams: list[bytes]) -> list[bytes]:
        """The ids of whole streams; all that have bytes left take a step together."""
        out: list[list[bytes]] = [[] for _ in streams]
        live, at, held = list(range(len(streams))), [0] * len(streams), [b""] * len(streams)
        while live:
            for i in live:
                take = self.window - len(held[i])
                held[i], at[i] = held[i] + streams[i][at[i] : at[i] + take], at[i] + take
            for i, (ids, rest) in zip(live, self.advance([held[i] for i in live], [at[i] >= len(streams[i]) for i in live]), strict=True):
                out[i].append(ids)
                held[i] = rest
            live = [i for i in live if at[i] < len(streams[i])]
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


class StreamingEncoder:
    """One stream of a :class:`Transducer` whose bytes come in pieces of any size."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.held = transducer, b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        at, window = 0, self.transducer.window
        while at < len(data):
            take = window - len(self.held)
            self.held, at = self.held + data[at : at + take], at + take
            if len(self.held) == window:
                ids, self.held = self.transducer.advance([self.held], [False])[0]
                yield ids

    def finish(self) -> bytes:
        ids, self.held = self.transducer.advance([self.held], [True])[0]
        return ids


@dataclass
class Part:
    """Some bytes of a pre-token that comes in several parts, or with ``literal`` the id of a literal."""

    raw: bytes = b""
    last: bool = False
    literal: int | None = None


class PretokenReader:
    """Pre-tokens of a text that comes in pieces, as lists of whole ones or as :class:`Part` s of long ones."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.wide, self.latin = vocabulary, regex.compile(SPLIT).findall, re.compile(_LATIN_SPLIT).findall
        self.pending, self.carry, self.run = "", "", None

    def whole(self, text: str) -> list[str]:
        """Pre-tokens of a text without literals."""
        return (self.wide if _NOT_LATIN.search(text) else self.latin)(text)

    def feed(self, text: str, last: bool = False) -> Iterator[list[str] | Part]:
        """What is certain after another piece; literals end what stands before them."""
        text, at = self.pending + text, 0
        split = self.vocabulary.split_literals
        sure = len(text) if last else self._sure(text, 0)
        for m in split.finditer(text) if split else ():
            if m.start() >= sure:
                break
            yield from self._segment(text[at : m.start()], True)
            yield Part(literal=self.vocabulary.literals[m[0]])
            at = m.end()
            sure = len(text) if last else self._sure(text, at)
        self.pending = text[sure:]
        yield from self._segment(text[at:sure], last)

    def _sure(self, text: str, start: int) -> int:
        """The place from which the end of what is known may be the beginning of a literal."""
        most = max(map(len, self.vocabulary.literals), default=0)
        at = max(start, len(text) - most + 1)
        if not any(x[0] in text[at:] for x in self.vocabulary.literals):
            return len(text)
        for at in range(at, len(text)):
            if any(len(x) > len(text) - at and x.startswith(text[at:]) for x in self.vocabulary.literals):
                return at
        return len(text)

    def _segment(self, text: str, last: bool) -> Iterator[list[str] | Part]:
        text, self.carry = self.carry + text, ""
        if self.run:
            end = _RUNS[self.run].match(text).end()
            over = end < len(text) if last else end < len(text) - _UNSURE
            end -= self.run == "space" and end < len(text)  # its last character belongs to what follows
            if over:
                yield Part(text[:end].encode(), True)
                text, self.run = text[end:], None
            elif last:
                yield Part(text.encode(), True)
                text, self.run = "", None
            else:
                end = max(0, min(end, len(text) - _UNSURE))
                yield Part(text[:end].encode())
                self.carry = text[end:]
                return
        found = self.whole(text)
        if not last:
            end = len(text)
            while found and end > len(text) - _UNSURE:
                end -= len(found.pop())
            self.carry = text[end:]
            if not found and len(text) > WINDOW:
                second = text[1]
                self.run = "space" if regex.match(r"\p{White_Space}", second) else "letters" if regex.match(r"\p{L}", second) else "numbers" if regex.match(r"\p{N}", second) else "other"
                yield Part(text[:-_UNSURE].encode())
                self.carry = text[-_UNSURE:]
        if found:
            yield found


class TextStream:
    """A text that is read window by window: its pre-tokens so far, and the one that has outgrown a window."""

    def __init__(self, vocabulary: Vocabulary):
        self.reader, self.run = PretokenReader(vocabulary), None

    def part(self, transducer: Transducer, part: Part) -> Iterator[bytes]:
        self.run = self.run or StreamingEncoder(transducer)
        yield from self.run.feed(part.raw)
        if part.last:
            yield self.run.finish()
            self.run = None


class Encoder:
    """Ids of texts, all of them from the transducer; a bounded memo keeps what it gave for short pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.memo, self.transducer = vocabulary, {}, Transducer(vocabulary)

    def advance(self, streams: list[TextStream], windows: list[str], ended: list[bool]) -> list[bytes]:
        """Of each text the ids that are stable after its next window, at its end all (as int32 bytes); new pre-tokens of all texts advance together."""
        blocks, plan = [], []
        for k, (stream, window, over) in enumerate(zip(streams, windows, ended, strict=True)):
            for x in stream.reader.feed(window, over):
                if isinstance(x, list):
                    plan.append((k, len(blocks)))
                    blocks.append(x)
                elif x.literal is not None:
                    plan.append((k, np.array([x.literal], np.int32).tobytes()))
                else:
                    plan += ((k, ids) for ids in stream.part(self.transducer, x))
        known = self._ids(blocks)
        out: list[list[bytes]] = [[] for _ in streams]
        for k, x in plan:
            out[k].append(known[x] if isinstance(x, int) else x)
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text; all that are not at their end take a window together."""
        streams, out, at = [TextStream(self.vocabulary) for _ in texts], [[] for _ in texts], 0
        live = list(range(len(texts)))
        while live:
            over = [at + WINDOW >= len(texts[k]) for k in live]
            for k, ids in zip(live, self.advance([streams[k] for k in live], [texts[k][at : at + WINDOW] for k in live], over), strict=True):
                out[k].append(ids)
            live, at = [k for k, done in zip(live, over, strict=True) if not done], at + WINDOW
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def encode_pieces(self, pieces: Iterable[str]) -> Iterator[tuple[str, np.ndarray]]:
        """Of a text in pieces of any size each piece and the ids that are stable after it."""
        stream, before = TextStream(self.vocabulary), None
        for piece in pieces:
            if before is not None:
                yield before, np.frombuffer(self.advance([stream], [before], [False])[0], np.int32)
            before = piece
        yield before or "", np.frombuffer(self.advance([stream], [before or ""], [True])[0], np.int32)

    def _ids(self, blocks: list[list[str]]) -> list[bytes]:
        memo = self.memo
        if len(memo) >= _MEMO_ENTRIES:
            memo.clear()
        new = [p for p in set().union(*blocks) if p not in memo]
        found = dict(zip(new, self.transducer.run([p.encode() for p in new]), strict=True))
        long = {p: ids for p, ids in found.items() if len(p) > _SHORT_BYTES}
        memo.update((p, ids) for p, ids in found.items() if len(p) <= _SHORT_BYTES)
        if not long:
            return [b"".join(map(memo.__getitem__, block)) for block in blocks]
        return [b"".join(memo[p] if p in memo else long[p] for p in block) for block in blocks]


class ByteTextDecoder:
    """Text of a stream of ids: bytes that do not yet end a character are held, malformed ones become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.table, self.state = vocabulary.token_bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)

    def decode(self, ids: list[int], step: int = 1 << 16) -> str:
        out = "".join(self.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + self.finish()
        self.state.reset()
        return out


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Text:
    """A row whose text is read window by window from its bytes; ``parted`` if ids of it were passed on before its end."""

    def __init__(self, row: int, own_id: int | None, raw: bytes, vocab: Vocabulary, keep_text: bool):
        self.row, self.id, self.view, self.at, self.parted = row, own_id, memoryview(raw), 0, False
        self.stream, self.utf8, self.decoder = TextStream(vocab), codecs.getincrementaldecoder("utf-8")(), ByteTextDecoder(vocab)
        self.keep_text, self.ids, self.held, self.texts = keep_text, [], 0, []

    def window(self) -> tuple[str, bool]:
        self.at, at = self.at + WINDOW, self.at
        text = self.utf8.decode(self.view[at : self.at])
        if self.keep_text:
            self.texts.append(text)
        return text, self.at >= len(self.view)

    def take(self, ids: bytes) -> None:
        self.ids.append(ids)
        self.held += len(ids) // 4

    def block(self, last: bool) -> tuple:
        """What has come since the last block."""
        ids = np.frombuffer(b"".join(self.ids), np.int32)
        text = self.decoder.feed(ids.tolist()) + (self.decoder.finish() if last else "")
        out = (self.row, self.id, last, ids, text, "".join(self.texts))
        self.ids, self.held, self.texts = [], 0, []
        return out


def _coded(batches: Iterable[pa.RecordBatch], vocabulary: str, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`bpe_blocks`, without ``keep_text`` with empty texts.

    LIVE_TEXTS texts take a window together; one that ends makes room for the next, so that a step is always as large, whatever the lengths.
    """
    vocab = _vocabulary(vocabulary)
    encoder, numbers = Encoder(vocab), row_numbers()
    texts = (_Text(next(numbers), i.as_py(), text.as_buffer().to_pybytes() if text.is_valid else b"", vocab, keep_text) for batch in batches for i, text in zip(batch.column(0), batch.column(1), strict=True))
    live = list(islice(texts, LIVE_TEXTS))
    while live:
        windows, ended = zip(*(t.window() for t in live), strict=True)
        for t, ids in zip(live, encoder.advance([t.stream for t in live], windows, ended), strict=True):
            t.take(ids)
        whole = [t.block(True) for t, over in zip(live, ended, strict=True) if over and not t.parted]
        if whole:
            yield _block_batch(*map(list, zip(*whole, strict=True)))
        for t, over in zip(live, ended, strict=True):
            if over and t.parted or not over and t.held >= BLOCK_IDS:
                t.parted = True
                yield _block_batch(*([x] for x in t.block(over)))
        live = [t for t, over in zip(live, ended, strict=True) if not over]
        live += islice(texts, LIVE_TEXTS - len(live))


_BLOCK_NAMES = ["row", "id", "last", "ids", "decoded", "text"]
_BLOCK_SCHEMA = "row long, id long, last boolean, ids array<int>, decoded string, text string"


def _block_batch(rows: list, ids: list, last: list, tokens: list[np.ndarray], decoded: list[str], texts: list[str]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens)))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(last, pa.bool_()), lists, pa.array(decoded, pa.string()), pa.array(texts, pa.string())], _BLOCK_NAMES)


def bpe_blocks(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The blocks of every row of ``docs``: ``row`` (a number), ``id``, ``last``, ``ids``, ``decoded``, and ``text`` (empty without ``keep_text``).

    Most texts are one block, those with very many ids several, in their order, though blocks of other rows
    may stand between them; the concatenated ids, decoded texts and texts of a row's
    blocks are those of the row.  ``vocabulary`` is the path of a byte-level BPE file, at the same place
    on every machine.  A null text is the empty text and has no ids; null ids and repeated rows are rows
    of their own; an empty table gives no rows; only the two named columns are read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _coded(batches, vocabulary, keep_text), _BLOCK_SCHEMA)


def bpe_round_trip(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (array<int>), ``decoded`` (the text that the ids give), with ``keep_text`` also ``text``.

    As :func:`bpe_blocks`, but with a row's blocks put together.
    """
    names = ["id", "ids", "decoded", "text"][: 3 + keep_text]

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {}
        for batch in _coded(batches, vocabulary, keep_text):
            row, last = (batch.column(c)[0].as_py() for c in ("row", "last"))
            if not last or row in parts:
                parts.setdefault(row, []).append(batch)
                if not last:
                    continue
                own = parts.pop(row)
                join = lambda c: "".join("".join(p.column(c).to_pylist()) for p in own)  # noqa: E731, B023
                tokens = np.concatenate([p.column("ids").flatten().to_numpy() for p in own])
                batch = _block_batch([0], [batch.column("id")[0].as_py()], [True], [tokens], [join("decoded")], [join("text")])
            yield batch.select(names)

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(whole, "id long, ids array<int>, decoded string" + ", text string" * keep_text).withColumnRenamed("id", id_col)


_WHOLE_SCHEMA = "id long, ids array<int>, decoded string, n long, ids_sha256 string, decoded_sha256 string"


def _with_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block as they are; of a row in several blocks the checksums over them, one block at a time, and no ids or text."""
    sums: dict[int, list] = {}
    names = [x.split()[0] for x in _WHOLE_SCHEMA.split(", ")]
    for batch in batches:
        rows, row, last = batch.num_rows, batch.column("row")[0].as_py(), batch.column("last")[0].as_py()
        if last and row not in sums:
            nulls = [pa.nulls(rows, t) for t in (pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *nulls], names)
            continue
        tokens = batch.column("ids")[0].values.to_numpy().tolist()
        state = sums.setdefault(row, [0, hashlib.sha256(), hashlib.sha256()])
        if tokens:
            state[1].update(("," * bool(state[0]) + ",".join(map(str, tokens))).encode())
        state[0] += len(tokens)
        state[2].update(batch.column("decoded")[0].as_buffer())
        if last:
            n, of_ids, of_text = sums.pop(row)
            out = [batch.column("id"), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.string()), pa.array([n], pa.int64()), pa.array([of_ids.hexdigest()]), pa.array([of_text.hexdigest()])]
            yield pa.RecordBatch.from_arrays(out, names)


def bpe_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's columns for ``documents``: checksums of the blocks of :func:`bpe_blocks`."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(lambda batches: _with_digests(_coded(batches, vocabulary, False)), _WHOLE_SCHEMA)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.coalesce("n", F.size("ids").cast("long")).alias("n_tokens"),
        F.coalesce("ids_sha256", F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256)).alias("ids_sha256"),
        F.coalesce("decoded_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256)).alias("decoded_sha256"),
    )

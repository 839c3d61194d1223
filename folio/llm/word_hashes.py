"""64-bit hashes of the words of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at a time.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words: everything but white space; or a-z, 0-9 and all bytes of characters beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        size = 1 << max(16, int(n).bit_length())
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[int(base)] = table = np.cumprod(table)
    return table[:n]


def _pieces(inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end where no word goes on."""
    at = 0
    while at < len(inside):
        end = at + PIECE
        if end >= len(inside):
            end = len(inside)
        else:
            before = np.flatnonzero(~inside[at:end])
            if len(before):
                end = at + int(before[-1]) + 1
            else:  # a word longer than a piece
                end += int(np.argmin(inside[end:]))
        yield at, end
        at = end


def hash_words(texts: list[str], word_bytes: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's first word (one more than texts).

    A word's hash depends on its bytes alone.  Bytes are hashed piece by piece, so that what is held
    beside them does not grow with a text.
    """
    encoded = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)  # the last byte is in no word
    sizes = np.fromiter((len(t) + 1 for t in encoded), np.int64, len(texts))
    if lower:
        raw = LOWER[raw]
    inside = word_bytes[raw]
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at, end in _pieces(inside):
        own, edge = raw[at:end], np.diff(inside[at:end].astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(ends) < len(starts):  # the piece ends with its word
            ends = np.append(ends, len(own))
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(own)), out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(own))[starts]))
        places.append(starts + at)
    return np.concatenate(hashes), np.concatenate([[0], np.searchsorted(np.concatenate(places), np.cumsum(sizes))])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words that begin at each word; the last ``k - 1`` places are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _power(_BASE, 64)[2 * j + 1]
    return mix(out)

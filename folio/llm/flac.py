"""FLAC media columns: lossless storage of byte payloads as 8-bit mono streams, many frames side by side.

The writer tries constant, verbatim, fixed and quantised linear predictors per frame and Rice-codes the
residual.  The reader finds frames by sync code, header CRC-8 and running number, checks each frame's
CRC-16 and the stream's MD5, and decodes residuals and predictors of all frames in lockstep.  It also
returns the table of blocks (sample offset, samples, byte offset), by which a reader can seek.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow_rows import in_chunks, text_rows
from folio.sources.shipping import ship_package

SAMPLE_RATE = 16_000
#: Samples whose frames are coded or decoded side by side.
GROUP_SAMPLES = 1_000_000
_SIZE_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12, 8192: 13, 16384: 14, 32768: 15}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
_PRECISION, _SHIFT = 8, 6


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly) & mask if crc & top else crc << 1 & mask
        out.append(crc)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(table: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs of many byte ranges, one byte of each per step."""
    order = np.argsort(-sizes, kind="stable")
    start, size = starts[order], sizes[order]
    crc = np.zeros(len(order), table.dtype)
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    for k, n in enumerate(live):
        byte = data[start[:n] + k]
        crc[:n] = table[crc[:n] ^ byte] if table.dtype == np.uint8 else table[crc[:n] >> 8 ^ byte] ^ crc[:n] << 8
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _zigzag(r: np.ndarray) -> np.ndarray:
    return r << 1 ^ r >> 31


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best parameter and its size in bits for each row."""
    n = u.shape[1]
    guess = np.log2(np.maximum(u.sum(1), 1) / max(n, 1) + 1e-9).astype(np.int32)
    best_k, best = np.zeros(len(u), np.int32), np.full(len(u), 1 << 40)
    for d in (-1, 0, 1):
        k = np.clip(guess + d, 0, 14)
        bits = (u >> k[:, None]).sum(1, dtype=np.int64) + n * (1 + k.astype(np.int64))
        better = bits < best
        best_k, best = np.where(better, k, best_k), np.where(better, bits, best)
    return best_k, best


def _linear(x: np.ndarray, order: int) -> np.ndarray:
    """Quantised predictor coefficients of each row, by the Levinson recursion on integer autocorrelations."""
    wide = x.astype(np.int64)
    r = np.stack([(wide[:, : x.shape[1] - k] * wide[:, k:]).sum(1) for k in range(order + 1)], 1).astype(float)
    a, err = np.zeros((len(x), order)), np.maximum(r[:, 0], 1e-9)
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    return np.clip(np.rint(a * (1 << _SHIFT)), -(1 << (_PRECISION - 1)), (1 << (_PRECISION - 1)) - 1).astype(np.int32)


def _predicted(x: np.ndarray, coef: np.ndarray, shift: int) -> np.ndarray:
    order = coef.shape[1]
    out = np.zeros((len(x), x.shape[1] - order), np.int32)
    for j in range(order):
        out += coef[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return out >> shift


class _Bits:
    """Codes of all frames, put at their bit positions in 64-bit words; codes never overlap, so sums are unions."""

    def __init__(self, n_bytes: int):
        self.words = np.zeros(n_bytes // 8 + 2, np.uint64)

    def put(self, ends: np.ndarray, values: np.ndarray) -> None:
        shift = (-ends & 63).astype(np.uint64)
        word = (ends - 1) >> 6
        for at, part in ((word, values << shift), (word - 1, (values >> np.uint64(1)) >> (np.uint64(63) - shift))):
            first = np.flatnonzero(np.diff(at, prepend=-2))
            keep = at[first] >= 0
            self.words[at[first][keep]] += np.add.reduceat(part, first)[keep]

    def bytes(self) -> np.ndarray:
        return self.words.byteswap().view(np.uint8)


def _number_bytes(n: int) -> bytes:
    """The frame number in the format's variable-length code."""
    if n < 0x80:
        return bytes([n])
    rest = []
    limit = 0x40
    while n >= limit:
        rest.append(0x80 | n & 0x3F)
        n >>= 6
        limit = {0x40: 0x20, 0x20: 0x10, 0x10: 0x08, 0x08: 0x04, 0x04: 0x02}[limit]
    lead = (0xFF00 >> (len(rest) + 1)) & 0xFF
    return bytes([lead | n, *reversed(rest)])


@lru_cache(maxsize=1 << 14)
def _frame_header(size: int, number: int) -> bytes:
    code = _SIZE_CODES.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _number_bytes(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    crc = 0
    for b in head:
        crc = int(_CRC8[crc ^ b])
    return head + bytes([crc])


def _groups(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive frames of about GROUP_SAMPLES samples: what a range takes does not depend on the length of a stream."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_SAMPLES, "right"))
        yield at, (at := max(end, at + 1))


def encode(payloads: list[bytes], *, block: int = 576, lpc_order: int = 2, seek_every: int = 16) -> list[bytes]:
    """A FLAC stream for each payload of one byte or more; frames are coded range by range."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    frames = -(-lengths // block)
    firsts = np.concatenate([[0], np.cumsum(frames)])
    of = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(of)) - firsts[of]
    size = np.minimum(block, lengths[of] - number * block)
    base = np.concatenate([[0], np.cumsum(lengths)])
    start, data = base[of] + number * block, np.frombuffer(b"".join(payloads), np.uint8)
    total, bodies = np.zeros(len(of), np.int64), [[] for _ in payloads]
    for a, b in _groups(size):
        lo, hi = int(start[a]), int(start[b - 1] + size[b - 1])
        out, total[a:b] = _frames(data[lo:hi].astype(np.int32) - 128, start[a:b] - lo, size[a:b], number[a:b], lpc_order)
        cut = np.concatenate([[0], np.cumsum(total[a:b])])
        for f in range(of[a], of[b - 1] + 1):
            bodies[f].append(out[cut[max(firsts[f], a) - a] : cut[min(firsts[f + 1], b) - a]].tobytes())
    streams = []
    for f, payload in enumerate(payloads):
        a, b = firsts[f], firsts[f + 1]
        offset, sizes = np.concatenate([[0], np.cumsum(total[a:b])]), total[a:b]
        points = b"".join(struct.pack(">QQH", int(number[i]) * block, int(offset[i - a]), int(size[i])) for i in range(a, b, seek_every))
        info = struct.pack(">HH", block, block) + int(sizes.min()).to_bytes(3) + int(sizes.max()).to_bytes(3)
        info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8) + _md5_signed(data[base[f] : base[f + 1]])
        meta = b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(points).to_bytes(3) + points
        streams.append(b"".join([meta, *bodies[f]]))
    return streams


def _md5_signed(data: np.ndarray) -> bytes:
    """MD5 of unsigned samples moved to signed ones."""
    md5 = hashlib.md5()
    for at in range(0, len(data), GROUP_SAMPLES):
        md5.update((data[at : at + GROUP_SAMPLES] ^ 0x80).tobytes())
    return md5.digest()


def _frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray, lpc_order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of frames one after the other, and the size of each."""
    plans = []  # (frames, values, lengths)
    body = np.zeros(len(size), np.int64)
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        plans += _plan(which, data[start[which][:, None] + np.arange(n)], lpc_order)
    for which, _, lengths in plans:
        body[which] = (lengths.sum(1) + 7) >> 3
    heads = [_frame_header(n, k) for n, k in zip(size.tolist(), number.tolist(), strict=True)]
    head = np.array([len(h) for h in heads])
    total = head + body + 2
    where = np.concatenate([[0], np.cumsum(total)[:-1]])
    place = int(total.sum())
    bits = _Bits(place)
    for which, values, lengths in plans:
        bits.put(((where + head)[which][:, None] * 8 + np.cumsum(lengths, 1)).ravel(), values.ravel())
    out = bits.bytes()[:place].copy()
    out[np.repeat(where - np.concatenate([[0], np.cumsum(head)[:-1]]), head) + np.arange(int(head.sum()))] = np.frombuffer(b"".join(heads), np.uint8)
    crc = _crc(_CRC16, out, where, total - 2)
    out[where + total - 2], out[where + total - 1] = crc >> 8, crc & 255
    return out, total


def _plan(which: np.ndarray, x: np.ndarray, lpc_order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The shortest form of each row as (rows, code values, code lengths)."""
    n = x.shape[1]
    choices = [np.where((x == x[:, :1]).all(1), 16, 1 << 40), np.full(len(x), 8 + 8 * n, np.int64)]
    coded = []
    for order in range(3):
        if n > order:
            r = np.diff(x, order, axis=1)
            coded.append((order, None, _zigzag(r)))
    if lpc_order and n > lpc_order:
        coef = _linear(x, lpc_order)
        coded.append((lpc_order, coef, _zigzag(x[:, lpc_order:] - _predicted(x, coef, _SHIFT))))
    params = []
    for order, coef, u in coded:
        k, bits = _rice(u)
        params.append(k)
        choices.append(bits + 18 + 8 * order + (9 + _PRECISION * order if coef is not None else 0))
    best = np.argmin(np.stack(choices), 0)
    out = []
    for c in np.unique(best):
        rows = np.flatnonzero(best == c)
        if c < 2:
            keep = x[rows, :1] if c == 0 else x[rows]
            values = np.concatenate([np.full((len(rows), 1), 2 * int(c)), keep & 255], 1)
            out.append((which[rows], values.astype(np.uint64), np.full(values.shape, 8, np.int64)))
            continue
        order, coef, u = coded[c - 2]
        u, k = u[rows], params[c - 2][rows][:, None]
        kind = (0x20 | order - 1 if coef is not None else 8 | order) << 1
        parts = [(np.full((len(rows), 1), kind), 8), (x[rows, :order] & 255, 8)]
        if coef is not None:
            parts += [(np.full((len(rows), 1), (_PRECISION - 1) << 5 | _SHIFT), 9), (coef[rows] & ((1 << _PRECISION) - 1), _PRECISION)]
        parts.append((k, 10))
        values = np.concatenate([p for p, _ in parts] + [1 << k | u & (1 << k) - 1], 1)
        lengths = np.concatenate([np.full(p.shape, b, np.int64) for p, b in parts] + [(u >> k) + 1 + k], 1)
        out.append((which[rows], values.astype(np.uint64), lengths))
    return out


class FlacError(ValueError):
    """A stream that is not well formed or fails a checksum."""


class _Window:
    """Unaligned reads of up to 56 bits."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(padded) - 8, 8), (1, 1))
        self.padded = padded

    def at(self, pos: np.ndarray) -> np.ndarray:
        """64 bits from each byte-aligned start of ``pos``, moved so that bit ``pos`` is on top; 57 are valid."""
        raw = self.words[pos >> 3].view(">u8")[..., 0].astype(np.uint64)
        return raw << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        bits = np.asarray(bits, np.uint64)
        return np.where(bits > 0, (self.at(pos) >> np.uint64(1)) >> (np.uint64(63) - bits), 0).astype(np.int64)


_LEAD = np.array([16, *(15 - (i.bit_length() - 1) for i in range(1, 1 << 16))], np.int64)


def _signed(v: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    bits = np.asarray(bits, np.int64)
    return v - (v >> np.maximum(bits - 1, 0) & 1) * (np.int64(1) << bits)


@dataclass
class StreamInfo:
    """What stands before the frames of a stream: their place, samples in all, MD5, bits a sample, samples a block, seek points (sample, offset)."""

    first: int
    samples: int
    md5: bytes
    bits: int
    block: int
    points: list[tuple[int, int]]


def _stream_info(stream: bytes) -> StreamInfo:
    if stream[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, info, points, last = 4, None, [], False
    while not last:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4])
        last, own = bool(kind & 0x80), stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            info = own
        elif kind & 0x7F == 3:
            points = [(sample, offset) for sample, offset, _ in struct.iter_unpack(">QQH", own[: len(own) // 18 * 18]) if sample < 1 << 63]
        at += 4 + size
    if info is None or len(info) < 34:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18])
    if packed >> 41 & 7:
        raise FlacError("more than one channel")
    return StreamInfo(at, packed & (1 << 36) - 1, info[18:34], (packed >> 36 & 31) + 1, int.from_bytes(info[:2]), points)


def _headers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of sync codes whose header passes its CRC-8: start, header size, frame number, samples."""
    found = []
    for lo in range(0, max(0, len(data) - 8), 1 << 22):
        hi = min(lo + (1 << 22), len(data) - 8)
        found.append(lo + np.flatnonzero((data[lo:hi] == 0xFF) & ((data[lo + 1 : hi + 1] & 0xFE) == 0xF8)))
    at = np.concatenate(found) if found else np.empty(0, np.int64)
    view = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64)
    code, lead = view(2) >> 4, view(4)
    inverted = _LEAD[np.minimum((lead ^ 0xFF) << 8, 0xFFFF)]  # ones at the top of the first byte
    extra = np.where(lead < 0x80, 0, inverted - 1)
    number = np.where(lead < 0x80, lead, lead & (1 << np.maximum(6 - extra, 0)) - 1)
    for k in range(1, 7):
        number = np.where(k <= extra, number << 6 | view(4 + k) & 0x3F, number)
    own = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    tail = 5 + extra
    a = data[np.minimum(at + tail, len(data) - 1)].astype(np.int64)
    b = data[np.minimum(at + tail + 1, len(data) - 1)].astype(np.int64)
    table = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])
    samples = np.where(code == 6, a + 1, np.where(code == 7, (a << 8 | b) + 1, table[code]))
    size = tail + own + 1
    good = (samples > 0) & (extra >= 0) & (extra <= 6) & (view(2) & 15 == 0) & (view(3) >> 4 == 0) & (view(3) & 1 == 0) & (at + size < len(data))
    at, size, number, samples = at[good], size[good], number[good], samples[good]
    fine = _crc(_CRC8, data, at, size - 1) == data[at + size - 1]
    return at[fine], size[fine], number[fine], samples[fine]


@dataclass
class _Found:
    """All bytes, and of each frame: segment, number, start, end, header size, samples."""

    data: np.ndarray
    of: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    head: np.ndarray
    samples: np.ndarray


def _frames_of(segments: list[bytes], first: np.ndarray, base: np.ndarray) -> _Found:
    """Frames of segments of streams, which begin at ``first`` with the frame number ``base``; every CRC-16 is checked."""
    data = np.frombuffer(b"".join([*segments, bytes(8)]), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    at, head, number, samples = _headers(data)
    of = np.searchsorted(edge, at, "right") - 1
    inside = (of < len(segments)) & (at >= (edge[:-1] + first)[np.minimum(of, len(segments) - 1)])
    at, head, number, samples, of = at[inside], head[inside], number[inside], samples[inside], of[inside]
    begin = np.searchsorted(of, np.arange(len(segments)))
    odd = np.unique(of[number - base[of] != np.arange(len(of)) - begin[of]])
    if len(odd):  # a header inside a frame passed its CRC-8 by chance
        keep = ~np.isin(of, odd)
        for f in odd:
            keep[_chain(data, at, number - base[f], np.flatnonzero(of == f), int(edge[f + 1]))] = True
        at, head, number, samples, of = at[keep], head[keep], number[keep], samples[keep], of[keep]
    last = np.diff(of, append=-1) != 0
    end = np.where(last, edge[of + 1], np.append(at[1:], 0))
    crc = data[end - 2].astype(np.int64) << 8 | data[end - 1]
    if (_crc(_CRC16, data, at, end - at - 2) != crc).any():
        raise FlacError("a frame fails its CRC-16")
    return _Found(data, of, number, at, end, head, samples)


def _crc16_of(data: np.ndarray, start: int, size: int) -> int:
    """The CRC-16 of one long range: it is cut into equal rows, of which a step takes a byte each, and their CRCs are moved together."""
    width = max(1, int(size**0.5))
    rows = -(-size // width)
    padded = np.zeros(rows * width, np.uint8)  # zeros in front change nothing
    padded[rows * width - size :] = data[start : start + size]
    own = _crc(_CRC16, padded, np.arange(rows) * width, np.full(rows, width))
    # What ``width`` zero bytes make of the high and the low byte of a CRC.
    bytes_ = np.arange(256, dtype=np.uint16)
    high, low = bytes_ << 8, bytes_.copy()
    for _ in range(width):
        high, low = (_CRC16[t >> 8] ^ t << 8 for t in (high, low))
    crc = 0
    for c in own.tolist():
        crc = int(high[crc >> 8]) ^ int(low[crc & 255]) ^ c
    return crc


def _chain(data: np.ndarray, at: np.ndarray, number: np.ndarray, found: np.ndarray, end: int) -> list[int]:
    """Of the candidates, those that follow each other by number and CRC-16 from the first to the stream's end.

    Numbers are taken one after the other: a candidate is reached if the bytes from one of the number
    before, itself reached, to it are a frame; it remembers that one.  Only where no number follows is the
    rest of the stream tried as a last frame, so each byte is read a few times however long the stream is.
    """
    by_number: dict[int, list[int]] = {}
    for i in found.tolist():
        by_number.setdefault(int(number[i]), []).append(i)

    def sound(a: int, b: int) -> bool:
        return b - a > 2 and _crc16_of(data, a, b - a - 2) == int(data[b - 2]) << 8 | int(data[b - 1])

    reached, before = [by_number.get(0, [])], dict.fromkeys(by_number.get(0, []), -1)
    while reached[-1]:
        level = []
        for j in by_number.get(len(reached), []):
            i = next((i for i in reversed(reached[-1]) if at[j] > at[i] and sound(int(at[i]), int(at[j]))), None)
            if i is not None:
                before[j] = i
                level.append(j)
        reached.append(level)
    for level in reversed(reached):
        for i in level:
            if sound(int(at[i]), end):
                path = [i]
                while before[path[-1]] >= 0:
                    path.append(before[path[-1]])
                return path[::-1]
    raise FlacError("no chain of frames reaches the end")


def _samples(found: _Found, bits: np.ndarray) -> np.ndarray:
    """Signed samples of all frames in order, decoded range by range."""
    if (bits > 24).any():
        raise FlacError("more than 24 bits a sample")
    window, deepest = _Window(found.data), int(bits.max()) if len(bits) else 8
    flat = np.empty(int(found.samples.sum()), np.int8 if deepest <= 8 else np.int16 if deepest <= 16 else np.int32)
    cut = np.concatenate([[0], np.cumsum(found.samples)])
    for a, b in _groups(found.samples):
        n = found.samples[a:b]
        order = np.argsort(-n, kind="stable")
        rows = _decode_frames(window, (found.start + found.head)[a:b][order] * 8, n[order], bits[a:b][order], (found.end[a:b][order] - 2) * 8)
        flat[cut[a] : cut[b]] = rows[np.argsort(order)][np.arange(rows.shape[1]) < n[:, None]]
    return flat


def _packed(own: np.ndarray, bits: int) -> bytes:
    """Samples as the stream's MD5 takes them: signed, least byte first."""
    raw = own.astype("<i1" if bits <= 8 else "<i2" if bits <= 16 else "<i4", copy=False)
    return raw.tobytes() if bits <= 16 else raw.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _bytes_of(own: np.ndarray, bits: int) -> bytes:
    """8-bit samples moved back from signed; deeper ones packed."""
    return (own.view(np.uint8) ^ 0x80).tobytes() if bits == 8 and own.dtype == np.int8 else (own + 128).astype(np.uint8).tobytes() if bits == 8 else _packed(own, bits)


def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Of each stream the bytes (8-bit samples, moved back from signed) and its blocks: (sample offset, samples, byte offset)."""
    if not streams:
        return []
    facts = [_stream_info(s) for s in streams]
    found = _frames_of(streams, np.array([f.first for f in facts]), np.zeros(len(streams), np.int64))
    if (np.bincount(found.of, found.samples, len(streams)).astype(np.int64) != np.array([f.samples for f in facts])).any():
        raise FlacError("samples are missing")
    flat = _samples(found, np.array([f.bits for f in facts])[found.of])
    cut = np.concatenate([[0], np.cumsum([f.samples for f in facts])])
    edge = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    firsts = np.searchsorted(found.of, np.arange(len(streams) + 1))
    out = []
    for f, info in enumerate(facts):
        own = flat[cut[f] : cut[f + 1]]
        if info.md5.strip(b"\0") and (hashlib.md5(own) if info.bits <= 8 and own.dtype == np.int8 else hashlib.md5(_packed(own, info.bits))).digest() != info.md5:
            raise FlacError("the samples fail the stream's MD5")
        a, b = firsts[f], firsts[f + 1]
        offsets = np.concatenate([[0], np.cumsum(found.samples[a:b])[:-1]])
        out.append((_bytes_of(own, info.bits), list(zip(offsets.tolist(), found.samples[a:b].tolist(), (found.start[a:b] - edge[f]).tolist(), strict=True))))
    return out


def decode_range(stream: bytes, sample: int, count: int) -> bytes:
    """The bytes of ``count`` samples from ``sample`` on, of a stream with blocks of one size; only the blocks between two seek points are read."""
    info = _stream_info(stream)
    stop = min(sample + count, info.samples)
    if not 0 <= sample < stop:
        return b""
    points = sorted({(0, 0), *info.points})
    low, offset = max(p for p in points if p[0] <= sample)
    after = [o for s, o in points if s >= stop]
    segment = stream[info.first + offset : info.first + after[0] if after else len(stream)]
    found = _frames_of([segment], np.array([0]), np.array([low // info.block]))
    if low + int(found.samples.sum()) < stop:
        raise FlacError("samples are missing")
    return _bytes_of(_samples(found, np.full(len(found.of), info.bits))[sample - low : stop - low], info.bits)


def _decode_frames(window: _Window, pos: np.ndarray, n: np.ndarray, depth: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Samples of frames sorted by falling size, a row each; ``pos`` is the bit after the frame header."""
    lanes, most = len(n), int(n[0])
    head = window.read(pos, 8)
    kind, pos = head >> 1, pos + 8
    if (head & 0x81).any():
        raise FlacError("wasted bits or a set padding bit")
    constant, verbatim, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise FlacError("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    top = int(order.max())
    out = np.zeros((lanes, top + most), np.int64)
    if constant.any():
        rows = np.flatnonzero(constant)
        out[rows, top:] = _signed(window.read(pos[rows], depth[rows]), depth[rows])[:, None]
    if verbatim.any():
        rows = np.flatnonzero(verbatim)
        for k in range(int(n[rows].max())):
            live = rows[n[rows] > k]
            out[live, top + k] = _signed(window.read(pos[live] + k * depth[live], depth[live]), depth[live])
    lane = np.flatnonzero(fixed | linear)
    if not len(lane):
        return out[:, top:]
    pos, n, order, depth, limit, linear, kind = pos[lane], n[lane], order[lane], depth[lane], limit[lane], linear[lane], kind[lane]
    x = np.zeros((len(lane), top + most), np.int64)
    for k in range(top):
        live = order > k
        x[live, top + k] = _signed(window.read(pos[live] + k * depth[live], depth[live]), depth[live])
    pos = pos + order * depth
    coef, shift = np.zeros((len(lane), max(top, 1)), np.int64), np.zeros(len(lane), np.int64)
    for o in range(1, min(top, 4) + 1):
        coef[(kind == 8 + o), :o] = _FIXED[o]
    if linear.any():
        rows = np.flatnonzero(linear)
        precision = window.read(pos[rows], 4) + 1
        shift[rows] = _signed(window.read(pos[rows] + 4, 5), 5)
        if (shift < 0).any():
            raise FlacError("a negative predictor shift")
        pos[rows] += 9
        for k in range(int(order[rows].max())):
            live = order[rows] > k
            coef[rows[live], k] = _signed(window.read(pos[rows[live]], precision[live]), precision[live])
            pos[rows[live]] += precision[live]
    method, partitions = window.read(pos, 2), window.read(pos + 2, 4)
    if (method > 1).any():
        raise FlacError("a reserved residual coding")
    pos = pos + 6
    span, wide = n >> partitions, 4 + method
    k, raw = np.zeros(len(lane), np.int64), np.full(len(lane), -1, np.int64)
    live_at = np.searchsorted(-n, -np.arange(most), "left")
    single = not partitions.any() and not method.any()
    low = int(order.min())
    for t in range(low, most):
        m = int(live_at[t])
        begins = order[:m] == t if t <= top else None
        if not single:
            begins = (order[:m] == t) | ((t > order[:m]) & (t % span[:m] == 0))
        if begins is not None and begins.any():
            rows = np.flatnonzero(begins)
            k[rows] = window.read(pos[rows], wide[rows])
            pos[rows] += wide[rows]
            escaped = rows[k[rows] == (1 << wide[rows]) - 1]
            raw[rows] = -1
            raw[escaped] = window.read(pos[escaped], 5)
            pos[escaped] += 5
        p, kk = pos[:m], k[:m]
        waiting = order[:m] > t if t < top else None
        bits = window.at(p)
        lead = _LEAD[(bits >> np.uint64(48)).astype(np.int64)]
        far = lead == 16 if waiting is None else (lead == 16) & ~waiting
        if far.any():
            _long_runs(window, p, lead, np.flatnonzero(far), limit)
            bits = np.where(far, window.at(p + lead), bits << np.minimum(lead, 63).astype(np.uint64))
        else:
            bits = bits << lead.astype(np.uint64)
        rest = (bits << np.uint64(1) >> np.uint64(1)) >> (np.uint64(63) - kk.astype(np.uint64))
        u = lead << kk | rest.astype(np.int64)
        residual = u >> 1 ^ -(u & 1)
        step = lead + 1 + kk
        if (raw[:m] >= 0).any():
            rows = np.flatnonzero(raw[:m] >= 0)
            residual[rows] = _signed(window.read(p[rows], raw[rows]), raw[rows])
            step[rows] = raw[rows]
        if waiting is not None:
            step[waiting] = 0
            residual[waiting] = x[:m, top + t][waiting]
            guess = np.where(waiting, 0, _guess(x, coef, shift, m, top, t))
        else:
            guess = _guess(x, coef, shift, m, top, t)
        x[:m, top + t] = residual + guess
        pos[:m] = p + step
    if ((pos + 7) >> 3 << 3 != limit).any():
        raise FlacError("a frame's codes don't end at its checksum")
    out[lane] = x
    return out[:, top:]


def _guess(x: np.ndarray, coef: np.ndarray, shift: np.ndarray, m: int, top: int, t: int) -> np.ndarray | int:
    if not top:
        return 0
    out = coef[:m, 0] * x[:m, top + t - 1]
    for j in range(1, top):
        out += coef[:m, j] * x[:m, top + t - 1 - j]
    return out >> shift[:m]


def _long_runs(window: _Window, pos: np.ndarray, lead: np.ndarray, rows: np.ndarray, limit: np.ndarray) -> None:
    """Counts unary runs of 16 zeros and more, in place."""
    while len(rows):
        if (pos[rows] + lead[rows] > limit[rows]).any():
            raise FlacError("a unary run passes the frame's end")
        more = _LEAD[(window.at(pos[rows] + lead[rows]) >> np.uint64(48)).astype(np.int64)]
        lead[rows] += more
        rows = rows[more == 16]


def payload_of(text: str, unit: int = 192) -> bytes:
    """UTF-8 bytes, with spaces up to a positive multiple of ``unit``."""
    raw = text.encode()
    return raw + b" " * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def write_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 576) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (of the text), ``media`` (a FLAC stream).

    A null or empty text is a payload of spaces; null ids and repeated rows pass through; a very long
    text is coded a range of frames at a time; an empty table gives no rows; only the two named columns are read.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(text_rows(batches), 1_000_000, 2000):
            streams = encode([payload_of(t) for _, t in chunk], block=block)
            sizes = [len(t.encode()) for _, t in chunk]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunk], pa.int64()), pa.array(sizes, pa.int64()), pa.array(streams, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("media_offset", pa.int64())]))


def read_media(stored: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Adds to each row ``pcm`` (the bytes), ``blocks`` (seek table of sample and byte offsets) and ``feature``.

    ``feature`` is "samples:sum:energy:zero crossings" of the signed samples, in whole numbers.  A null
    stream gives nulls; a damaged one fails the job with :class:`FlacError`.
    """
    ship_package(stored.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size, end = 0, at
                while end < batch.num_rows and size < 1_000_000:
                    size += len(batch.column("media")[end].as_buffer() or b"") if batch.column("media")[end].is_valid else 0
                    end += 1
                part = batch.slice(at, end - at)
                media = part.column("media").to_pylist()
                read = iter(decode([m for m in media if m is not None]))
                rows = [next(read) if m is not None else (None, None) for m in media]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names), pa.array([r[0] for r in rows], pa.binary()), pa.array([[dict(zip(("sample_offset", "n_samples", "media_offset"), b, strict=True)) for b in r[1]] if r[1] is not None else None for r in rows], _BLOCKS), pa.array([_feature(r[0]) for r in rows], pa.string())],
                    [*part.schema.names, "pcm", "blocks", "feature"],
                )
                at = end

    rows = stored.select(id_col, "n_bytes", F.col(media_col).alias("media"))
    blocks = "array<struct<sample_offset: bigint, n_samples: bigint, media_offset: bigint>>"
    return rows.mapInArrow(run, f"{id_col} long, n_bytes long, media binary, pcm binary, blocks {blocks}, feature string")


def read_samples(stored: DataFrame, sample: str, count: str, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id and ``pcm``: the bytes of ``count`` samples from ``sample`` on (columns of ``stored``), found by the stream's seek points.

    What lies beyond the end is left out; a null stream or a null number gives a null.
    """
    ship_package(stored.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if None in (m, a, n) else decode_range(m, a, n) for _, m, a, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "pcm"])

    rows = stored.select(F.col(id_col).cast("long").alias(id_col), media_col, F.col(sample).cast("long").alias("_a"), F.col(count).cast("long").alias("_n"))
    return rows.mapInArrow(run, f"{id_col} long, pcm binary")


def _feature(pcm: bytes | None) -> str | None:
    """Sums over ranges of samples, so that a long payload is never widened whole."""
    if pcm is None:
        return None
    raw, total, energy, crossings = np.frombuffer(pcm, np.uint8), 0, 0, 0
    for at in range(0, len(raw), GROUP_SAMPLES):
        x = raw[at : at + GROUP_SAMPLES + 1].astype(np.int64) - 128  # one more for the crossing into the next range
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[:GROUP_SAMPLES]
        total, energy = total + int(x.sum()), energy + int((x * x).sum())
    return f"{len(raw)}:{total}:{energy}:{crossings}"


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    return read_media(write_media(docs)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("blocks").cast("long").alias("n_blocks"),
    )

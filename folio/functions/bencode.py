"""Bencoded metadata files.  The format is recursive, which column types are not, so it is decoded in a vectorised function."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.sources.shipping import ship_package


def decode(data: bytes):
    """One value; what follows it is ignored.  Malformed data raise ValueError."""
    stack: list = []
    done: list = []
    at = 0
    while True:
        lead = data[at : at + 1]
        if lead in (b"l", b"d"):
            stack.append((lead, done))
            done, at = [], at + 1
            continue
        if lead == b"e" and stack:
            kind, outer = stack.pop()
            if kind == b"d" and len(done) % 2:
                raise ValueError("a key without a value")
            outer.append(dict(zip(done[::2], done[1::2], strict=True)) if kind == b"d" else done)
            done, at = outer, at + 1
        elif lead == b"i":
            end = data.index(b"e", at)
            done.append(int(data[at + 1 : end]))
            at = end + 1
        elif lead.isdigit():
            colon = data.index(b":", at)
            end = colon + 1 + int(data[at:colon])
            if end > len(data):
                raise ValueError("a string passes the end")
            done.append(data[colon + 1 : end])
            at = end
        else:
            raise ValueError("not bencoded")
        if not stack:
            return done[0]


class _Mark(bytes):
    """Bytes of the format, not a value."""


def encode(value) -> bytes:
    """Dictionary keys come in byte order; nesting may have any depth."""
    out, todo = [], [value]
    while todo:
        item = todo.pop()
        if isinstance(item, _Mark):
            out.append(item)
        elif isinstance(item, dict):
            raw = {k.encode() if isinstance(k, str) else k: v for k, v in item.items()}
            out.append(b"d")
            todo.append(_Mark(b"e"))
            for k in sorted(raw, reverse=True):
                todo += [raw[k], k]
        elif isinstance(item, list):
            out.append(b"l")
            todo += [_Mark(b"e"), *reversed(item)]
        elif isinstance(item, int):
            out.append(b"i%de" % item)
        elif isinstance(item, (str, bytes)):
            item = item.encode() if isinstance(item, str) else item
            out.append(b"%d:%s" % (len(item), item))
        else:
            raise TypeError(f"can't encode {type(item).__name__}")
    return b"".join(out)


def _text(value) -> str:
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if isinstance(value, int):
        return str(value)
    raise ValueError("a text is expected where a list or dictionary stands")


def _facts(data: bytes) -> dict:
    """What METADATA holds of a metadata file: one file entry for each of ``files``, or the one that ``name`` and ``length`` describe."""
    outer = decode(data)
    info = outer.get(b"info") if isinstance(outer, dict) else None
    if not isinstance(info, dict):
        raise ValueError("missing_info")
    name = _text(info[b"name"]) if b"name" in info else None
    entries = [info | {b"path": [info.get(b"name", b"")]}] if b"files" not in info else [e for e in info[b"files"] or [] if isinstance(e, dict)]
    sizes = [int(e.get(b"length") or 0) for e in entries]
    if any(abs(n) >= 1 << 63 for n in (*sizes, sum(sizes))):
        raise ValueError("a size has more than 64 bits")
    files = [{"path": "/".join(map(_text, e.get(b"path") or [])), "size": n} for e, n in zip(entries, sizes, strict=True)]
    return {"infohash_hex": hashlib.sha1(encode(info)).hexdigest(), "name": name, "total_size": sum(sizes), "files": files, "error": None}


METADATA = "struct<infohash_hex: string, name: string, total_size: bigint, files: array<struct<path: string, size: bigint>>, error: string>"


def parse_torrent(data: Column) -> Column:
    """struct of METADATA from the bytes of a metadata file; ``error`` tells why the rest is null.

    Files that are malformed in any way give an error: deep nesting, sizes of more than 64 bits and
    texts that are lists among them.  A null file gives nulls throughout.
    """
    ship_package()

    @F.pandas_udf(METADATA)
    def run(column: pd.Series) -> pd.DataFrame:
        out = []
        for raw in column:
            try:
                out.append(_facts(bytes(raw)) if raw is not None else dict.fromkeys(("infohash_hex", "name", "total_size", "files", "error")))
            except (ValueError, TypeError, AttributeError) as e:
                out.append({"infohash_hex": None, "name": None, "total_size": None, "files": None, "error": str(e)})
        return pd.DataFrame(out, columns=["infohash_hex", "name", "total_size", "files", "error"])

    return run(data)


def single_file_info(name: Column, length: Column) -> Column:
    """The bencoded info dictionary of one file, by string functions alone."""
    return F.concat(F.lit("d6:lengthi"), length.cast("string"), F.lit("e4:name"), F.octet_length(name).cast("string"), F.lit(":"), name, F.lit("e"))


def total_size(files: Column) -> Column:
    return F.aggregate(files, F.lit(0).cast("long"), lambda total, f: total + F.coalesce(f["size"], F.lit(0)))

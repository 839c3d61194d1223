"""Helpers for ``mapInArrow`` functions: bounded output batches and unique row numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def text_rows(batches: Iterable[pa.RecordBatch], id_index: int = 0, text_index: int = 1) -> Iterator[tuple[int | None, str]]:
    """(id, text) pairs; a null text is the empty text."""
    for batch in batches:
        for i, t in zip(batch.column(id_index), batch.column(text_index), strict=True):
            yield i.as_py(), t.as_py() or ""


def in_chunks(rows: Iterable[tuple[int | None, str]], most_chars: int = 2_000_000, most_rows: int = 4096) -> Iterator[list[tuple[int | None, str]]]:
    """Lists of rows with about ``most_chars`` characters, so that what a task holds does not grow with its input."""
    chunk, size = [], 0
    for row in rows:
        chunk.append(row)
        size += len(row[1])
        if size >= most_chars or len(chunk) >= most_rows:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def row_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives: the partition in the high bits, a counter below."""
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    n = 0
    while True:
        yield base + n
        n += 1

"""Ingest counters as a stream: what a status page would poll, kept by the engine's own state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from folio.operators.progress import counters


def streaming_counters(rows: DataFrame, group: str, inserted: Column) -> DataFrame:
    """The counters of :func:`folio.operators.progress.counters` over a streaming table; write it in update or complete mode."""
    return counters(rows, group, inserted)

"""Runs that stopped without saying so: a stateful stream with timers, and the same over a whole table.

A run sends beats, and ``finish`` at its end.  It is ``running`` from a beat on; if none follows for
``silence`` seconds it is ``stopped`` (reason ``not_running``) as of that moment, until it beats again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINISH = "finish"
STATES = "run string, state string, reason string, at timestamp, last_beat timestamp"


def run_states(beats: DataFrame, silence: int, lateness: str = "1 minute") -> DataFrame:
    """Changes of state of each run of a streaming table (``run``, ``ts``, ``event``), in append mode.

    Timers follow the watermark, which trails the newest beat of any run by ``lateness``; beats of a run that are later than
    that are dropped, those that come out of order before it count by their own time.
    """
    from folio.sources.shipping import ship_package

    ship_package(beats.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield _rows([(key[0], "stopped", "not_running", last + silence * 1000, last)])
            return
        last = state.get[0] if state.exists else None
        got = pd.concat(list(batches))
        out = []
        for at, event in sorted(zip(got["ts"].astype("datetime64[ms]").astype("int64").tolist(), got["event"], strict=True)):
            if last is not None and at - last > silence * 1000:
                out.append((key[0], "stopped", "not_running", last + silence * 1000, last))
                last = None
            if event == FINISH:
                out.append((key[0], "finished", None, at, at))
                last = None
            else:
                if last is None:
                    out.append((key[0], "running", None, at, at))
                last = at if last is None else max(at, last)
        if last is None:
            state.remove()
        else:
            state.update((last,))
            # A timer can't lie before the watermark; such a run stops at once with the next one.
            state.setTimeoutTimestamp(max(last + silence * 1000, state.getCurrentWatermarkMs() + 1))
        yield _rows(out)

    rows = beats.select(F.col("run").cast("string").alias("run"), "ts", F.col("event").cast("string").alias("event")).where("run IS NOT NULL AND ts IS NOT NULL")
    return rows.withWatermark("ts", lateness).groupBy("run").applyInPandasWithState(step, STATES, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["run", "state", "reason", "at", "last_beat"])
    for c in ("at", "last_beat"):
        out[c] = pd.to_datetime(out[c], unit="ms")
    return out


def runs_now(beats: DataFrame, silence: int, now=None) -> DataFrame:
    """The state of each run of a whole table as of ``now`` (its newest beat, if not given): ``run``, ``state``, ``reason``, ``last_beat``, and how often it had stopped by then, ``stops``.

    One row a run with a beat; null runs and times are left out.  Gaps are found by a window over a run's beats; a run
    of very many beats is sorted by its task, not held.
    """
    rows = beats.where("run IS NOT NULL AND ts IS NOT NULL").select("run", "ts", (F.col("event") == FINISH).alias("_end"))
    newest = F.lit(now) if now is not None else None
    order = Window.partitionBy("run").orderBy("ts", F.coalesce("_end", F.lit(False)))
    before, ended = F.lag("ts").over(order), F.coalesce(F.lag("_end").over(order), F.lit(True))
    late = (F.unix_millis("ts") - F.unix_millis(before) > silence * 1000) & ~ended
    runs = rows.select("run", "ts", "_end", F.coalesce(late, F.lit(False)).alias("_late")).groupBy("run").agg(F.max(F.struct("ts", F.coalesce("_end", F.lit(False)).alias("end"))).alias("last"), F.count_if("_late").alias("stops"))
    whole = rows.agg(F.max("ts").alias("_now")) if newest is None else beats.sparkSession.range(1).select(newest.alias("_now"))
    at = runs.crossJoin(F.broadcast(whole))  # one row
    silent = F.unix_millis("_now") - F.unix_millis("last.ts") > silence * 1000
    state = F.when(F.col("last.end"), "finished").when(silent, "stopped").otherwise("running")
    stops = F.col("stops") + (state == "stopped").cast("long")
    return at.select("run", state.alias("state"), F.when(state == "stopped", "not_running").alias("reason"), F.col("last.ts").alias("last_beat"), stops.alias("stops"))

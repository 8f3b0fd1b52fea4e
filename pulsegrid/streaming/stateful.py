"""Structured Streaming forms of the stateful operators.

stream_fold has the signature of windows.ordered_fold, so the operators run the very same steps on streams.

With `late` (an interval such as "50 milliseconds" of event time) rows wait in the state of their key until the watermark has
passed them and are then folded in order, by an event-time timer, so any arrival within that interval gives the result of the
batch; later rows are left out. A key that has been silent for `idle_ms` of event time is dropped, also by a timer: what it
sends after that starts afresh, whichever trigger brings it.

Without `late` a trigger's rows of a key are sorted before they are folded; a row that comes in a later trigger than rows of a
later time is folded where it comes, and a key silent for `ttl_ms` of processing time is dropped."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

from ..operators import direction, velocity
from ..operators.dstream import DStream


#: transformWithState keeps its state in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Time 0 in us of event time: a watermark begins at 0, and rows at it count as late.
BEGIN = 1000


class InOrder(StatefulProcessor):
    """Keeps the rows of a key until the watermark has passed them, then folds them in order."""

    def __init__(self, names: list[str], order: list[str], columns: list[str], start: Callable[[tuple], Any], step: Callable[[Any, tuple], Any], idle_ms: int | None, us: float):
        self.names, self.order, self.columns, self.start, self.step, self.idle_ms, self.us = names, order, columns, start, step, idle_ms, us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "state binary, last long")  # last: ms of the newest row folded
        self.waiting = handle.getListState("waiting", "at long, row binary")  # at: us
        self.due = handle.getValueState("due", "ms long")  # the one timer that is set

    def _set(self, ms: int) -> None:
        if self.due.exists():
            if (old := self.due.get()[0]) <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            at = ((pdf[self.order[0]] * self.us).astype("int64") + BEGIN).tolist()
            need = list(zip(*(pdf[c].tolist() for c in dict.fromkeys([*self.order, *self.columns])), strict=True))
            self.waiting.appendList([(a, pickle.dumps(r)) for a, r in zip(at, need, strict=True)])
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self._set(first // 1000 + 1)
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.due.clear()
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((pickle.loads(r) for a, r in rows if a <= now * 1000), key=lambda r: r[: len(self.order)])
        held = [(a, r) for a, r in rows if a > now * 1000]
        out: list[tuple] = []
        known = self.folded.get() if self.folded.exists() else None
        state, last = (pickle.loads(known[0]), known[1]) if known else (None, None)
        at = {c: k for k, c in enumerate(dict.fromkeys([*self.order, *self.columns]))}
        for row in ready:
            t = (int(row[0] * self.us) + BEGIN) // 1000
            if state is None or self.idle_ms is not None and t - last > self.idle_ms:
                state = self.start(key)
            out.extend(self.step(state, tuple(row[at[c]] for c in self.columns)) or ())
            last = t
        if held:
            self.waiting.put(held)
            self._set(min(a for a, _ in held) // 1000 + 1)
        else:
            self.waiting.clear()
        if state is not None and self.idle_ms is not None and now - last > self.idle_ms:
            self.folded.clear()
        elif state is not None:
            self.folded.update((pickle.dumps(state), last))
            if self.idle_ms is not None:
                self._set(last + self.idle_ms + 1)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, start: Callable[[tuple], Any], step: Callable[[Any, tuple], Any], ttl_ms: int | None = None, late: str | None = None, idle_ms: int | None = None, us: float = 1) -> DataFrame:
    """us: microseconds a unit of order's first column, which is the event time. `late` needs the session's state store to be
    STORE."""
    if late is not None:
        if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
            raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
        need = list(dict.fromkeys([*keys, *order, *columns]))
        timed = df.select(*need, F.timestamp_micros((F.col(order[0]) * us).cast("long") + BEGIN).alias("__ts")).withWatermark("__ts", late)
        fold = InOrder(_parse_datatype_string(schema).names, order, columns, start, step, idle_ms, us)
        return timed.groupBy(*keys).transformWithStateInPandas(fold, schema, "Append", "EventTime")
    names = _parse_datatype_string(schema).names

    def fold(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        s = pickle.loads(state.get[0]) if state.exists else start(key)
        rows = pd.concat(list(pdfs)).sort_values(order)
        out = []
        for row in zip(*(rows[c].tolist() for c in columns), strict=True):
            out.extend(step(s, row) or ())
        state.update((pickle.dumps(s),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    need = list(dict.fromkeys([*keys, *order, *columns]))
    return df.select(*need).groupBy(*keys).applyInPandasWithState(fold, schema, "state binary", "append", timeout)


def stream_patch_direction(df: DataFrame, k: int, **state) -> DataFrame:
    """patch_direction of a stream (each patch starts afresh). state, here and below: ttl_ms, late, idle_ms, us of stream_fold."""
    return direction.patch_direction(df, k, fold=partial(stream_fold, **state))


def stream_multipatch_direction(df: DataFrame, k: int, **state) -> DataFrame:
    return direction.multipatch_direction(df, k, fold=partial(stream_fold, **state))


def stream_roi(events: DataFrame, roi: DataFrame, k: int, **state) -> DataFrame:
    """Events of blocks that are on when they come."""
    return direction.roi_mask_fold(events, roi, k, fold=partial(stream_fold, **state))


def stream_densities(df: DataFrame, grid: int = 5, tau: float = 5e4, **state) -> DataFrame:
    """The decayed count of each event's grid cell just after it."""
    return DStream(grid=grid, tau=tau).densities(df, partial(stream_fold, **state))


def stream_momentum(df: DataFrame, dt: int, cluster: str = "cluster_id", **state) -> DataFrame:
    return velocity.momentum_path(df, dt, cluster, fold=partial(stream_fold, **state))


def stream_decay_votes(df: DataFrame, dt: int, cluster: str = "cluster_id", pol: str = "pol", **state) -> DataFrame:
    return velocity.decay_votes_path(df, dt, cluster, pol, fold=partial(stream_fold, **state))


def stream_frames(df: DataFrame, dt_us: int, late: str = "0 seconds") -> DataFrame:
    """Counts per (frame start, y, x) of a stream with an event-time column `ts`: a watermarked tumbling window."""
    w = F.window("ts", f"{dt_us} microseconds")
    return df.withWatermark("ts", late).groupBy(w.alias("w"), "y", "x").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "y", "x", "n")

"""Crash tracking and silence as keyed state with processing-time timers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.crash import FLUSH_MS, SERVICE_EVENT, STOP_MS, Trace, Tracker, marked

COLUMNS = [c.split()[0] for c in SERVICE_EVENT.split(", ")]


def frozen(tracker: Tracker) -> str:
    return json.dumps(asdict(tracker))


def thawed(text: str) -> Tracker:
    own = json.loads(text)
    trace = own.pop("trace")
    return Tracker(**own, trace=Trace(**trace) if trace else None)


class CrashProcessor(StatefulProcessor):
    """Rows (service, pos, t_ms, raw, marker, pid, file, event) of one service to its events.

    Events are ``line``, ``restart``, and ``tick`` for a clock of one's own; with processing time a timer flushes a trace
    and notices a stop as well.
    """

    def __init__(self, timers: bool = True) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "text string")

    def _save(self, tracker: Tracker, now: int) -> None:
        self.state.update((frozen(tracker),))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if tracker.trace:
                self.handle.registerTimer(now + FLUSH_MS)
            elif tracker.busy and not tracker.journal:
                self.handle.registerTimer(now + STOP_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        tracker = thawed(self.state.get()[0]) if self.state.exists() else Tracker(key[0])
        frame = pd.concat(list(rows)).sort_values("pos", kind="stable")
        out: list[dict] = []
        for r in frame.itertuples(index=False):
            t = int(r.t_ms)
            tracker.file = tracker.file or r.file or ""
            out += tracker.tick(t)
            if r.event == "restart":
                out += tracker.restart(t)
            elif r.event == "line":
                out += tracker.line(t, r.raw or "", r.marker if isinstance(r.marker, str) else None, None if pd.isna(r.pid) else int(r.pid))
        self._save(tracker, timerValues.getCurrentProcessingTimeInMs() if self.timers else 0)
        yield pd.DataFrame(out, columns=COLUMNS).astype({"pid": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        if self.state.exists():
            tracker, now = thawed(self.state.get()[0]), timerValues.getCurrentProcessingTimeInMs()
            out = tracker.tick(max(now, tracker.last_ms))
            self._save(tracker, now)
        yield pd.DataFrame(out, columns=COLUMNS).astype({"pid": "Int64"})

    def close(self) -> None:
        pass


def track_stream(lines: DataFrame, custom: tuple[str, ...] = (), timers: bool = True) -> DataFrame:
    """Service events of a stream of lines (service, pos, t_ms, raw, file, event)."""
    own = marked(lines, custom).select("service", "pos", "t_ms", "raw", "marker", "pid", "file", "event")
    return own.groupBy("service").transformWithStateInPandas(CrashProcessor(timers), SERVICE_EVENT, "Append", "ProcessingTime" if timers else "None")


class SilenceProcessor(StatefulProcessor):
    """Rows (file, t_ms) of one file to (file, ts_ms) whenever it has been silent for the window, once for each multiple of it."""

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.window_ms)
        yield pd.DataFrame({"file": pd.Series(dtype=str), "ts_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer((now // self.window_ms + 1) * self.window_ms)
        yield pd.DataFrame({"file": [key[0]], "ts_ms": [now]})

    def close(self) -> None:
        pass


def silence_stream(lines: DataFrame, window_ms: int) -> DataFrame:
    return lines.groupBy("file").transformWithStateInPandas(SilenceProcessor(window_ms), "file string, ts_ms long", "Append", "ProcessingTime")

"""Crash tracking: markers, stack traces, stops and restarts of services."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import analyse, pid, truncate_bytes
from ..functions.search import pattern_match

#: Crash texts in the order in which they are looked for, after the levels Fatal and Panic.
TEXT_MARKERS = [("go_panic", "panic:"), ("python_traceback", "Traceback (most recent call last):"), ("java_exception", "Exception in thread ")]
#: How the lines of a stack trace start.
TRACE_START = r"^(?:\t|  |goroutine |\[signal |Caused by:|0x)"
TRACE_LINES, TRACE_BYTES, DETAIL_BYTES = 32, 4096, 256
FLUSH_MS, STOP_MS = 250, 30_000
SERVICE_EVENT = "ts_ms long, kind string, service string, file string, marker string, pid long, crash_count long, restart_count long, detail string, stack_trace string"
_TRACE = re.compile(TRACE_START)


def crash_marker(raw: Column, level: Column, custom: tuple[str, ...] = ()) -> Column:
    """The label of the marker that a line has, null if none."""
    out = F.when(level == "Fatal", "fatal_level").when(level == "Panic", "panic_level")
    for label, text in TEXT_MARKERS:
        out = out.when(raw.contains(text), label)
    for p in custom:
        out = out.when(pattern_match(raw, p), "custom_regex")
    return out


def is_trace_line(raw: Column) -> Column:
    return raw.rlike(TRACE_START)


def detail(raw: Column) -> Column:
    return truncate_bytes(raw, DETAIL_BYTES)


def _cut(text: str, most: int) -> str:
    return text.encode()[:most].decode(errors="ignore")


@dataclass
class Trace:
    """The lines of a stack trace within the limits."""

    started_ms: int
    text: str = ""
    lines: int = 0

    def take(self, line: str) -> bool:
        """Whether the line belongs to the trace; an empty one does only before all others."""
        if self.lines < TRACE_LINES and not line and not self.text:
            return True
        room = TRACE_BYTES - len(self.text.encode())
        if self.lines >= TRACE_LINES or room < 2 or not _TRACE.match(line):
            return False
        self.text += _cut(line, room - 1) + "\n"
        self.lines += 1
        return True


@dataclass
class Tracker:
    """One service: ``line``, ``tick`` and ``restart`` return the events that they lead to."""

    service: str
    file: str = ""
    journal: bool = False
    last_ms: int = 0
    crashes: int = 0
    restarts: int = 0
    after_crash: bool = False
    stopped: bool = False
    pending: dict | None = None
    trace: Trace | None = field(default=None)

    def _event(self, now: int, kind: str, **more: object) -> dict:
        base = {"ts_ms": now, "kind": kind, "service": self.service, "file": self.file, "marker": None, "pid": None, "crash_count": self.crashes, "restart_count": self.restarts, "detail": None, "stack_trace": None}
        return base | more

    def _crash(self, now: int) -> dict:
        event = self._event(now, "service_crash", **self.pending, stack_trace=self.trace.text or None)
        self.pending = self.trace = None
        self.after_crash, self.stopped = True, False
        return event

    def line(self, now: int, text: str, marker: str | None, pid: int | None) -> list[dict]:
        self.last_ms = now
        if self.trace:
            return [] if self.trace.take(text) else [self._crash(now)]
        if marker:
            self.crashes += 1
            self.pending = {"marker": marker, "pid": pid, "detail": _cut(text, DETAIL_BYTES)}
            self.trace = Trace(now)
            self.after_crash = self.stopped = False
        return []

    def tick(self, now: int, flush_ms: int = FLUSH_MS, stop_ms: int = STOP_MS) -> list[dict]:
        if self.trace:
            return [self._crash(now)] if now - self.trace.started_ms >= flush_ms else []
        if self.after_crash and not self.stopped and not self.journal and now - self.last_ms >= stop_ms:
            self.stopped = True
            return [self._event(now, "service_stop")]
        return []

    def restart(self, now: int) -> list[dict]:
        self.last_ms, self.restarts = now, self.restarts + 1
        self.pending = self.trace = None
        self.after_crash = self.stopped = False
        return [self._event(now, "service_restart")]

    @property
    def busy(self) -> bool:
        """Whether a crash of this service is known and not over."""
        return self.trace is not None or self.after_crash and not self.stopped


def marked(lines: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """Lines with ``marker`` and ``pid``, found natively; ``level`` is taken from the line unless there is such a column."""
    level = F.col("level") if "level" in lines.columns else analyse(F.col("raw"))["level"]
    marker = crash_marker(F.col("raw"), level, custom)
    return lines.withColumn("marker", marker).withColumn("pid", F.when(F.col("marker").isNotNull(), pid(F.col("raw"))))


def track(lines: DataFrame, until_ms: int | None = None, custom: tuple[str, ...] = (), journal: bool = False) -> DataFrame:
    """Service events of lines (service, pos, t_ms, raw, and optionally file and event: ``line`` or ``restart``).

    Rows are dealt by service, sorted by pos and streamed through one small state; the clock is t_ms, and ``until_ms`` is
    when the watch ends.  No service's lines are ever held.
    """
    own = marked(lines, custom)
    for name, value in (("file", F.lit("")), ("event", F.lit("line"))):
        if name not in own.columns:
            own = own.withColumn(name, value)
    ordered = own.select("service", "pos", "t_ms", "raw", "marker", "pid", "file", "event").repartition("service").sortWithinPartitions("service", "pos")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Tracker | None = None
        columns = [c.split()[0] for c in SERVICE_EVENT.split(", ")]

        def give(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"pid": "Int64"})

        def close() -> list[dict]:
            return [] if now is None or until_ms is None else [*now.tick(until_ms), *now.tick(until_ms)]

        for frame in frames:
            out: list[dict] = []
            for r in frame.itertuples(index=False):
                if now is None or now.service != r.service:
                    out += close()
                    now = Tracker(r.service, r.file or "", journal, int(r.t_ms))
                t = int(r.t_ms)
                out += now.tick(t)
                if r.event == "restart":
                    out += now.restart(t)
                else:
                    out += now.line(t, r.raw or "", r.marker if isinstance(r.marker, str) else None, None if pd.isna(r.pid) else int(r.pid))
            if out:
                yield give(out)
        if rest := close():
            yield give(rest)

    return ordered.mapInPandas(run, SERVICE_EVENT)


def name_services(lines: DataFrame, bindings: list[tuple[str, str]]) -> DataFrame:
    """Lines of the files that a service is bound to, with its name; of several bindings of a file the first counts."""
    first: dict[str, str] = {}
    for name, path in bindings:
        first.setdefault(path, name)
    table = lines.sparkSession.createDataFrame([(p, n) for p, n in first.items()], "file string, service string")
    return lines.join(F.broadcast(table), "file")  # as many rows as flags were given

"""System-journal entries: classes of manager messages, levels, units, and routing to crash trackers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import priority_level
from ..functions.search import glob_match
from .crash import SERVICE_EVENT, Tracker, crash_marker

#: How routine messages of the service manager start.
LIFECYCLE = ("Started ", "Stopping ", "Stopped ", "Reloading ", "Reloaded ", "Deactivated successfully", "Consumed ", "Scheduled restart", "Starting ")
#: What messages about a crash hold.
CRASH_TEXTS = ("Main process exited, code=killed", "Main process exited, code=dumped", "Failed with result 'signal'", "Failed with result 'core-dump'", "Failed with result 'oom-kill'", "Failed with result 'watchdog'")
MOST_UNITS = 256
PSEUDO_PATH = "journal://"


def manager_class(message: Column) -> Column:
    """``lifecycle``, ``crash_signal`` or ``other``; how a message starts goes before what it holds."""
    starts = reduce(lambda a, b: a | b, [message.startswith(p) for p in LIFECYCLE])
    holds = reduce(lambda a, b: a | b, [message.contains(t) for t in CRASH_TEXTS])
    return F.when(starts, "lifecycle").when(holds, "crash_signal").otherwise("other")


def entry_pid(text: Column) -> Column:
    number = F.when(text.rlike(r"^\+?[0-9]+$"), text).try_cast("bigint")
    return F.when(number <= 0xFFFFFFFF, number)


def route(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries (message, unit, identifier, priority, pid) with level and ``route``: ``app``, ``systemd_crash`` or null.

    Empty messages are dropped; an entry without a unit counts as the pattern itself, and others must match it.
    """
    unit = F.coalesce("unit", F.lit(pattern))
    own = entries.filter(F.length("message") > 0).withColumn("unit", unit).filter(glob_match(F.col("unit"), pattern))
    manager = F.coalesce(F.col("identifier") == "systemd", F.lit(False))
    kind = F.when(~manager, "app").when(manager_class(F.col("message")) == "crash_signal", "systemd_crash")
    return own.withColumn("level", priority_level(F.col("priority"))).withColumn("pid", entry_pid(F.col("pid"))).withColumn("route", kind)


def track_units(entries: DataFrame, name: str, pattern: str, until_ms: int | None = None, custom: tuple[str, ...] = ()) -> DataFrame:
    """Crash events of the units of one source, from entries with (pos, t_ms).

    The manager's notice of a crash counts only if the unit's own log has not told of it.  Levels come from the priority
    alone, and units have neither stops nor restarts.
    """
    own = route(entries, pattern).filter(F.col("route").isNotNull())
    own = own.withColumn("marker", F.when(F.col("route") == "app", crash_marker(F.col("message"), F.col("level"), custom)))
    from ..functions.lines import pid as pid_of

    own = own.withColumn("said_pid", F.when(F.col("marker").isNotNull(), pid_of(F.col("message"))))
    ordered = own.select("unit", "pos", "t_ms", "message", "marker", "said_pid", "pid", "route").repartition("unit").sortWithinPartitions("unit", "pos")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Tracker | None = None
        columns = [c.split()[0] for c in SERVICE_EVENT.split(", ")]
        number = lambda x: None if pd.isna(x) else int(x)
        for frame in frames:
            out: list[dict] = []
            for r in frame.itertuples(index=False):
                path = PSEUDO_PATH + r.unit
                if now is None or now.file != path:
                    out += now.tick(until_ms) if now and until_ms is not None else []
                    now = Tracker(name, path, journal=True, last_ms=int(r.t_ms))
                t = int(r.t_ms)
                out += now.tick(t)
                if r.route == "app":
                    out += now.line(t, r.message, r.marker if isinstance(r.marker, str) else None, number(r.said_pid))
                elif not now.busy:
                    out.append({"ts_ms": t, "kind": "service_crash", "service": name, "file": path, "marker": "systemd_signal", "pid": number(r.pid), "crash_count": 1, "restart_count": 0, "detail": r.message, "stack_trace": None})
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"pid": "Int64"})
        if now and until_ms is not None and (rest := now.tick(until_ms)):
            yield pd.DataFrame(rest, columns=columns).astype({"pid": "Int64"})

    return ordered.mapInPandas(run, SERVICE_EVENT)

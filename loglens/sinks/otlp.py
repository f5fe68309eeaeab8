"""Telemetry records and requests (OTLP over HTTP with protocol buffers)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import protobuf as pb

#: Severity numbers.
SEVERITY = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}
SCOPE = "loglens"
CUMULATIVE = 2
MOST_RECORDS = 256
ATTRIBUTES = "array<struct<key:string,string_value:string,int_value:bigint,bool_value:boolean>>"


def _attributes(*pairs: tuple[str, Column, str]) -> Column:
    """Attributes from (key, value, ``s`` or ``i``), those without a value left out."""
    made = [
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), (v if kind == "s" else F.lit(None)).cast("string").alias("string_value"), (v if kind == "i" else F.lit(None)).cast("bigint").alias("int_value"), F.lit(None).cast("boolean").alias("bool_value")))
        for k, v, kind in pairs
    ]
    return F.array_compact(F.array(*made))


def _record(events: DataFrame, severity: Column, body: Column, attributes: Column, *keep: str) -> DataFrame:
    return events.select(*keep, (F.col("ts_ms") * 1_000_000).alias("time_ns"), severity.alias("severity"), body.alias("body"), attributes.alias("attributes"))


def _some(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def rule_records(fired: DataFrame, *keep: str) -> DataFrame:
    """(time_ns, severity, body, attributes) of fired rules, behind the columns to keep."""
    severity = F.when(F.col("kind") == "silence", "warn").when(F.col("kind") == "first_seen", "info").otherwise("error")
    body = F.format_string("alert %s/%s fired (%d/%d in %dms)", "kind", "rule_id", "observed_count", "threshold.count", "threshold.window_ms")
    attributes = _attributes(("alert.kind", F.col("kind"), "s"), ("alert.rule_id", F.col("rule_id"), "s"), ("log.file.path", F.col("file"), "s"), ("alert.threshold_count", F.col("threshold.count"), "i"), ("alert.threshold_window_ms", F.col("threshold.window_ms"), "i"), ("alert.observed_count", F.col("observed_count"), "i"), ("log.line", F.col("line"), "s"))
    return _record(fired, severity, body, attributes, *keep)


def service_records(events: DataFrame) -> DataFrame:
    severity = F.when(F.col("kind") == "service_crash", "error").otherwise("info")
    attributes = _attributes(("event.kind", F.col("kind"), "s"), ("service.name", F.col("service"), "s"), ("log.file.path", F.col("file"), "s"), ("crash.marker", _some("marker"), "s"), ("process.pid", F.col("pid"), "i"), ("exception.stacktrace", _some("stack_trace"), "s"), ("service.crash_count", F.col("crash_count"), "i"), ("service.restart_count", F.col("restart_count"), "i"))
    return _record(events, severity, F.coalesce(_some("detail"), F.col("kind")), attributes)


def kernel_records(events: DataFrame) -> DataFrame:
    severity = F.when(F.col("kind") == "kernel_panic", "fatal").otherwise("error")
    attributes = _attributes(("event.kind", F.col("kind"), "s"), ("kernel.source", F.col("source"), "s"), ("process.pid", F.when(F.col("pid") != 0, F.col("pid")), "i"), ("process.executable.name", _some("comm"), "s"))
    return _record(events, severity, F.coalesce("detail", F.lit("")), attributes)


def any_value(value: str | int | bool) -> bytes:
    if isinstance(value, bool):
        return pb.number(2, value)
    return pb.number(3, value) if isinstance(value, int) else pb.chunk(1, value)


def key_value(field: int, key: str, value: str | int | bool) -> bytes:
    return pb.chunk(field, pb.chunk(1, key) + pb.chunk(2, any_value(value)))


def _request(resource: dict[str, Any], body: bytes) -> bytes:
    """One resource with one scope around records or metrics: logs and metrics requests share this shape."""
    own = pb.chunk(1, b"".join(key_value(1, k, v) for k, v in resource.items()))
    return pb.chunk(1, own + pb.chunk(2, pb.chunk(1, pb.chunk(1, SCOPE)) + body))


def log_record(time_ns: int, severity: str, body: str, attributes: Iterable[tuple[str, Any]]) -> bytes:
    return b"".join([pb.fixed64(1, time_ns), pb.number(2, SEVERITY[severity]), pb.chunk(3, severity.upper()), pb.chunk(5, pb.chunk(1, body)), *(key_value(6, k, v) for k, v in attributes), pb.fixed64(11, time_ns)])


def logs_request(resource: dict[str, Any], records: Iterable[tuple[int, str, str, Iterable[tuple[str, Any]]]]) -> bytes:
    """A request for records of (time, severity, body, attributes)."""
    return _request(resource, b"".join(pb.chunk(2, log_record(*r)) for r in records))


def metrics_request(resource: dict[str, Any], points: Sequence[dict[str, Any]], now_ns: int, start_ns: int) -> bytes:
    """A request for points (name, value, and optionally description, monotonic, attributes); neighbours of one name make one metric."""
    metrics = []
    for (name, monotonic), own in groupby(points, key=lambda p: (p["name"], p.get("monotonic", True))):
        group = list(own)
        data = b"".join(pb.chunk(1, b"".join(key_value(7, k, v) for k, v in p.get("attributes", {}).items()) + pb.fixed64(2, start_ns) + pb.fixed64(3, now_ns) + pb.fixed64(6, p["value"])) for p in group)
        about = group[0].get("description")
        kind = pb.chunk(7, data + pb.number(2, CUMULATIVE) + pb.number(3, 1)) if monotonic else pb.chunk(5, data)
        metrics.append(pb.chunk(2, pb.chunk(1, name) + (pb.chunk(2, about) if about else b"") + kind))
    return _request(resource, b"".join(metrics))


def plain_attributes(attributes: Iterable[Any]) -> list[tuple[str, Any]]:
    """(key, value) of rows as ``rule_records`` and the others make them."""
    return [(a["key"], next(v for v in (a["string_value"], a["int_value"], a["bool_value"]) if v is not None)) for a in attributes]


def requests_of(records: DataFrame, resource: dict[str, Any], most: int = MOST_RECORDS) -> DataFrame:
    """(body, records): requests of at most ``most`` records each, built where the records are."""

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            for a in range(0, len(rows), most):
                own = rows[a : a + most]
                body = logs_request(resource, [(r["time_ns"], r["severity"], r["body"], plain_attributes(r["attributes"])) for r in own])
                yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary()), pa.array([len(own)], pa.int64())], ["body", "records"])

    return records.select("time_ns", "severity", "body", "attributes").mapInArrow(run, "body binary, records long")

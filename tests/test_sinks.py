"""Payloads, wire formats, transports, metrics text."""

from __future__ import annotations

import gzip
import json
import urllib.request

import pytest
from pyspark.sql import functions as F

from loglens.functions.lines import analyse
from loglens.operators.rules import Threshold, error_rate
from loglens.sinks import dispatch, exposition, jsonl, otlp, protobuf, terminal, transport

from .test_lines import one
from .test_operators import events


def test_line_json(spark):
    rows = ['[ERROR] "q" \\ \t\x01\x7f ä', "plain"]
    got = one(spark, rows, jsonl.line_json(F.col("x"), analyse(F.col("x"))))
    assert json.loads(got[0]) == {"level": "Error", "date": "", "time": "", "raw": rows[0]}
    assert "\\u0001\\u007F" in got[0] and got[1] == '{"level":"","date":"","time":"","raw":"plain"}'


def test_service_and_kernel_json(spark):
    s = spark.createDataFrame([(5, "service_stop", "api", "/f", None, None, 1, 0, None, "")], "ts_ms long, kind string, service string, file string, marker string, pid long, crash_count long, restart_count long, detail string, stack_trace string")
    assert s.select(jsonl.service_json()).first()[0] == '{"ts_ms":5,"kind":"service_stop","service":"api","file":"/f","crash_count":1,"restart_count":0}'
    k = spark.createDataFrame([(5, "kernel_oom", "kmsg", 7, "app", None)], "ts_ms long, kind string, source string, pid long, comm string, detail string")
    assert k.select(jsonl.kernel_json()).first()[0] == '{"ts_ms":5,"kind":"kernel_oom","source":"kmsg","pid":7,"comm":"app"}'
    (record,) = otlp.kernel_records(k).collect()
    assert record["severity"] == "error" and otlp.plain_attributes(record["attributes"])[-2:] == [("process.pid", 7), ("process.executable.name", "app")]


def test_protobuf():
    assert protobuf.varint(300) == b"\xac\x02" and protobuf.varint(-1) == b"\xff" * 9 + b"\x01"
    assert protobuf.number(1, 150) == b"\x08\x96\x01" and protobuf.chunk(2, "testing") == b"\x12\x07testing"
    assert protobuf.fixed64(1, 1) == b"\x09" + b"\x01" + b"\0" * 7 and protobuf.fixed32(1, 1) == b"\x0d\x01\0\0\0"
    assert protobuf.fields(protobuf.number(1, 5) + protobuf.chunk(2, b"x") + protobuf.fixed64(3, 2)) == [(1, 5), (2, b"x"), (3, b"\x02" + b"\0" * 7)]
    with pytest.raises(ValueError):
        protobuf.fields(b"\x12\x09x")


def test_requests():
    body = otlp.logs_request({"service.name": "x"}, [(7, "warn", "hi", [("a", 1), ("b", True), ("c", "s")])])
    ((_, resource_logs),) = protobuf.fields(body)
    (_, resource), (_, scope) = protobuf.fields(resource_logs)
    (_, record) = protobuf.fields(scope)[1]
    assert [f for f, _ in protobuf.fields(record)] == [1, 2, 3, 5, 6, 6, 6, 11] and dict(protobuf.fields(record))[2] == 13
    points = [{"name": "a", "value": 1, "attributes": {"l": "x"}}, {"name": "a", "value": 2}, {"name": "g", "value": 3, "monotonic": False}]
    ((_, rm),) = protobuf.fields(otlp.metrics_request({}, points, 9, 1))
    metrics = [m for f, m in protobuf.fields(protobuf.fields(rm)[1][1]) if f == 2]
    assert [[f for f, _ in protobuf.fields(m)] for m in metrics] == [[1, 7], [1, 5]]
    assert [f for f, _ in protobuf.fields(protobuf.fields(metrics[0])[1][1])] == [1, 1, 2, 3]


def test_collector_retries():
    calls, waits, answers = [], [], [503, 0, 200]
    c = transport.Collector("https://c/", post=lambda u, b, h: calls.append((u, gzip.decompress(b))) or answers[len(calls) - 1], sleep=waits.append)
    assert c.send("/v1/logs", b"x", 3) and c.sent == 3 and calls[0] == ("https://c/v1/logs", b"x") and waits == [0.1, 0.2]
    no = transport.Collector("https://c", post=lambda *_: 400, sleep=waits.append)
    assert not no.send("/", b"") and no.failed == 1
    busy = transport.Collector("https://c", post=lambda *_: 429, sleep=lambda _: None)
    assert not busy.send("/", b"") and busy.failed_retryable == 1
    with pytest.raises(ValueError):
        transport.Collector("http://c")
    assert [transport.wait_ms(i) for i in (1, 2, 7)] == [100, 200, 5000] and not transport.retryable(404)


def test_webhook_sends_the_whole_batch():
    got = []
    w = transport.Webhook(["http://w"], post=lambda u, b, h: got.append(b) or 200)
    w.send(str(i) for i in range(1000))
    assert got == [str(i).encode() for i in range(1000)] and (w.sent, w.dropped) == (1000, 0)


def test_dispatch(spark, tmp_path):
    hooks, sent, stopped = [], [], []
    d = dispatch.Dispatcher(folder=str(tmp_path / "out"), webhook=transport.Webhook(["http://w"], most=1, post=lambda u, b, h: hooks.append(json.loads(b)) or 200), collector=transport.Collector("https://c", post=lambda u, b, h: sent.append(b) or 200), stop=lambda: stopped.append(1))
    fired = error_rate(events(spark, [0, 1, 1000, 1001]), Threshold(2, 80))
    assert d.dispatch(fired, "rule") == 2 and d.alerts == {"error_rate": 2}
    assert len(hooks) == 1 and d.webhook.dropped == 1 and d.collector.sent == 2 and stopped
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert hooks[0]["threshold"] == {"count": 2, "window_ms": 80} and hooks[0]["rule_id"] == "error_rate"
    assert d.dispatch(fired.limit(0), "rule") == 0


def test_exposition(spark):
    s = exposition.Snapshot(uptime_seconds=3)
    s.add(spark.createDataFrame([("abc", "Error")], "raw string, level string"), spark.createDataFrame([("silence",)], "kind string"))
    text = s.text("p")
    assert 'p_lines_total{level="error"} 1\n' in text and 'p_alerts_fired_total{rule="silence"} 1' in text and text.count("# TYPE") == 8
    assert exposition.respond("/metrics", None, "t", s)[0] == 401 and exposition.respond("/metrics", "Bearer t", "t", s)[0] == 200
    assert exposition.respond("/healthz", None, "t", s)[0] == 200 and exposition.respond("/x", "Bearer t", "t", s)[0] == 404
    own = json.loads(exposition.respond("/metrics.json?x", "Bearer t", "t", s)[2])
    assert own["bytes_total"] == 3 and {"route": "other", "code": 404, "count": 1} in own["http_requests_total"]
    server = exposition.serve(lambda: s, "t", ("127.0.0.1", 0))
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/healthz", timeout=5) as r:
            assert r.status == 200 and r.headers["Cache-Control"] == "no-store"
    finally:
        server.shutdown()


def test_terminal(spark):
    assert terminal.styled("abc", None) == "abc" and "ERROR" in terminal.styled("abc", "Error", [(1, 2)]) and terminal.MARK + "b" in terminal.styled("abc", "Error", [(1, 2)])
    df = spark.createDataFrame([("x",)] * 5, "raw string").withColumn("info", analyse(F.col("raw")))
    assert [len(p) for p in terminal.show(df, 2)] == [2, 2, 1]
    assert terminal.summary({"Info": 2, "Error": 1}) == "Info: 2, Error: 1 | total: 3" and terminal.summary({}) == ""

"""Filters, groups, rules, crash tracking, journal, kernel, metrics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loglens.operators import crash, filters, grouping, journal, kernel, metrics, rules

from .test_lines import one


def log(spark, rows):
    return spark.createDataFrame([("f.log", i, r) for i, r in enumerate(rows)], "file string, line_no long, raw string")


@pytest.mark.parametrize(("time", "low", "high", "ok"), [("14:30", "14:00", "15:00", True), ("13:59", "14:00", "15:00", False), (None, "14:00", "15:00", True), ("15:00:00", "14:00", "15:00", False), ("14:00", "14:00", "14:00", True), ("13:59:59", "14:00", "14:00", False), ("14:00", "14:00:00", None, False)])
def test_time_range(spark, time, low, high, ok):
    assert one(spark, [time], filters.in_time_range(F.col("x"), low, high)) == [ok]


def test_date_range(spark):
    rows = ["2024-01-05", "2024-01-20", "2024-02-01", None]
    check = lambda text: one(spark, rows, filters.in_date_range(F.col("x"), *filters.parse_date_range(text)))
    assert check("2024-01-05") == [True, False, False, False]
    assert check("2024-01-05..2024-01-20") == [True, True, False, False]
    assert check("..2024-01-05") == [True, False, False, False]
    assert check("2024-01-06..") == [False, True, True, False]
    assert check("2024-01") == [False] * 4


def test_filter_conjunction(spark):
    rows = ["[ERROR] a 10:00", "[INFO] a", "", "[ERROR] b 23:00", "no level a"]
    wanted = filters.LogFilter(search="a", levels=("Error",), to_time="12:00")
    assert [r["raw"] for r in wanted.apply(log(spark, rows)).collect()] == ["[ERROR] a 10:00"]
    late = filters.LogFilter(levels=("Error",), to_time="12:00")
    assert late.apply(log(spark, rows), following=True).count() == 2


def test_groups_keep_first_line_and_order(spark):
    rows = ["b 1", "a", "b 2", "a", "b 3"]
    got = grouping.first_seen_order(grouping.group_lines(log(spark, rows), "normalized")).collect()
    assert [(r["key"], r["count"], r["sample"], r["first_pos"]) for r in got] == [("b #", 3, "b 1", 0), ("a", 2, "a", 1)]
    capped = grouping.group_lines(log(spark, rows), "normalized", most_keys=1)
    assert [r["key"] for r in capped.collect()] == ["b #"]
    assert {r["line"] for r in grouping.group_lines_prefixed(grouping.group_lines(log(spark, ["x", "x", "y"])), always=False).collect()} == {"[x2] x", "y"}


def test_level_counts(spark):
    got = grouping.with_total(grouping.count_levels(log(spark, ["[ERROR] a", "[ERROR] b", "[INFO] c", "none"]))).collect()
    assert {(r["level"], r["count"]) for r in got} == {("Error", 2), ("Info", 1), (None, 3)}


def events(spark, rows):
    return spark.createDataFrame([(i, t, "Error", f"line {i}", "f") for i, t in enumerate(rows)], "pos long, t_ms long, level string, raw string, file string")


def ring_model(times, n, window):
    bucket = max(1, -(-window // 8))
    seen, fired, latch = [], [], None
    for i, t in enumerate(times):
        e = max(0, t) // bucket
        seen.append(e)
        total = sum(e - 7 <= s <= e for s in seen)
        if total >= n and latch != e:
            latch = e
            fired.append((i, total))
    return fired


@pytest.mark.parametrize(("times", "n", "window"), [([1000] * 4, 5, 1000), ([1000] * 4, 3, 1000), ([0, 0, 0, 60_000], 3, 1000), ([0, 0, 1000, 1000], 2, 8000)])
def test_error_rate_golden(spark, times, n, window):
    got = rules.error_rate(events(spark, times), rules.Threshold(n, window)).sort("pos").collect()
    assert [(r["pos"], r["observed_count"]) for r in got] == ring_model(times, n, window)


def test_error_rate_random(spark):
    rng = random.Random(2)
    for n, window in ((3, 1000), (5, 777), (2, 5)):
        times = sorted(rng.randint(0, 20 * window) for _ in range(150))
        got = rules.error_rate(events(spark, times), rules.Threshold(n, window)).sort("pos").collect()
        assert [(r["pos"], r["observed_count"]) for r in got] == ring_model(times, n, window)


def test_first_seen(spark):
    rows = [(0, 1, "Error", "connection refused 10.0.0.1", "a"), (1, 2, "Error", "connection refused 10.0.0.99", "b"), (2, 3, "Error", "permission denied", "a"), (3, 4, "Info", "new", "a")]
    got = rules.first_seen(spark.createDataFrame(rows, "pos long, t_ms long, level string, raw string, file string"))
    assert sorted(r["pos"] for r in got.collect()) == [0, 2]


def test_silence(spark):
    rows = [(0, 0, "Info", "x", "a"), (1, 2500, "Info", "x", "a"), (2, 100, "Info", "x", "b")]
    got = rules.silence(spark.createDataFrame(rows, "pos long, t_ms long, level string, raw string, file string"), 1000, 3000)
    assert sorted((r["file"], r["ts_ms"]) for r in got.collect()) == [("a", 1000), ("a", 2000), ("b", 1100), ("b", 2000)]


def test_all_rules(spark):
    got = rules.all_rules(events(spark, [1, 2, 3]), rules.Threshold(2, 80), [("line 2", rules.Threshold(1, 80))], True, 50, 101)
    assert sorted((r["rule_order"], r["kind"]) for r in got.collect()) == [(0, "error_rate"), (1, "regex"), (2, "first_seen"), (3, "silence"), (3, "silence")]
    with pytest.raises(ValueError):
        rules.all_rules(events(spark, [1]))


def service(spark, rows):
    return spark.createDataFrame([("api", i, t, raw, "/api.log", kind) for i, (t, raw, kind) in enumerate(rows)], "service string, pos long, t_ms long, raw string, file string, event string")


def test_crash_with_trace(spark):
    rows = [(200, "panic: nil pointer dereference", "line"), (250, "goroutine 1 [running]:", "line"), (260, "\tmain.main()", "line"), (300, "fine", "line")]
    (e,) = crash.track(service(spark, rows)).collect()
    assert (e["kind"], e["marker"], e["crash_count"], e["stack_trace"], e["file"]) == ("service_crash", "go_panic", 1, "goroutine 1 [running]:\n\tmain.main()\n", "/api.log")


def test_crash_ticks_and_restart():
    t = crash.Tracker("api")
    assert t.line(100, "panic: x", "go_panic", None) == [] and t.tick(200) == []
    assert [e["kind"] for e in t.tick(400)] == ["service_crash"]
    assert t.tick(30_000) == [] and [e["kind"] for e in t.tick(30_100)] == ["service_stop"] and t.tick(90_000) == []
    t.line(91_000, "panic: y", "go_panic", 5)
    (r,) = t.restart(91_100)
    assert (r["kind"], r["restart_count"], r["crash_count"]) == ("service_restart", 1, 2) and t.tick(99_000) == []


def test_trace_limits():
    t = crash.Tracker("api")
    t.line(0, "panic: x", "go_panic", None)
    assert t.line(1, "", None, None) == []
    done = [e for i in range(40) for e in t.line(2, f"\tframe {i}", None, None)]
    assert len(done) == 1 and done[0]["stack_trace"].count("\n") == crash.TRACE_LINES
    t.line(0, "panic: x", "go_panic", None)
    for _ in range(2):
        t.line(1, "\t" + "y" * 3000, None, None)
    (e,) = t.line(1, "\tz", None, None)
    assert len(e["stack_trace"]) == crash.TRACE_BYTES


def test_crash_markers(spark):
    rows = ["[FATAL] x", "level=panic y", "panic: z", "Traceback (most recent call last):", "Exception in thread main", "Panic: no", "boom 7"]
    got = crash.marked(log(spark, rows), ("boom \\d",)).sort("line_no").collect()
    assert [r["marker"] for r in got] == ["fatal_level", "panic_level", "go_panic", "python_traceback", "java_exception", None, "custom_regex"]


def test_journal_route_and_echo(spark):
    rows = [(1, 10, "panic: x", "api.service", "api", "6", "7"), (2, 20, "app: Main process exited, code=killed", "api.service", "systemd", "5", "1"), (3, 30, "web: Failed with result 'oom-kill'", "web.service", "systemd", "5", "2"), (4, 40, "Started web", "web.service", "systemd", "6", "1"), (5, 50, "x", "db.socket", "db", "2", "3"), (6, 60, "disk gone", "db.service", "db", "2", "x")]
    entries = spark.createDataFrame(rows, "pos long, t_ms long, message string, unit string, identifier string, priority string, pid string")
    got = sorted((r["file"], r["marker"], r["pid"]) for r in journal.track_units(entries, "src", "*.service", until_ms=9999).collect())
    assert got == [("journal://api.service", "go_panic", None), ("journal://db.service", "fatal_level", None), ("journal://web.service", "systemd_signal", 2)]


@pytest.mark.parametrize(("text", "kind"), [("Started Foo", "lifecycle"), ("x: Main process exited, code=dumped", "crash_signal"), ("Failed with result 'exit-code'", "other"), ("Stopping Failed with result 'signal'", "lifecycle")])
def test_manager_class(spark, text, kind):
    assert one(spark, [text], journal.manager_class(F.col("x"))) == [kind]


def test_kernel_events(spark):
    rows = ["6,1,2,-;Killed process 7421 (myapp), UID 0\n X=y", "6,1,2,-;app[123]: segfault at 0 ip 1", "6,1,2,-;general protection fault: 0", "6,1,2,-;usb", "6,1,2,-;Killed process x (y)", "6,1,2,-;[1]: segfault at 0"]
    got = kernel.kernel_events(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, record string")).sort("i").collect()
    assert [(r["kind"], r["pid"], r["comm"]) for r in got] == [("kernel_oom", 7421, "myapp"), ("kernel_segfault", 123, "app"), ("kernel_segfault", 0, None)]


def test_previous_boot():
    assert kernel.previous_boot(["x"], 0) is None
    assert kernel.previous_boot(["dmesg-1", "console-2", "other"], 0)["detail"] == "dmesg-1,console-2"
    assert kernel.previous_boot(["dmesg-1"], 512)["detail"] == "dmesg-1; tainted=0x200"


def test_ring_records(spark):
    rec = lambda n, flags=0, pad=0: (flags | n).to_bytes(4, "little") + b"\0\0\0\0" + (77).to_bytes(4, "little") + b"\0" * (n - 4 + pad)
    data = rec(4, pad=4) + rec(4, 1 << 30, 4) + rec(12, pad=4) + rec(4, 1 << 31, 4)
    data += b"\0" * (128 - len(data))
    assert kernel.ring_records(data, 0, 128) == ([77, 77], 56)
    assert kernel.ring_events(spark.createDataFrame([(bytearray(data), 0, 128)], "data binary, start long, end long")).count() == 2


def test_metrics(spark):
    rows = spark.createDataFrame([("abc", "Error"), ("ä", None), ("", None)], "raw string, level string")
    assert {(r["level"], r["lines"], r["bytes"]) for r in metrics.line_counters(rows).collect()} == {("error", 1, 3), ("unknown", 2, 2)}
    codes = spark.createDataFrame([("/metrics", c) for c in (200, 204, 302, 401, 403, 404, 500, 503)], "route string, code int")
    assert {(r["code"], r["count"]) for r in metrics.http_counters(codes).collect()} == {(200, 3), (401, 1), (400, 1), (404, 1), (500, 2)}
    alerts = spark.createDataFrame([("first_seen",)], "kind string")
    points = metrics.grouped_points(metrics.metric_points(rows, alerts)).collect()
    assert {r["name"]: len(r["points"]) for r in points} == {"loglens_lines_total": 8, "loglens_alerts_fired_total": 10, "loglens_bytes_total": 1}

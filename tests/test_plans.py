"""Flags, agent settings, reader plans, SQL functions, registered queries and streams."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loglens.operators.rules import Threshold, error_rate
from loglens.plans import catalogue, reader, sql
from loglens.plans.config import AgentConfig, ConfigError, LogQuery, parse_duration, parse_regex_rule, parse_threshold, parse_words

SMALL = "/root/testdata/sf0.001"


def test_words():
    q = parse_words(["-tal", "error, WARN", "-sabc", "--file=a.log", "b.log", "-n", "5", "-m", "Level_Message", "--", "-x"])
    assert q == LogQuery(files=("a.log", "b.log", "-x"), search="abc", levels=("Warn", "Error"), num_lines=5, aggregate=True, aggregate_mode="level-message", tail=True)
    assert parse_words(["-h", "--nope"]).help and parse_words(["-l", "info", "-l", "error"]).levels == ("Info", "Error")


@pytest.mark.parametrize(("words", "code"), [(["-l", "loud"], "InvalidLevel"), (["-l", ","], "InvalidLevel"), (["-n", "0"], "InvalidNumLines"), (["--tail=1"], "InvalidArgument"), (["--x"], "UnknownArgument"), (["-q"], "UnknownArgument"), (["-s"], "MissingSearch"), (["--output", "xml"], "InvalidOutputMode"), (["-m", "x"], "InvalidAggregateMode"), (["-f"], "MissingFile"), (["--num-lines"], "MissingNumLine")])
def test_bad_words(words, code):
    with pytest.raises(ConfigError) as e:
        parse_words(words)
    assert e.value.code == code


def test_agent_settings():
    words = "--agent --metrics-token t --alert-error-rate 10/60s --alert-regex a:b:3/1m --alert-silence 5m --service api=/a=b --journal-unit u=x*.service --webhook-header X:\ty --sidecar https://c --sidecar-flush-interval 250ms".split(" ")
    c = AgentConfig.of(parse_words(words))
    assert c.error_rate == Threshold(10, 60_000) and c.regex_rules == (("a:b", Threshold(3, 60_000)),) and c.silence_ms == 300_000
    assert c.services == (("api", "/a=b"),) and c.journal_units == (("u", "x*.service"),) and c.webhook_headers == {"X": "y"} and c.sidecar_flush_ms == 250 and c.stderr
    for change in ({"metrics_token": ""}, {"sidecar": "http://c"}, {"sidecar_batch": "x"}, {"services": ("=x",)}, {"webhook_headers": ("X: ",)}, {"error_rate": "0/1s"}):
        with pytest.raises(ConfigError):
            AgentConfig.of(LogQuery(**({"metrics_token": "t"} | change)))


def test_small_languages():
    assert [parse_duration(x) for x in ("250ms", "30s", "5m", "1h")] == [250, 30_000, 300_000, 3_600_000]
    for bad in ("", "5", "s", "5d", "99999999999999999999h"):
        with pytest.raises(ConfigError):
            parse_duration(bad)
    for bad in ("5", "/1s", "5/", "x/1s", "5/0s"):
        with pytest.raises(ConfigError):
            parse_threshold(bad)
    with pytest.raises(ConfigError):
        parse_regex_rule(":1/1s")


def test_reader(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("[ERROR] a 1\n[INFO] b\n[ERROR] a 2\n[ERROR] c\n")
    ask = lambda *w: reader.run(reader.lines_of(spark, q := parse_words([*w, str(path)])), q).collect()
    assert [(r["line"]) for r in ask("-l", "error", "-a", "-m", "normalized")] == ["[x2] [ERROR] a 1", "[x1] [ERROR] c"]
    assert sorted(r["raw"] for r in ask("-t", "-n", "2")) == ["[ERROR] a 2", "[ERROR] c"]
    assert [json.loads(r["json"])["raw"] for r in ask("-s", "b", "--output", "json")] == ["[INFO] b"]
    assert sorted((r["page"], r["raw"]) for r in ask("-l", "error", "-n", "2"))[-1] == (2, "[ERROR] c")
    q = parse_words([str(path)])
    assert {(r["level"], r["count"]) for r in reader.summary(reader.lines_of(spark, q), q).collect()} == {("Error", 3), ("Info", 1)}
    assert reader.lines_of(spark, LogQuery(), str(tmp_path)).count() == 4


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select log_format('[x]') a, log_level_named('WARN') b, log_signature('Id 10.0.0.1') c, log_normalized('At 2024-01-02  7') d").first()
    assert tuple(row) == ("plain_bracketed", "Warn", "id #.#.#.#", "at <date> #")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["file", "key", "count", "sample", "first_pos"] and df.count() >= 1


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def values(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda x: "~" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_match_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_queries_use_no_python(spark):
    for name in ("agg_normalized", "rule_error_rate", "rule_silence", "kernel_events", "jsonl_output"):
        plan = catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_error_rate_stream_like_batch(spark, tmp_path):
    from loglens.streaming.rules import error_rate_stream

    times = [0, 10, 20, 1000, 1010, 5000, 5001, 5002, 5400, 60_000]
    rows = [(i, t, "Error", f"l {i}", "f") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "pos long, t_ms long, level string, raw string, file string")
    want = {(r["ts_ms"] // 125, r["observed_count"]) for r in error_rate(df, Threshold(3, 1000)).collect()}
    df.withColumn("ts", F.timestamp_millis("t_ms")).coalesce(1).write.parquet(str(tmp_path / "in"))
    # A late line far ahead moves the watermark past all windows.
    spark.createDataFrame([(99, 10_000_000, "Error", "x", "f")], df.schema).withColumn("ts", F.timestamp_millis("t_ms")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = error_rate_stream(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), Threshold(3, 1000), "1 seconds")
    q = stream.writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert {(r["epoch"], r["observed_count"]) for r in spark.table("rates").collect()} == want


def test_first_seen_and_crash_streams(spark, tmp_path):
    from loglens.streaming.rules import first_seen_stream
    from loglens.streaming.services import track_stream

    rows = [("api", 0, 200, "panic: x", "/f", "line", "Error"), ("api", 1, 250, "goroutine 1", "/f", "line", "Error"), ("api", 2, 300, "back 1", "/f", "line", "Error"), ("api", 3, 40_000, "", "/f", "tick", None), ("web", 4, 10, "back 2", "/g", "line", "Error"), ("web", 5, 20, None, "/g", "restart", None)]
    schema = "service string, pos long, t_ms long, raw string, file string, event string, level string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        return spark.table(name).collect()

    assert sorted(r["raw"] for r in drain(first_seen_stream(source().filter("event = 'line'")), "seen"))[0].startswith("back")
    got = drain(track_stream(source().drop("level"), timers=False), "crashes")
    assert sorted((r["service"], r["kind"], r["stack_trace"]) for r in got) == [("api", "service_crash", "goroutine 1\n"), ("api", "service_stop", None), ("web", "service_restart", None)]

"""Line analysis against golden rows and a small byte-by-byte model."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loglens.functions import keys, levels, lines

GOLDEN = [
    ('{"time":"2023-10-18T12:00:00Z","level":"info","msg":"test"}', "json", "Info", "2023-10-18", "12:00:00"),
    ('{"pid":123,"ok":true,"level":"error","msg":"failed"}', "json", "Error", None, None),
    ('{"ctx":{"level":"debug"},"level":"error"}', "json", "Error", None, None),
    ('{"level":123}', "json", None, None, None),
    ('{"level":"warning"}', "json", None, None, None),
    ("[ERROR] Something went wrong", "plain_bracketed", "Error", None, None),
    ("[14:30] message", "plain_bracketed", None, None, "14:30"),
    ("[2024-01-20 10:00] [ERROR] x", "plain_bracketed", None, "2024-01-20", "10:00"),
    ("time=2024-01-15 severity=warn msg=test", "plain_logfmt", "Warn", None, None),
    ("mylevel=warn msg=test", "plain_unknown", None, None, None),
    ("2023-10-15 14:30:00 [INFO] msg", "plain_unknown", None, "2023-10-15", "14:30:00"),
    ("9999-99-99 x", "plain_unknown", None, "9999-99-99", None),
    ("listening on 0.0.0.0:8080", "plain_unknown", None, None, None),
    ("", "plain_unknown", None, None, None),
]


def one(spark, values, column, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.select("i", column.alias("o")).sort("i").select("o").collect()]


def test_analyse_golden(spark):
    got = one(spark, [g[0] for g in GOLDEN], lines.analyse(F.col("x")))
    assert [(r["format"], r["level"], r["date"], r["time"]) for r in got] == [g[1:] for g in GOLDEN]


def test_level_positions(spark):
    rows = ["[ERROR] x", "a level=warn b", '{"a":1,"level":"info"}']
    for raw, r in zip(rows, one(spark, rows, lines.analyse(F.col("x"))), strict=True):
        assert raw[r["level_start"] : r["level_end"]].lower() == r["level"].lower()


def test_strict_json_reads_what_a_cut_line_holds(spark):
    rows = ['{"level":"error","msg":"cut', '{"ctx":{"level":"debug"},"time":"2024-01-02T03:04:05Z","level":"warn"}', '{"level":"loud","level":"info"}', '{"level":5,"time":"no"}', "level=info x"]
    strict = one(spark, rows, lines.strict_json(F.col("x")))
    assert [r["level"] for r in strict] == ["Error", "Warn", "Info", None, "Info"]
    assert strict[1]["date"] == "2024-01-02" and strict[1]["time"] == "03:04:05"
    assert rows[0][strict[0]["level_start"] : strict[0]["level_end"]] == "error"


def logfmt_model(line: str, key: str) -> str | None:
    """Fields one after the other: a key reaches up to an equals sign, a value up to a blank or its closing quote."""
    at = 0
    while at < len(line):
        while at < len(line) and line[at] in " \t":
            at += 1
        equals = line.find("=", at)
        if equals < 0:
            return None
        name, at = line[at:equals], equals + 1
        if at < len(line) and line[at] == '"':
            end = at + 1
            while end < len(line) and line[end] != '"':
                end += 2 if line[end] == "\\" else 1
            if end >= len(line):
                return None
            value, at = line[at + 1 : end], end + 1
        else:
            end = at
            while end < len(line) and line[end] not in " \t":
                end += 1
            value, at = line[at:end], end
        if name == key:
            return value
    return None


def test_logfmt_field_like_the_model(spark):
    rng = random.Random(4)
    tokens = ["msg", "=", '"', " ", "a", "\\", "x=1", "level=info", "hello", "\t", 'msg="a b"', "msg=c"]
    rows = ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    rows += ["hello msg=x", "a=1 msg=x", 'msg="q \\" r" b', "msg="]
    got = one(spark, rows, lines.logfmt_field(F.col("x"), "msg"))
    assert [(r, g) for r, g in zip(rows, got, strict=True) if g != logfmt_model(r, "msg")] == []


def test_messages(spark):
    assert one(spark, ["[E] - : hi", "[E] ", "plain", "[open"], lines.plain_message(F.col("x"))) == ["hi", None, "plain", "[open"]
    said = lines.message(F.col("x"), lines.line_format(F.col("x")))
    assert one(spark, ['{"msg":"m","message":"n"}', '{"a":1}', 'level=info msg="a b"', "level=info", "[E] x"], said) == ["n", None, "a b", None, "x"]


def test_pid(spark):
    rows = ['{"pid":1234,"x":1}', "pid=42 a[7]", "nginx[99]: x", "none", '{"pid":"x"} [5]', "pid=99999999999"]
    assert one(spark, rows, lines.pid(F.col("x"))) == [1234, 42, 99, None, None, None]


@pytest.mark.parametrize(("mode", "line", "key"), [
    ("normalized", "error code 12345 at line 99", "error code # at line #"),
    ("normalized", "error    multiple    spaces", "error multiple spaces"),
    ("normalized", "2023-10-18T12:00:00Z [ERROR] Request 123 failed", "<date>t#:#:#z [error] request # failed"),
    ("json-message", '{"level":"error","message":"Connection failed"}', "Connection failed"),
    ("level-message", "[ERROR] Connection failed", "Error\x1fConnection failed"),
    ("level-message", "plain", "unknown\x1fplain"),
    ("exact", "a  b", "a  b"),
])
def test_group_keys(spark, mode, line, key):
    assert one(spark, [line], keys.group_key(F.col("x"), lines.analyse(F.col("x")), mode)) == [key]


def test_signature_levels_ids_and_numbers(spark):
    got = one(spark, ["connection refused 10.0.0.1", "connection refused 10.0.0.99", "id deadbeef01", "id 1deadbeef", "abc"], keys.signature_text(F.col("x")))
    assert got[0] == got[1] == "connection refused #.#.#.#"
    assert got[2:] == ["id <id>", "id #<id>", "abc"]


def test_levels(spark):
    assert one(spark, ["ERROR", "warn", "err", "critical", ""], levels.parse_level(F.col("x"))) == ["Error", "Warn", None, None, None]
    assert one(spark, ["0", "2", "3", "6", "7", "8", "x", "07"], levels.priority_level(F.col("x"))) == ["Panic", "Fatal", "Error", "Info", "Debug", None, None, "Debug"]
    assert levels.levels_of(levels.level_mask(["Error", "Trace"])) == ["Trace", "Error"]
    with pytest.raises(ValueError):
        keys.parse_mode("other")
    assert keys.parse_mode("Level_Message") == "level-message"


def test_truncate_bytes(spark):
    assert one(spark, ["abcdef", "äöü", "ab"], lines.truncate_bytes(F.col("x"), 3)) == ["abc", "ä", "ab"]


def test_kmsg_message(spark):
    assert one(spark, ["6,1,2,-;hello\n K=v", "none", "6;", "6;a;b"], lines.kmsg_message(F.col("x"))) == ["hello", None, None, "a;b"]


def test_position_of_a_json_level(spark):
    rows = ['{"ctx":{"level":"debug"},"level":"error"}', '{"level":"warn"}', '{"a":[{"level":"x"},{"b":{"level":"y"}}], "level" : "info", "c":{"level":"z"}}', '{"msg":"say \\"level\\":\\"x\\" {[","level":"fatal"}', '{"ctx":{"level":"debug"}}', '{"level":5}', '{"m":"}}","level":"panic"}', '{"level":"odd one"}']
    got = spark.createDataFrame([(r,) for r in rows], "raw string").select("raw", lines.analyse(F.col("raw")).alias("i")).select("raw", "i.level", "i.level_start", "i.level_end").collect()
    said = [None if r["level_start"] is None else r["raw"][r["level_start"] : r["level_end"]] for r in got]
    assert said == ["error", "warn", "info", "fatal", None, None, "panic", "odd one"]
    assert [r["level"] for r in got] == ["Error", "Warn", "Info", "Fatal", None, None, "Panic", None]

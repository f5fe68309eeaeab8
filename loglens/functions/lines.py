"""What a log line says: format, level, date, time, message and other fields, as native column expressions.

Every function takes and returns columns; nothing here needs Python on the executors but ``strict_json``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .levels import parse_level

TIME = r"(?:^|[T \[])([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)"
DATE_AT_START = r"^\[?([0-9]{4}-[0-9]{2}-[0-9]{2})"
BRACKET = r"^\[([^\]]+)\]"
LOGFMT_LEVEL = r"(?:^|[ \t])(?:level|severity|lvl)=([^ \t]*)"
TIME_KEYS = ("time", "timestamp", "date")
LINE_INFO = "struct<format:string,level:string,level_start:int,level_end:int,date:string,time:string>"
#: Bytes of a value in JSON that are looked at.
LEVEL_BYTES, MESSAGE_BYTES = 16, 4096


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null, not empty, where nothing matches.  The text is evaluated once."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def json_string(raw: Column, key: str, most: int | None = None) -> Column:
    """A top-level string field of a JSON line; null for other types, and for more than ``most`` bytes."""
    value = F.when(raw.startswith("{") & raw.rlike(rf'"{re.escape(key)}"\s*:\s*"'), F.get_json_object(raw, f"$.{key}"))
    if most is None:
        return value
    return F.when(F.octet_length(raw) <= most, value).when(F.octet_length(value) <= most, value)


def json_level_start(raw: Column) -> Column:
    """Where the value of the top-level ``level`` of a JSON line starts, 0-based; null if there is none.

    A line is cut behind every ``"level":"``; the braces and brackets outside strings tell how deep each cut is.
    """
    parts = F.split(F.regexp_replace(raw, r'("level"\s*:\s*")', "$1\x00"), "\x00", -1)

    def deeper(text: Column) -> Column:
        bare = F.regexp_replace(text, r'(?s)"(?:[^"\\]|\\.)*+"', "")
        return F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + deeper(F.when(state["n"] == 0, part).otherwise(F.concat(F.lit('"'), part)))  # a later part begins inside a value
        n = state["n"] + F.length(part)
        return F.struct(n.alias("n"), depth.alias("depth"), F.coalesce(state["at"], F.when(depth == 1, n)).alias("at"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("at"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["at"]


def line_format(raw: Column) -> Column:
    return F.when(raw.startswith("{"), "json").when(raw.startswith("["), "plain_bracketed").when(raw.rlike(LOGFMT_LEVEL), "plain_logfmt").otherwise("plain_unknown")


def analyse(raw: Column) -> Column:
    """One struct with everything that filters, groups and outputs need: see ``LINE_INFO``.

    The first byte decides the format.  Dates stand at the start of a plain line (or behind its bracket), times anywhere
    behind a boundary; in JSON both come from ``time``, ``timestamp`` or ``date``.
    """
    stamps = [json_string(raw, k) for k in TIME_KEYS]
    json_date = F.coalesce(*[extracted(v, DATE_AT_START.replace(r"\[?", "")) for v in stamps])
    json_time = F.coalesce(*[extracted(v, TIME) for v in stamps])
    json, bracketed = raw.startswith("{"), raw.startswith("[")
    named = F.when(json, json_string(raw, "level")).when(bracketed, extracted(raw, BRACKET)).otherwise(extracted(raw, LOGFMT_LEVEL))
    before = F.when(json, json_level_start(raw)).when(bracketed, F.lit(1)).otherwise(F.length(F.regexp_extract(raw, r"(?s)^(.*?(?:^|[ \t])(?:level|severity|lvl)=)", 1)))
    return F.struct(
        line_format(raw).alias("format"),
        parse_level(named).alias("level"),
        F.when(named.isNotNull(), before).cast("int").alias("level_start"),
        F.when(named.isNotNull(), before + F.length(named)).cast("int").alias("level_end"),
        F.when(json, json_date).otherwise(extracted(raw, DATE_AT_START)).alias("date"),
        F.when(json, json_time).otherwise(extracted(raw, TIME)).alias("time"),
    )


_STRING = r'"((?:[^"\\]|\\.)*)"'
_TOKEN = re.compile(_STRING + r"|[{}\[\]:,]|[^\s{}\[\]:,\"]+", re.DOTALL)


def json_fields(line: str) -> list[tuple[str, str]]:
    """Top-level string fields of a line that starts like JSON, as they stand and in order; cut-off lines give what they hold."""
    found, depth, key, seen = [], 0, None, None
    for m in _TOKEN.finditer(line):
        token = m[0]
        if token in "{[":
            depth += 1
            key = seen = None
        elif token in "}]":
            depth -= 1
        elif depth != 1:
            continue
        elif token == ":":
            key, seen = seen, None
        elif token == ",":
            key = seen = None
        elif token[0] == '"':
            if key is not None:
                found.append((key, m[1]))
                key = None
            else:
                seen = m[1]
        else:
            key = None
    return found


def _strict(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for line in lines:
        level = date = time = start = end = None
        for key, value in json_fields(line or ""):
            if key == "level" and level is None and len(value.encode()) <= LEVEL_BYTES:
                level = value.title() if value.lower() in ("trace", "debug", "info", "warn", "error", "fatal", "panic") else None
                start = line.find(f'"{value}"', line.find('"level"') + 7) + 1
                end = start + len(value)
            elif key in TIME_KEYS:
                d, t = re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value), re.search(TIME, value)
                date, time = date or (d and d[0]), time or (t and t[1])
            if level and date:
                break
        rows.append(("json", level, start, end, date, time))
    return pd.DataFrame(rows, columns=["format", "level", "level_start", "level_end", "date", "time"]).astype({"level_start": "Int32", "level_end": "Int32"})


def strict_json(raw: Column) -> Column:
    """``analyse`` for lines that only start like JSON: keys in their own order, cut-off and repeated keys included."""
    return F.when(raw.startswith("{"), F.pandas_udf(_strict, LINE_INFO)(raw)).otherwise(analyse(raw))


def logfmt_field(raw: Column, key: str) -> Column:
    """A field of a ``key=value`` line, quoted or bare; a bare word before a key belongs to that key."""
    skipped = r'(?:[ \t]*+[^=]*+=(?:"(?:[^"\\]|\\.)*+"|(?!")[^ \t]*+))*?'
    pattern = rf'(?s)^{skipped}[ \t]*+{re.escape(key)}=(?:"((?:[^"\\]|\\.)*+)"|((?!")[^ \t]*+))'
    return F.when(raw.rlike(pattern), F.concat(F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2)))


def plain_message(raw: Column) -> Column:
    """A line without its leading bracket and the separators behind it; null if nothing is left."""
    return F.when(raw.rlike(r"(?s)^\[.*\]"), F.nullif(F.regexp_replace(raw, r"^[^\]]*\][ :\-]*", ""), F.lit(""))).otherwise(raw)


def message(raw: Column, line_format: Column) -> Column:
    """The message of a line of the given format; null if it has none."""
    json = F.coalesce(json_string(raw, "message"), json_string(raw, "msg"))
    logfmt = F.coalesce(logfmt_field(raw, "message"), logfmt_field(raw, "msg"))
    return F.when(line_format == "json", json).when(line_format == "plain_logfmt", logfmt).otherwise(plain_message(raw))


def pid(raw: Column) -> Column:
    """Process id: ``"pid":N``, else ``pid=N``, else the first ``[N]``; the first form that is there decides, even if it fails."""
    digits = lambda p: F.regexp_extract(raw, p, 1)
    text = F.when(raw.contains('"pid":'), digits(r'"pid": ?([0-9]+)')).when(raw.contains("pid="), digits(r"pid= ?([0-9]+)")).otherwise(digits(r"^[^\[]*\[([0-9]+)\]"))
    number = text.try_cast("bigint")
    return F.when(number <= 0xFFFFFFFF, number)


def kmsg_message(record: Column) -> Column:
    """The text between the first ``;`` and the next line end of a kernel record; null if there is none."""
    return extracted(record, r"(?s)^[^;]*;(?=.)([^\n]*)")


def truncate_bytes(text: Column, most: int) -> Column:
    """At most so many bytes of a text; a character cut in two is dropped."""
    cut = F.substring(text.cast("binary"), 1, most).cast("string")
    whole = F.regexp_replace(F.make_valid_utf8(cut), "\uFFFD+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def is_iso_date(text: Column) -> Column:
    return text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")

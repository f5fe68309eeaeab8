"""Lines and events as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_quoted(text: Column) -> Column:
    """A JSON string with short escapes for quotes, backslashes and line ends, and ``\\u00XX`` for other control characters."""
    out = F.regexp_replace(text, r'(["\\])', r"\\$1")
    for char, escape in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        out = F.regexp_replace(out, char, escape)
    controls = [c for c in (*range(0x20), 0x7F) if c not in (9, 10, 13)]
    plain = F.concat(F.lit('"'), out, F.lit('"'))
    escaped = out
    for c in controls:
        escaped = F.replace(escaped, F.lit(chr(c)), F.lit(f"\\u{c:04X}"))
    return F.when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(plain)


def line_json(raw: Column, info: Column) -> Column:
    """``{"level","date","time","raw"}`` of a line; what it doesn't have is empty."""
    own = lambda k: F.concat(F.lit(f'"{k}":"'), F.coalesce(info[k], F.lit("")), F.lit('",'))
    return F.concat(F.lit("{"), own("level"), own("date"), own("time"), F.lit('"raw":'), json_quoted(raw), F.lit("}"))


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Filtered lines (raw, info) as JSON lines."""
    lines.select(line_json(F.col("raw"), F.col("info")).alias("value")).write.mode(mode).text(path)


def _present(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def alert_json() -> Column:
    """A fired rule (columns of ``operators.rules.FIRED``) as one JSON object; an empty line is left out."""
    return F.to_json(F.struct("ts_ms", "kind", "rule_id", "file", "threshold", "observed_count", _present(F.col("line")).alias("line")))


def service_json() -> Column:
    optional = [_present(F.col(c)).alias(c) for c in ("detail", "stack_trace")]
    return F.to_json(F.struct("ts_ms", "kind", "service", "file", _present(F.col("marker")).alias("marker"), "pid", "crash_count", "restart_count", *optional))


def kernel_json() -> Column:
    return F.to_json(F.struct("ts_ms", "kind", "source", "pid", *[_present(F.col(c)).alias(c) for c in ("comm", "detail")]))


def append_events(events: DataFrame, path: str) -> None:
    """Rendered events (payload) added to a folder of JSON lines."""
    events.select(F.col("payload").alias("value")).write.mode("append").text(path)

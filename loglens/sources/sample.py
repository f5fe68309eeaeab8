"""A log derived from the ``events`` table: lines in JSON, bracketed, logfmt and plain form.

The same expressions serve Spark and DuckDB (but for time formats), so queries can be compared row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_PARTS = {
    "lvl": "case when event_id % 97 = 0 then 'fatal' when event_id % 101 = 0 then 'panic' when event_type = 'error' then 'error' when event_type = 'purchase' then 'warn' when event_type = 'signup' then 'info' when event_type = 'view' then 'debug' else 'trace' end",
    "msg": "concat(event_type, ' failed for user ', cast(user_id as {text}), ' after ', cast(cast(floor(value) as bigint) as {text}), ' ms')",
}
_LINE = {
    "line_no": "event_id",
    "file": "concat('app', cast(event_id % 3 as {text}), '.log')",
    "ts": "ts",
    "raw": """case cast(event_id % 4 as int) when 0 then concat('{{"time":"', t, '","ctx":{{"level":"debug"}},"level":"', lvl, '","message":"', msg, '"}}')
      when 1 then concat('[', upper(lvl), '] ', msg, ' at ', t) when 2 then concat('time=', t, ' level=', lvl, ' msg="', msg, '"') else concat(t, ' ', lvl, ' ', msg) end""",
}
#: A line of a service for each event; a fatal one is a marker line, up to 40 stack frames and an ordinary line.
_CRASH = {
    "event_id": "event_id",
    "line_no": "event_id * 64 + k",
    "service": "concat('svc', cast(event_id % 3 as {text}))",
    "raw": """case when event_id % 97 <> 0 then concat('served user ', cast(user_id as {text})) when k = 0 then concat('panic: worker[', cast(user_id as {text}), '] failed')
      when k <= event_id % 41 then concat(chr(9), 'frame ', cast(k as {text})) else 'back to work' end""",
}
_LAST = "case when event_id % 97 = 0 then event_id % 41 + 1 else 0 end"


def expressions(columns: dict[str, str], text: str) -> list[str]:
    """Columns as SQL, with the engine's name for text."""
    return [f"{e.format(text=text)} as {k}" for k, e in columns.items()]


def select_sql(columns: dict[str, str], source: str) -> str:
    return f"select {', '.join(expressions(columns, 'varchar'))} from {source}"


SQL_LINES = select_sql(_LINE, "(" + select_sql({"event_id": "event_id", "ts": "ts", "t": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"} | _PARTS, "events") + ")")
SQL_CRASHES = select_sql(_CRASH | {"t_ms": "epoch_us(ts) // 1000 + k"}, "(select event_id, user_id, ts, unnest(range(0, " + _LAST + " + 1)) as k from events)")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, file, ts, raw), one line per event."""
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as t"
    return events_table(spark, sf_dir).selectExpr("event_id", "ts", stamp, *expressions(_PARTS, "string")).selectExpr(*expressions(_LINE, "string"))


def crash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, line_no, service, t_ms, raw): the log of three services, with a crash and its stack trace for each fatal event."""
    own = events_table(spark, sf_dir).selectExpr("event_id", "user_id", "ts", f"explode(sequence(0, cast({_LAST} as int))) as k")
    return own.selectExpr(*expressions(_CRASH, "string"), "unix_millis(cast(ts as timestamp)) + k as t_ms")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files of the sample, below ``spark.checkpoint.dir``, which every executor of a cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/sample-{name}-{uuid.uuid4().hex}"

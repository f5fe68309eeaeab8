"""Exported journals (one JSON object a line), and the choice between them and binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import journal_file

#: Longer lines are left out.
MOST_LINE_BYTES = 16 << 10
FIELDS = {"message": "MESSAGE", "unit": "_SYSTEMD_UNIT", "identifier": "SYSLOG_IDENTIFIER", "priority": "PRIORITY", "pid": "_PID", "realtime": "__REALTIME_TIMESTAMP"}
_SCHEMA = ", ".join(f"`{k}` string" for k in FIELDS.values())


def parse(raw: Column) -> Column:
    """The fields of one exported entry, unescaped; null for what is no JSON."""
    return F.from_json(raw, _SCHEMA)


def entries(lines: DataFrame) -> DataFrame:
    """Lines (raw) with the fields of the entry; other columns are kept."""
    own = lines.filter(F.octet_length("raw") <= MOST_LINE_BYTES).withColumn("_e", parse(F.col("raw")))
    return own.select(*lines.columns, *[F.col(f"_e.`{v}`").alias(k) for k, v in FIELDS.items()])


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, pos, t_ms, message, unit, identifier, priority, pid) of exported files."""
    from .text import scan_numbered

    rows = entries(scan_numbered(spark, *paths))
    return rows.select("file", F.col("line_no").alias("pos"), F.floor(F.col("realtime").try_cast("bigint") / 1000).alias("t_ms"), "message", "unit", "identifier", "priority", "pid")


def read_any(spark: SparkSession, *paths: str, format: str = "native") -> DataFrame:
    """Entries from binary files (``native``) or exported ones (``json``)."""
    if format == "native":
        return journal_file.as_entries(journal_file.read(spark, *paths))
    if format == "json":
        return read(spark, *paths)
    raise ValueError(f"unknown journal format {format!r}")


def freshest(spark: SparkSession, *folders: str) -> str | None:
    """The journal file with the latest entry among the folders, by its header."""
    import struct

    best: tuple[int, str] | None = None
    for folder in folders:
        for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.journal").load(folder).select("path", F.substring("content", 1, journal_file.HEADER_BYTES).alias("head")).toLocalIterator():
            head = bytes(r["head"])
            if len(head) == journal_file.HEADER_BYTES and head[:8] == journal_file.MAGIC:
                latest = struct.unpack_from("<Q", head, 192)[0]
                best = max(best or (latest, r["path"]), (latest, r["path"]))
    return best and best[1]

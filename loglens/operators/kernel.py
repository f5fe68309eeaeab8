"""Kernel events from message records, crash dumps and ring buffers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import kmsg_message, truncate_bytes

#: Limits of the event's texts, and the forms of the messages.
COMM_BYTES, DETAIL_BYTES = 16, 128
OOM = r"(?s)^Killed process \+?([0-9]+) \(([^)]*)\)"
SEGFAULT = r"(?s)^([^\[]+)\[\+?([0-9]+)\]: segfault at "
PROTECTION = "general protection fault"
DUMPS = ("dmesg-", "console-", "pmsg-", "ftrace-")
MOST_DUMPS, DIED = 4, 1 << 9
BUSY, DISCARD, LENGTH = 1 << 31, 1 << 30, (1 << 30) - 1


def _u32(text: Column) -> Column:
    number = text.try_cast("bigint")
    return F.when(number <= 0xFFFFFFFF, number)


def kernel_events(records: DataFrame, source: str = "kmsg") -> DataFrame:
    """(kind, source, pid, comm, detail) of the records that tell of a crash; other columns of ``records`` are kept."""
    said = kmsg_message(F.col("record"))
    own = records.withColumn("_m", said)
    m = F.col("_m")
    oom_pid = F.when(m.rlike(OOM), _u32(F.regexp_extract(m, OOM, 1)))
    seg_pid = F.when(m.rlike(SEGFAULT), _u32(F.regexp_extract(m, SEGFAULT, 2)))
    kind = F.when(oom_pid.isNotNull(), "kernel_oom").when(seg_pid.isNotNull() | m.startswith(PROTECTION), "kernel_segfault")
    comm = F.when(oom_pid.isNotNull(), F.regexp_extract(m, OOM, 2)).when(seg_pid.isNotNull(), F.regexp_extract(m, SEGFAULT, 1))
    out = own.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return out.select(
        *records.columns,
        "kind",
        F.lit(source).alias("source"),
        F.coalesce(oom_pid, seg_pid, F.lit(0)).alias("pid"),
        F.nullif(truncate_bytes(comm, COMM_BYTES), F.lit("")).alias("comm"),
        F.nullif(truncate_bytes(m, DETAIL_BYTES), F.lit("")).alias("detail"),
    )


def previous_boot(names: list[str], tainted: int) -> dict | None:
    """The event that tells of a crash before this boot, from the names of kept dumps and the kernel's taint flags."""
    dumps = [n for n in names if n.startswith(DUMPS)]
    died = bool(tainted & DIED)
    if not dumps and not died:
        return None
    parts = [",".join(dumps[:MOST_DUMPS])] * bool(dumps) + [f"tainted={tainted:#x}"] * died
    return {"kind": "kernel_panic", "source": "pstore", "pid": 0, "comm": None, "detail": "; ".join(parts)[:DETAIL_BYTES]}


def previous_boot_event(spark: SparkSession, folder: str, tainted: int = 0) -> DataFrame:
    """At most one row, from the dumps in a folder that Spark can list."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(f"{d}*" for d in DUMPS) + "}").load(folder)
    names = [r[0].rsplit("/", 1)[-1] for r in files.select("path").sort("path").limit(1000).collect()]
    event = previous_boot(names, tainted)
    schema = "kind string, source string, pid long, comm string, detail string"
    return spark.createDataFrame([tuple(event.values())] if event else [], schema)


def ring_records(data: bytes, start: int, end: int) -> tuple[list[int], int]:
    """Process ids of the records of a ring buffer from one position to another, and the position reached.

    A record is a 32-bit length with a busy and a discard bit, four bytes of no use, and a payload padded to eight; a busy
    record ends the walk, a discarded one is passed over.
    """
    found, at = [], start
    while at < end:
        place = at % len(data)
        if place + 8 > len(data):
            break
        (head,) = struct.unpack_from("<I", data, place)
        size = head & LENGTH
        if head & BUSY or place + 8 + size > len(data):
            break
        if not head & DISCARD and size >= 4:
            found.append(struct.unpack_from("<I", data, place + 8)[0])
        at += 8 + -(-size // 8) * 8
    return found, at


def ring_events(buffers: DataFrame) -> DataFrame:
    """Out-of-memory events of captured ring buffers (data, start, end)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pids = [p for d, s, e in zip(*(b.column(c).to_pylist() for c in ("data", "start", "end")), strict=True) for p in ring_records(d, s, e)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(["kernel_oom"] * len(pids), pa.string()), pa.array(["ebpf"] * len(pids), pa.string()), pa.array(pids, pa.int64())], ["kind", "source", "pid"])

    return buffers.select("data", "start", "end").mapInArrow(run, "kind string, source string, pid long")

"""Following logs: filtered lines, and groups of each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import LogFilter
from ..operators.grouping import group_lines
from ..sources import follow


def follow_lines(spark: SparkSession, path: str, wanted: LogFilter | None = None, start: str = "end") -> DataFrame:
    """Appended lines that pass the filter (dates and times are not looked at)."""
    follow.register(spark)
    lines = spark.readStream.format("follow").option("path", path).option("from", start).load().filter(F.col("event") == "line")
    return (wanted or LogFilter()).apply(lines, following=True)


def follow_groups(lines: DataFrame, mode: str, sink: Callable[[DataFrame, int], object], **options: str) -> StreamingQuery:
    """Groups of each batch by itself, given to ``sink``."""
    return lines.writeStream.foreachBatch(lambda batch, n: sink(group_lines(batch, mode), n) and None).options(**options).start()

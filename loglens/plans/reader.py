"""From a query to a result: scan, filter, then lines, pages, groups or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.search import highlight_ranges
from ..operators.grouping import count_levels, first_seen_order, group_lines, group_lines_prefixed
from ..sinks.jsonl import line_json
from ..sources.text import GLOB, last_lines, paginate, scan_numbered
from .config import LogQuery


def lines_of(spark: SparkSession, query: LogQuery, folder: str = ".") -> DataFrame:
    """The lines of the files asked for, or of all logs of the folder."""
    return scan_numbered(spark, *query.files) if query.files else scan_numbered(spark, folder, glob=GLOB)


def run(lines: DataFrame, query: LogQuery) -> DataFrame:
    """The result of a query over lines (file, line_no, raw).

    Groups for ``aggregate``; the last ``num_lines`` (10) lines for ``tail``; else matching lines, with their page if
    ``num_lines`` is set, the places to highlight if there is a search, and as JSON if that is the output.
    """
    if query.tail:
        lines = last_lines(lines, query.num_lines or 10)
    found = query.filter().apply(lines, following=query.tail)
    if query.aggregate:
        return first_seen_order(group_lines_prefixed(group_lines(found, query.aggregate_mode)))
    if query.output == "json":
        return found.select("file", "line_no", line_json(F.col("raw"), F.col("info")).alias("json"))
    if query.search is not None:
        found = found.withColumn("ranges", highlight_ranges(F.col("raw"), query.search))
    return paginate(found, query.num_lines) if query.num_lines and not query.tail else found


def summary(lines: DataFrame, query: LogQuery) -> DataFrame:
    """Counts by file and level of what a query finds."""
    return count_levels(query.filter().apply(lines))

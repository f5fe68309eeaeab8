"""Text scans: whole files, plain or gzip, as lines with their file and number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GLOB = "*.{log,log.gz}"
#: Bytes of a line that the agent's rules look at.
AGENT_LINE_BYTES = 8192


def scan(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(file, raw) of every non-empty line; lines end at a line feed only, and gzip is read by its suffix."""
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).filter(F.length("raw") > 0)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all log files of a folder."""
    return scan(spark, folder, glob=GLOB)


def scan_numbered(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(file, line_no, raw): numbers count the non-empty lines of a file from 0, across its splits.

    The splits of a file are put in order by where they start in it, and a line by its place in its split.  One row per
    split is shuffled, never the lines.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("raw")).filter(F.length("raw") > 0)
    placed = rows.withColumn("at", F.monotonically_increasing_id())  # without gaps within a split, which one task reads in order
    splits = placed.groupBy("file", "split").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(splits.select("file", "split", (before - F.col("first")).alias("shift")), ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "raw")


def last_lines(lines: DataFrame, n: int = 10, by: str = "file", order: str = "line_no") -> DataFrame:
    """The last n lines of each file, in order of their number within it."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return lines.withColumn("_back", back).filter(F.col("_back") <= n).drop("_back")


def ranked(lines: DataFrame, by: str, order: str, into: str, width: int = 1 << 16) -> DataFrame:
    """Lines with their rank (from 1) among the lines of equal ``by``.

    Ranks are taken within stretches of ``width`` of the order column, and the counts of the stretches added up, so a
    large file is ranked by many tasks.
    """
    own = lines.withColumn("_stretch", F.floor(F.col(order) / width))
    counts = own.groupBy(by, "_stretch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(by, "_stretch").orderBy(order))
    return own.join(counts.select(by, "_stretch", before.alias("_before")), [by, "_stretch"]).withColumn(into, F.col("_before") + within).select(*lines.columns, into)


def paginate(lines: DataFrame, size: int, by: str = "file", order: str = "line_no") -> DataFrame:
    """Lines with the number of their page within the file, from 1."""
    return ranked(lines, by, order, "page").withColumn("page", F.ceil(F.col("page") / size).cast("long"))


def bounded(raw: Column, most: int = AGENT_LINE_BYTES) -> Column:
    """The part of a line that rules look at."""
    from ..functions.lines import truncate_bytes

    return truncate_bytes(raw, most)

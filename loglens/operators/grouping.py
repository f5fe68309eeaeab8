"""Grouping of lines by key, and counts by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import group_key
from ..functions.lines import analyse


def group_lines(lines: DataFrame, mode: str = "exact", by: tuple[str, ...] = ("file",), order: str = "line_no", most_keys: int | None = None) -> DataFrame:
    """(by..., key, count, sample, first_pos): sample is the group's first line.

    ``most_keys`` keeps the groups seen first in each file.  Counts and samples are combined before the shuffle.
    """
    info = F.col("info") if "info" in lines.columns else analyse(F.col("raw"))
    keyed = lines.select(*by, "raw", order, group_key(F.col("raw"), info, mode).alias("key"))
    out = keyed.groupBy(*by, "key").agg(F.count("*").alias("count"), F.min_by("raw", order).alias("sample"), F.min(order).alias("first_pos"))
    if most_keys is not None:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("first_pos"))
        out = out.withColumn("_rank", rank).filter(F.col("_rank") <= most_keys).drop("_rank")
    return out


def first_seen_order(groups: DataFrame, by: str = "file") -> DataFrame:
    return groups.orderBy(by, "first_pos")


def group_lines_prefixed(groups: DataFrame, always: bool = True) -> DataFrame:
    """Groups with ``line``: the sample behind ``[xN] `` (only for N > 1 unless ``always``)."""
    prefix = F.concat(F.lit("[x"), F.col("count").cast("string"), F.lit("] "))
    return groups.withColumn("line", F.concat(prefix if always else F.when(F.col("count") > 1, prefix).otherwise(F.lit("")), F.col("sample")))


def count_levels(lines: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """(by..., level, count) of the lines that have a level."""
    info = lines if "info" in lines.columns else lines.withColumn("info", analyse(F.col("raw")))
    return info.select(*by, F.col("info.level").alias("level")).filter(F.col("level").isNotNull()).groupBy(*by, "level").agg(F.count("*").alias("count"))


def with_total(counts: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Level counts of each file with a further row, level null, that has their sum."""
    return counts.unionByName(counts.groupBy(*by).agg(F.sum("count").alias("count")).withColumn("level", F.lit(None).cast("string")))

"""Counters over lines and alerts, and points for exporters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LEVELS

#: Labels in their order.
LEVEL_LABELS = (*(x.lower() for x in LEVELS), "unknown")
RULE_LABELS = ("error_rate", "regex", "first_seen", "silence", "kernel_oom", "kernel_segfault", "kernel_panic", "service_crash", "service_stop", "service_restart")
ROUTES, STATUSES = ("/metrics", "/metrics.json", "/healthz", "other"), (200, 400, 401, 404, 500)


def line_counters(lines: DataFrame) -> DataFrame:
    """(level, lines, bytes) of lines (raw, level); lines without a level, empty ones too, are ``unknown``."""
    level = F.coalesce(F.lower("level"), F.lit("unknown"))
    return lines.groupBy(level.alias("level")).agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).cast("long").alias("bytes"))


def alert_counters(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("kind").alias("rule")).agg(F.count("*").alias("count"))


def folded_status(code: Column) -> Column:
    """The status itself if it is counted, else the one that its kind is counted under."""
    return F.when(code.isin(*STATUSES), code).when(code < 400, 200).when(code < 500, 400).otherwise(500).cast("int")


def http_counters(requests: DataFrame) -> DataFrame:
    """(route, code, count) of requests (route, code)."""
    return requests.groupBy("route", folded_status(F.col("code")).alias("code")).agg(F.count("*").alias("count"))


def metric_points(lines: DataFrame, alerts: DataFrame, prefix: str = "loglens") -> DataFrame:
    """(name, label, label_value, value): a point for every label, those without any lines or alerts included."""
    spark = lines.sparkSession
    all_levels = spark.createDataFrame([(i, x) for i, x in enumerate(LEVEL_LABELS)], "place int, level string")
    all_rules = spark.createDataFrame([(i, x) for i, x in enumerate(RULE_LABELS)], "place int, rule string")
    counted = line_counters(lines)
    point = lambda df, name, label, value: df.select(F.lit(f"{prefix}_{name}").alias("name"), F.lit(label).alias("label"), F.col(label).alias("label_value"), F.coalesce(value, F.lit(0)).cast("long").alias("value"), "place")
    levels = point(all_levels.join(counted, "level", "left"), "lines_total", "level", F.col("lines"))
    rules = point(all_rules.join(alert_counters(alerts), "rule", "left"), "alerts_fired_total", "rule", F.col("count"))
    size = counted.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("value")).select(F.lit(f"{prefix}_bytes_total").alias("name"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("label_value"), "value", F.lit(0).alias("place"))
    return levels.unionByName(rules).unionByName(size)


def grouped_points(points: DataFrame) -> DataFrame:
    """(name, points): the points of each metric together, in label order."""
    return points.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "label", "label_value", "value"))).alias("points"))

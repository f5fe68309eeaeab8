"""The alert rules as streams: the same buckets and latches as the batch rules, in append mode behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import SIGNATURE_BYTES, signature_text
from ..functions.levels import is_error
from ..functions.lines import truncate_bytes
from ..operators.rules import BUCKETS, Threshold


def rate_stream(lines: DataFrame, threshold: Threshold, delay: str = "10 seconds", rule_id: str = "error_rate") -> DataFrame:
    """(rule_id, epoch, observed_count) of every bucket that fires, from a stream of counted lines (ts).

    A window of eight buckets slides by one; it fires if it holds the count and something in its last bucket, and what was
    observed is the count at the line that reached it.
    """
    bucket = threshold.bucket_ms
    size, slide = f"{bucket * BUCKETS} milliseconds", f"{bucket} milliseconds"
    rows = lines.withWatermark("ts", delay).select("ts", F.window("ts", size, slide).alias("w"))
    in_last = (F.unix_millis("ts") >= F.unix_millis(F.col("w.end")) - bucket).cast("int")
    windowed = rows.withColumn("in_last", in_last).groupBy("w").agg(F.count("*").alias("n"), F.sum("in_last").alias("last"))
    fires = windowed.filter((F.col("n") >= threshold.count) & (F.col("last") > 0))
    return fires.select(F.lit(rule_id).alias("rule_id"), (F.unix_millis("w.end") / bucket - 1).cast("long").alias("epoch"), F.greatest(F.lit(threshold.count), F.col("n") - F.col("last") + 1).cast("long").alias("observed_count"))


def error_rate_stream(lines: DataFrame, threshold: Threshold, delay: str = "10 seconds") -> DataFrame:
    return rate_stream(lines.filter(is_error(F.col("level"))), threshold, delay)


def first_seen_stream(lines: DataFrame) -> DataFrame:
    """The first error line of each signature; what has been seen is kept in the state store."""
    return lines.filter(is_error(F.col("level"))).withColumn("sig", F.xxhash64(signature_text(truncate_bytes(F.col("raw"), SIGNATURE_BYTES)))).dropDuplicates(["sig"])

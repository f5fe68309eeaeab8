"""Captured kernel message records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, record): a record is a line and the lines behind it that start with a blank.

    A capture is read whole, as it holds no more than a kernel's ring buffer.
    """
    whole = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.explode(F.split("value", "\n(?! )")).alias("record")).filter(F.length("record") > 0)

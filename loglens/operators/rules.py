"""Alert rules over a stream's own clock: rates in sliding windows, first occurrences, silence.

Lines are (pos, t_ms, level, raw, file); ``pos`` is a total order.  A rate rule N/W keeps counts in buckets of ceil(W/8) ms
and looks at the last eight of them.  It fires at the first line of a bucket at which they hold N, once for each bucket.

Only one row for each rule and bucket goes through an ordered window; lines come back for the buckets that fired, where the
line that reached the count is found by its rank.  So no window runs over all lines.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import signature_text
from ..functions.levels import is_error
from ..functions.lines import truncate_bytes
from ..functions.search import pattern_match

BUCKETS = 8
#: Windows in a stretch of time in which the next line of a file is looked for.
STRETCH = 1024
FIRED = ["pos", "ts_ms", "kind", "rule_id", "file", "threshold", "observed_count", "line"]


@dataclass(frozen=True)
class Threshold:
    count: int
    window_ms: int

    @property
    def bucket_ms(self) -> int:
        return max(1, math.ceil(self.window_ms / BUCKETS))


def epoch(t_ms: Column, bucket_ms: int) -> Column:
    return F.when(t_ms <= 0, F.lit(0)).otherwise(F.floor(t_ms / bucket_ms)).cast("long")


def _fired(rows: DataFrame, kind: str, rule_id: Column, count: Column, window_ms: Column, observed: Column) -> DataFrame:
    return rows.select(
        "pos",
        F.col("t_ms").alias("ts_ms"),
        F.lit(kind).alias("kind"),
        rule_id.alias("rule_id"),
        "file",
        F.struct(count.cast("int").alias("count"), window_ms.cast("long").alias("window_ms")).alias("threshold"),
        observed.cast("long").alias("observed_count"),
        F.col("raw").alias("line"),
    )


def rates(lines: DataFrame, rules: list[tuple[str, Column, Threshold]], kind: str) -> DataFrame:
    """Alerts of rate rules (id, what they count, threshold) over the lines of all files together, in one pass over them."""
    table = F.array(*[F.when(F.coalesce(counts, F.lit(False)), F.struct(F.lit(i).alias("r"), F.lit(name).alias("rule_id"), F.lit(t.count).alias("need"), F.lit(t.window_ms).cast("long").alias("window_ms"), epoch(F.col("t_ms"), t.bucket_ms).alias("e"))) for i, (name, counts, t) in enumerate(rules)])
    own = lines.select("pos", "t_ms", "file", "raw", F.explode(F.array_compact(table)).alias("rule")).select("pos", "t_ms", "file", "raw", "rule.*")
    counts = own.groupBy("r", "e", "need").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy("e").rangeBetween(1 - BUCKETS, -1)), F.lit(0))
    due = counts.withColumn("before", before).withColumn("rank", F.greatest(F.lit(1), F.col("need") - F.col("before"))).filter("n >= rank")
    placed = own.join(due.select("r", "e", "before", "rank"), ["r", "e"]).withColumn("_r", F.row_number().over(Window.partitionBy("r", "e").orderBy("pos")))
    return _fired(placed.filter("_r = rank"), kind, F.col("rule_id"), F.col("need"), F.col("window_ms"), F.col("before") + F.col("rank"))


def error_rate(lines: DataFrame, threshold: Threshold) -> DataFrame:
    return rates(lines.filter(is_error(F.col("level"))), [("error_rate", F.lit(True), threshold)], "error_rate")


def regex_rate(lines: DataFrame, rules: list[tuple[str, Threshold]], legacy: bool = False) -> DataFrame:
    """Alerts of all pattern rules, each with its own window and whatever the level."""
    return rates(lines, [(p, pattern_match(F.col("raw"), p, legacy), t) for p, t in rules], "regex")


def first_seen(lines: DataFrame) -> DataFrame:
    """The first error line of each signature, whatever the file."""
    own = lines.filter(is_error(F.col("level"))).withColumn("sig", signature_text(truncate_bytes(F.col("raw"), 8192)))
    first = own.groupBy("sig").agg(F.min_by(F.struct("pos", "t_ms", "file", "raw"), "pos").alias("x")).select("x.*")
    return _fired(first, "first_seen", F.lit("first_seen"), F.lit(1), F.lit(0), F.lit(1))


def silence(lines: DataFrame, window_ms: int, until_ms: int) -> DataFrame:
    """Alerts for files without a line for ``window_ms``: when that time is over, then at each multiple of it, up to ``until_ms``.

    The next line of a file is looked for within a stretch of time, and beyond it in a table of one row for each stretch.
    """
    own = lines.groupBy("file", "t_ms").agg(F.max("pos").alias("pos")).withColumn("s", F.floor(F.col("t_ms") / (window_ms * STRETCH)))
    stretches = own.groupBy("file", "s").agg(F.min("t_ms").alias("begin"))
    beyond = stretches.select("file", "s", F.lead("begin").over(Window.partitionBy("file").orderBy("s")).alias("beyond"))
    following = F.lead("t_ms").over(Window.partitionBy("file", "s").orderBy("t_ms"))
    gaps = own.join(beyond, ["file", "s"]).withColumn("next", F.coalesce(following, "beyond", F.lit(until_ms)))
    due = F.col("t_ms") + window_ms
    again = (F.floor(due / window_ms) + 1) * window_ms
    times = F.concat(F.array(due), F.when(again < F.col("next"), F.sequence(again, F.col("next") - 1, F.lit(window_ms).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)")))
    fired = gaps.filter(due < F.col("next")).withColumn("at", F.explode(times)).select("pos", "file", F.col("at").alias("t_ms"), F.lit("").alias("raw"))
    return _fired(fired, "silence", F.lit("silence"), F.lit(0), F.lit(window_ms), F.lit(0))


def all_rules(lines: DataFrame, errors: Threshold | None = None, patterns: list[tuple[str, Threshold]] | None = None, seen: bool = False, silent_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Alerts of all given rules; ``rule_order`` tells which comes first at one line."""
    parts = []
    if errors:
        parts.append(error_rate(lines, errors).withColumn("rule_order", F.lit(0)))
    if patterns:
        place = F.array_position(F.array(*[F.lit(p) for p, _ in patterns]), F.col("rule_id"))
        parts.append(regex_rate(lines, patterns).withColumn("rule_order", place.cast("int")))
    if seen:
        parts.append(first_seen(lines).withColumn("rule_order", F.lit(1 + len(patterns or []))))
    if silent_ms:
        parts.append(silence(lines, silent_ms, until_ms or 0).withColumn("rule_order", F.lit(2 + len(patterns or []))))
    if not parts:
        raise ValueError("no rule is given")
    return reduce(DataFrame.unionByName, parts)

"""Line filters: search, level, date range and time of day, as one conjunction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import analyse, strict_json
from ..functions.search import search


def parse_date_range(text: str) -> tuple[str | None, str | None]:
    """``DAY``, ``FROM..TO``, ``FROM..`` or ``..TO``."""
    low, dots, high = text.partition("..")
    return (low or None, high or None) if dots else (text, text)


def in_date_range(date: Column, low: str | None, high: str | None) -> Column:
    """Inclusive, compared as text; no date is in no range, and a bound that is no full date lets nothing through."""
    if any(b is not None and len(b) < 10 for b in (low, high)):
        return F.lit(False)
    ok = date.isNotNull()
    if low is not None:
        ok = ok & (date >= low[:10])
    if high is not None:
        ok = ok & (date <= high[:10])
    return ok


def in_time_range(time: Column, low: str | None, high: str | None) -> Column:
    """Inclusive, compared as text, so 14:00 is before 14:00:00; lines without a time pass."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (time >= low)
    if high is not None:
        ok = ok & (time <= high)
    return time.isNull() | ok


@dataclass(frozen=True)
class LogFilter:
    """What lines must have; None or empty asks for nothing."""

    search: str | None = None
    levels: tuple[str, ...] = ()
    date: str | None = None
    from_time: str | None = None
    to_time: str | None = None
    strict_json: bool = False
    legacy_regex: bool = False

    def apply(self, lines: DataFrame, following: bool = False) -> DataFrame:
        """Matching lines with their ``info`` struct.  When following a file, dates and times are not filtered."""
        out = lines.filter(F.length("raw") > 0)
        if self.search is not None:
            out = out.filter(search(F.col("raw"), self.search, self.legacy_regex))
        out = out.withColumn("info", (strict_json if self.strict_json else analyse)(F.col("raw")))
        if self.levels:
            out = out.filter(F.col("info.level").isin(*self.levels))
        if self.date is not None and not following:
            out = out.filter(in_date_range(F.col("info.date"), *parse_date_range(self.date)))
        if (self.from_time or self.to_time) and not following:
            out = out.filter(in_time_range(F.col("info.time"), self.from_time, self.to_time))
        return out

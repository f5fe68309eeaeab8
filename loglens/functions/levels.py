"""Log levels as ordered names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, least severe first; a level's place is its ordinal and its bit in a mask.
LEVELS = ("Trace", "Debug", "Info", "Warn", "Error", "Fatal", "Panic")
ERROR_LEVELS = ("Error", "Fatal", "Panic")
#: Syslog priorities.
PRIORITY = {"0": "Panic", "1": "Panic", "2": "Fatal", "3": "Error", "4": "Warn", "5": "Info", "6": "Info", "7": "Debug"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only, so that lengths and other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def parse_level(text: Column) -> Column:
    """The level that a text names, whatever its case; null for anything else."""
    names = F.create_map(*[F.lit(x) for name in LEVELS for x in (name.lower(), name)])
    return F.try_element_at(names, ascii_lower(text))


def level_ordinal(level: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1).cast("tinyint")


def is_error(level: Column) -> Column:
    """False, not null, where there is no level."""
    return F.coalesce(level.isin(*ERROR_LEVELS), F.lit(False))


def level_mask(levels: Iterable[str]) -> int:
    return sum({1 << LEVELS.index(x) for x in levels})


def levels_of(mask: int) -> list[str]:
    return [x for i, x in enumerate(LEVELS) if mask >> i & 1]


def priority_level(priority: Column) -> Column:
    """The level of a syslog priority given as text; leading zeros and a plus sign are allowed, as in any decimal number."""
    names = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.try_element_at(names, F.regexp_extract(priority, r"^\+?0*([0-7])$", 1))

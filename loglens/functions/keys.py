"""Group keys and error signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .levels import ascii_lower
from .lines import MESSAGE_BYTES, json_string, message

MODES = ("exact", "level-message", "json-message", "normalized")
BLANKS = " \t\n\r\x0b\x0c"
#: Bytes of a line that its signature looks at.
SIGNATURE_BYTES = 8192


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")


def normalised(raw: Column) -> Column:
    """A line with dates, numbers, case and white space levelled, so that lines that differ only there are equal."""
    dated = F.regexp_replace(raw, r"(?:\G|(?<![0-9]))[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>")
    return F.trim(F.regexp_replace(ascii_lower(F.regexp_replace(dated, "[0-9]+", "#")), r"[ \t\n\r\x0B\f]+", " "))


def signature_text(raw: Column) -> Column:
    """A line with ids and numbers replaced: hexadecimal runs of eight or more that start with a letter, and digit runs."""
    return ascii_lower(F.regexp_replace(F.regexp_replace(raw, "[a-fA-F][0-9a-fA-F]{7,}", "<id>"), "[0-9]+", "#"))


def signature(raw: Column) -> Column:
    return F.xxhash64(signature_text(raw))


def group_key(raw: Column, info: Column, mode: str) -> Column:
    """The key that a line is grouped under; ``info`` is its ``analyse`` struct."""
    if mode == "exact":
        return raw
    if mode == "level-message":
        said = F.coalesce(message(raw, info["format"]), raw)
        return F.concat(F.coalesce(info["level"], F.lit("unknown")), F.lit("\x1f"), trimmed(said))
    if mode == "json-message":
        return trimmed(F.coalesce(json_string(raw, "message", MESSAGE_BYTES), json_string(raw, "msg", MESSAGE_BYTES), raw))
    if mode == "normalized":
        return normalised(raw)
    raise ValueError(f"unknown group mode {mode!r}")


def parse_mode(name: str) -> str:
    """A group mode from its name in any case, with ``-`` or ``_``."""
    mode = name.lower().replace("_", "-")
    if mode not in MODES:
        raise ValueError(f"unknown group mode {name!r}")
    return mode

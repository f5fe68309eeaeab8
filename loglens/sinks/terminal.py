"""Coloured lines for a terminal, formatted on the driver as they arrive."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from ..functions.levels import LEVELS

RESET, MARK = "\x1b[0m", "\x1b[7m"
#: 256-colour codes by level, least severe first.
COLOURS = dict(zip(LEVELS, (245, 75, 77, 178, 203, 199, 201), strict=True))


def _marked(text: str, ranges: Iterable[tuple[int, int]], colour: str) -> str:
    out, at = [], 0
    for start, end in ranges:
        out += [text[at:start], MARK, text[start:end], RESET, colour]
        at = end
    return "".join([*out, text[at:]])


def styled(raw: str, level: str | None, ranges: Iterable[tuple[int, int]] = (), width: int = 5) -> str:
    """A line behind its padded level in capitals, both in the level's colour, with the ranges marked."""
    colour = f"\x1b[38;5;{COLOURS[level]}m" if level else ""
    label = f"{colour}{level.upper():<{width}}{RESET} " if level else ""
    return f"{label}{colour}{_marked(raw, ranges, colour)}{RESET if colour else ''}"


def show(lines: DataFrame, page: int | None = None) -> Iterator[list[str]]:
    """Pages of styled lines (raw, info, and optionally ranges), fetched partition by partition."""
    held: list[str] = []
    for r in lines.toLocalIterator(prefetchPartitions=True):
        ranges = [(x["start"], x["end"]) for x in r["ranges"]] if "ranges" in lines.columns else ()
        held.append(styled(r["raw"], r["info"]["level"], ranges))
        if page and len(held) == page:
            yield held
            held = []
    if held:
        yield held


def summary(counts: dict[str, int]) -> str:
    """The footer of a run: levels that occurred, and their sum; empty if there are none."""
    own = [(x, counts[x]) for x in LEVELS if counts.get(x)]
    return "" if not own else ", ".join(f"{x}: {n}" for x, n in own) + f" | total: {sum(n for _, n in own)}"

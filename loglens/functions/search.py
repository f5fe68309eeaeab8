"""Search predicates and highlight ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .levels import LOWER, UPPER, ascii_lower
from .regexes import compile_terms, glob_to_java, is_pattern

MOST_TERMS = 64


def _low(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def literal_search(raw: Column, expression: str) -> Column:
    """``a|b``: any of them (``&`` is then an ordinary character); ``a&b``: all of them; empty parts are left out.

    An expression without any part matches nothing.
    """
    low = ascii_lower(raw)
    kind = "|" if "|" in expression else "&"
    terms = [low.contains(_low(t)) for t in expression.split(kind) if t]
    if not terms:
        return F.lit(False)
    return reduce(lambda a, b: a | b if kind == "|" else a & b, terms)


def search(raw: Column, expression: str, legacy: bool = False) -> Column:
    """Pattern search if the expression has a special character and is valid, literal search otherwise."""
    terms = compile_terms(expression, legacy) if is_pattern(expression) else None
    if terms is None:
        return literal_search(raw, expression)
    return reduce(lambda a, b: a & b, [raw.rlike(t) for t in terms], F.lit(True))


def pattern_match(raw: Column, pattern: str, legacy: bool = False) -> Column:
    """One pattern of the dialect; an invalid one is an error."""
    from .regexes import to_java

    return raw.rlike(to_java(pattern, legacy))


def glob_match(name: Column, pattern: str) -> Column:
    return name.rlike(glob_to_java(pattern))


def highlight_terms(expression: str) -> list[str]:
    return [t for part in expression.split("|") for t in part.split("&") if t][:MOST_TERMS]


def highlight_ranges(raw: Column, expression: str, most: int = MOST_TERMS) -> Column:
    """``array<struct<start,end>>`` of the places of all literal terms, in order, overlapping ones merged; 0-based, end excluded.

    At most ``most`` places are kept, those of the first terms first.
    """
    terms = highlight_terms(expression)
    if not terms:
        return F.expr("cast(array() as array<struct<start:int,end:int>>)")
    low = ascii_lower(raw)

    def places(term: str) -> Column:
        # The pieces between hits have known lengths, so a running sum of them gives every hit.
        pieces = F.slice(F.split(low, _regex_quote(_low(term)), -1), F.lit(1), F.greatest(F.size(F.split(low, _regex_quote(_low(term)), -1)) - 1, F.lit(0)))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("got"))

        def step(state: Column, piece: Column) -> Column:
            at = state["at"] + F.length(piece)
            return F.struct((at + len(term)).alias("at"), F.concat(state["got"], F.array(F.struct(at.alias("start"), (at + len(term)).alias("end")))).alias("got"))

        return F.aggregate(pieces, start, step)["got"]

    found = F.array_sort(F.slice(F.concat(*[places(t) for t in terms]), 1, most))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) == 0), F.array(x)).when(x["start"] >= last["end"], F.concat(done, F.array(x))).otherwise(joined)

    return F.aggregate(found, empty, lambda done, x: F.when(F.size(done) == 0, F.array(x)).otherwise(merge(done, x)))


def _regex_quote(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}" else c for c in text)

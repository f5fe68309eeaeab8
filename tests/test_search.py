"""Search, the pattern dialect, globs and highlights."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from loglens.functions import regexes, search

from .test_lines import one

CASES = [
    ("error", "an ERROR here", True), ("a|b", "xx b", True), ("a&b", "b only", False), ("a&b", "b and a", True), ("a|b&c", "b&c", True), ("", "x", False), ("|", "x", False), ("a||", "has a", True),
    (r"\d+", "abc 12", True), ("^abc$", "abc", True), ("^abc$", "abcd", False), ("a.c", "a-c", True), ("ab?c", "ac", True), ("ab?c", "abbc", False), ("[a-c]x", "Bx", True), ("[^0-9]$", "ab1", False),
    ("(a|ab)c", "abc", False), ("(ab|a)c", "abc", True), ("(x|y|z)1", "z1", True), ("a{2}", "a{2}", True), ("a{2}", "aa", False), (r"\bx", "bx", True), ("x$y", "x$y", False), ("x^y", "x^y", True),
    ("a+&b+", "aa bb", True), ("a+&b+", "aa", False), ("[abc", "[ABC", True), ("(open", "say (open", True), (r"\s", "a b", True), (r"\W", "ab_9", False), ("[]a]", "a", True), ("[]a]", "]", False),
]


@pytest.mark.parametrize(("expression", "line", "expected"), CASES)
def test_search(spark, expression, line, expected):
    assert one(spark, [line], search.search(F.col("x"), expression)) == [expected]


@pytest.mark.parametrize("pattern", ["[a", "(a", "a\\", "*a", "a|*", "a)", "a**"])
def test_invalid_patterns(pattern):
    with pytest.raises(regexes.InvalidPattern):
        regexes.to_java(pattern)


def test_legacy_reading():
    assert re.search(regexes.to_java("ab?c", legacy=True).replace(r"\z", r"\Z"), "abbc")
    assert regexes.to_java("(a|b|c)", legacy=True) == "(?is)(?>a)"


def test_too_many_terms_are_a_literal():
    assert regexes.compile_terms("&".join(["a."] * 9)) is None
    assert len(regexes.compile_terms("&".join(["a."] * 8))) == 8


@pytest.mark.parametrize(("pattern", "name", "expected"), [("api*", "api.service", True), ("*.service", "a.socket", False), ("a*b*c", "aXbYc", True), ("a.c", "abc", False), ("*", "", True), ("API*", "api", False)])
def test_glob(spark, pattern, name, expected):
    assert one(spark, [name], search.glob_match(F.col("x"), pattern)) == [expected]


def model(line: str, expression: str, most: int = 64) -> list[tuple[int, int]]:
    found = []
    for term in search.highlight_terms(expression):
        at = line.lower().find(term.lower())
        while at >= 0:
            found.append((at, at + len(term)))
            at = line.lower().find(term.lower(), at + len(term))
    done: list[tuple[int, int]] = []
    for a, b in sorted(found[:most]):
        if done and a < done[-1][1]:
            done[-1] = (done[-1][0], max(b, done[-1][1]))
        else:
            done.append((a, b))
    return done


@pytest.mark.parametrize("expression", ["ab", "ab|bc", "a&b", "aa", "x.y|ab", "|"])
def test_highlight(spark, expression):
    rows = ["abcabc", "ABab aab", "", "aaaa x.y", "none"]
    got = one(spark, rows, search.highlight_ranges(F.col("x"), expression))
    assert [[tuple(r) for r in g] for g in got] == [model(r, expression) for r in rows]

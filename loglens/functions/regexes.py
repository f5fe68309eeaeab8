"""The search dialect of regular expressions, turned into Java patterns for ``rlike``.

The dialect has ``. * + ? ^ $ [] () |`` and the escapes d D w W s S n r t; braces are literal, any other escape is the
character itself, ``^`` counts only at the start and ``$`` only at the end of an alternative, groups don't give back what
they matched, and case doesn't count for ASCII letters.
"""

from __future__ import annotations

SPECIAL = frozenset(".^$*+?()[]{}\\")
_CLASS_ESCAPES = {"d", "D", "w", "W", "s", "S"}
_CONTROL = {"n": r"\n", "r": r"\r", "t": r"\t"}
#: White space of the escape s: blank, tab, line end and carriage return.
_SETS = {"s": r" \t\n\r\x0B\f", "d": "0-9", "w": "A-Za-z0-9_"}


class InvalidPattern(ValueError):
    """The pattern isn't one of the dialect."""


def is_pattern(expression: str) -> bool:
    """Whether a search expression is to be read as a pattern at all."""
    return any(c in SPECIAL for c in expression)


def _quoted(c: str) -> str:
    return f"\\{c}" if c in r"\^$.|?*+()[]{}&-~#" else c


class _Reader:
    """Recursive descent over one pattern."""

    def __init__(self, pattern: str, legacy: bool) -> None:
        self.text, self.at, self.legacy = pattern, 0, legacy

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def alternatives(self, depth: int) -> str:
        parts = [self.sequence(depth)]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence(depth))
        if depth and self.legacy and len(parts) > 2:
            parts = parts[:1]
        return "|".join(parts)

    def sequence(self, depth: int) -> str:
        out: list[str] = []
        start = self.at
        while (c := self.peek()) and c != "|":
            if c == ")":
                if depth:
                    break
                raise InvalidPattern("unopened group")
            if c in "*+?":
                raise InvalidPattern("quantifier without an atom")
            first = self.at == start
            atom = self.atom(depth, first)
            if (q := self.peek()) and q in "*+?":
                self.at += 1
                atom += "*" if q == "?" and self.legacy else q
            out.append(atom)
        return "".join(out)

    def atom(self, depth: int, first: bool) -> str:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            return self.escape(False)
        if c == "[":
            return self.char_class()
        if c == "(":
            inner = self.alternatives(depth + 1)
            if self.peek() != ")":
                raise InvalidPattern("unclosed group")
            self.at += 1
            return f"(?>{inner})"
        if c == ".":
            return "."
        if c == "^":
            return "^" if first and not depth else r"\^"
        if c == "$":
            return r"\z" if self.peek() in ("", "|", ")") else "(?!)"
        return _quoted(c)

    def escape(self, inside: bool) -> str:
        if self.at >= len(self.text):
            raise InvalidPattern("backslash at the end")
        c = self.text[self.at]
        self.at += 1
        if c in _CLASS_ESCAPES:
            negated, own = c.isupper(), _SETS[c.lower()]
            return f"[{'^' * negated}{own}]"
        return _CONTROL.get(c) or _quoted(c)

    def char_class(self) -> str:
        negated = self.peek() == "^"
        self.at += negated
        if self.peek() == "]":  # closes nothing there, and isn't a member
            self.at += 1
        items: list[str] = []
        while (c := self.peek()) != "]":
            if not c:
                raise InvalidPattern("unclosed class")
            self.at += 1
            rest = self.text[self.at : self.at + 2]
            if c == "\\":
                items.append(self.escape(True))
            elif len(rest) == 2 and rest[0] == "-" and rest[1] != "]":
                self.at += 2
                low, high = c.lower(), rest[1].lower()
                if low <= high:
                    items.append(f"{_quoted(low)}-{_quoted(high)}")
            else:
                items.append(_quoted(c))
        self.at += 1
        if not items:
            return "." if negated else "(?!)"
        return f"[{'^' * negated}{''.join(items)}]"


def to_java(pattern: str, legacy: bool = False) -> str:
    """The Java pattern of one pattern; raises InvalidPattern.

    ``legacy`` reads ``?`` as ``*`` and only the first of three or more alternatives of a group.
    """
    reader = _Reader(pattern, legacy)
    body = reader.alternatives(0)
    return f"(?is){body}"


def compile_terms(expression: str, legacy: bool = False, most: int = 8) -> list[str] | None:
    """Java patterns that must all match, from a pattern or several joined by ``&``; None if any is invalid or there are too many."""
    parts = [p for p in expression.split("&") if p] if "&" in expression else [expression]
    if len(parts) > most:
        return None
    try:
        return [to_java(p, legacy) for p in parts]
    except InvalidPattern:
        return None


def glob_to_java(pattern: str) -> str:
    """The Java pattern of a whole-name glob in which only ``*`` is special."""
    return r"(?s)\A" + ".*".join("".join(map(_quoted, part)) for part in pattern.split("*")) + r"\z"

"""Queries and agent settings from command-line words or keyword arguments."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from ..functions.keys import parse_mode
from ..functions.levels import LEVELS
from ..operators.filters import LogFilter
from ..operators.rules import Threshold

DEFAULT_LISTEN, DEFAULT_FLUSH_MS, DEFAULT_BATCH = "127.0.0.1:9100", 5000, 1024


class ConfigError(ValueError):
    """A flag or setting that can't be used; ``code`` names the mistake."""

    def __init__(self, code: str, text: str = "") -> None:
        super().__init__(f"{code}: {text}" if text else code)
        self.code = code


#: Long flags with a value, the field each sets, and its letter if it has one.
VALUED = {
    "file": ("files", "f"), "search": ("search", "s"), "level": ("levels", "l"), "date": ("date", "d"), "num-lines": ("num_lines", "n"), "aggregate-mode": ("aggregate_mode", "m"), "from": ("from_time", ""), "to": ("to_time", ""), "output": ("output", ""),
    "listen": ("listen", ""), "metrics-token": ("metrics_token", ""), "alert-error-rate": ("error_rate", ""), "alert-regex": ("regex_rules", ""), "alert-silence": ("silence", ""), "alert-file": ("alert_file", ""), "alert-webhook": ("webhooks", ""), "webhook-header": ("webhook_headers", ""),
    "service": ("services", ""), "crash-marker": ("crash_markers", ""), "journal-unit": ("journal_units", ""), "sidecar": ("sidecar", ""), "sidecar-header": ("sidecar_headers", ""), "sidecar-flush-interval": ("sidecar_flush", ""), "sidecar-batch-size": ("sidecar_batch", ""),
}
SWITCHES = {"tail": ("tail", "t"), "aggregate": ("aggregate", "a"), "agent": ("agent", ""), "alert-first-seen": ("first_seen", ""), "alert-stderr": ("stderr", ""), "alert-exit": ("exit_on_alert", ""), "kernel-probes": ("kernel_probes", "")}
REPEATED = {"files", "regex_rules", "webhooks", "webhook_headers", "services", "crash_markers", "journal_units", "sidecar_headers"}
_LETTERS = {letter: name for table in (VALUED, SWITCHES) for name, (_, letter) in table.items() if letter}


@dataclass(frozen=True)
class LogQuery:
    """Everything that can be asked on the command line."""

    files: tuple[str, ...] = ()
    search: str | None = None
    levels: tuple[str, ...] = ()
    date: str | None = None
    from_time: str | None = None
    to_time: str | None = None
    num_lines: int = 0
    aggregate: bool = False
    aggregate_mode: str = "exact"
    output: str | None = None
    tail: bool = False
    agent: bool = False
    listen: str | None = None
    metrics_token: str | None = None
    error_rate: str | None = None
    regex_rules: tuple[str, ...] = ()
    first_seen: bool = False
    silence: str | None = None
    stderr: bool = False
    alert_file: str | None = None
    webhooks: tuple[str, ...] = ()
    webhook_headers: tuple[str, ...] = ()
    exit_on_alert: bool = False
    kernel_probes: bool = False
    services: tuple[str, ...] = ()
    crash_markers: tuple[str, ...] = ()
    journal_units: tuple[str, ...] = ()
    sidecar: str | None = None
    sidecar_headers: tuple[str, ...] = ()
    sidecar_flush: str | None = None
    sidecar_batch: str | None = None
    help: bool = False
    version: bool = False

    def filter(self) -> LogFilter:
        return LogFilter(self.search, self.levels, self.date, self.from_time, self.to_time)


def parse_levels(text: str) -> tuple[str, ...]:
    own = [p.strip(" \t\n\r\x0b\x0c") for p in text.split(",")]
    names = [p.capitalize() for p in own if p]
    if not names or any(n not in LEVELS for n in names):
        raise ConfigError("InvalidLevel", text)
    return tuple(names)


def _put(query: LogQuery, name: str, value: str) -> LogQuery:
    place = VALUED[name][0]
    if place in REPEATED:
        return replace(query, **{place: (*getattr(query, place), value)})
    if place == "levels":
        return replace(query, levels=tuple(x for x in LEVELS if x in (*query.levels, *parse_levels(value))))
    if place == "num_lines":
        if not re.fullmatch(r"\+?[0-9]+", value) or int(value) == 0:
            raise ConfigError("InvalidNumLines", value)
        return replace(query, num_lines=int(value))
    if place == "aggregate_mode":
        try:
            return replace(query, aggregate_mode=parse_mode(value))
        except ValueError:
            raise ConfigError("InvalidAggregateMode", value) from None
    if place == "output" and value != "json":
        raise ConfigError("InvalidOutputMode", value)
    return replace(query, **{place: value})


def _missing(name: str) -> ConfigError:
    return ConfigError("Missing" + "".join(w.capitalize() for w in VALUED[name][0].rstrip("s").split("_")), f"--{name}")


def parse_words(words: Sequence[str]) -> LogQuery:
    """A query from the words after the program's name; ``-h`` and ``-v`` end the reading."""
    query, rest = LogQuery(), list(words)
    while rest:
        word = rest.pop(0)
        if word == "--":
            return replace(query, files=(*query.files, *rest))
        if word in ("-h", "--help"):
            return replace(query, help=True)
        if word in ("-v", "--version"):
            return replace(query, version=True)
        if word.startswith("--"):
            name, equals, value = word[2:].partition("=")
            if name in VALUED:
                if not equals and not rest:
                    raise _missing(name)
                query = _put(query, name, value if equals else rest.pop(0))
            elif name in SWITCHES and not equals:
                query = replace(query, **{SWITCHES[name][0]: True})
            else:
                raise ConfigError("InvalidArgument" if name in SWITCHES else "UnknownArgument", word)
            continue
        if len(word) < 2 or word[0] != "-":
            query = replace(query, files=(*query.files, word))
            continue
        letters = word[1:]
        while letters:
            letter, letters = letters[0], letters[1:]
            if letter in "hv":
                return replace(query, help=letter == "h", version=letter == "v")
            name = _LETTERS.get(letter)
            if name is None:
                raise ConfigError("UnknownArgument", word)
            if name in SWITCHES:
                query = replace(query, **{SWITCHES[name][0]: True})
                continue
            if not letters and not rest:
                raise _missing(name)
            query, letters = _put(query, name, letters or rest.pop(0)), ""
    return query


_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def parse_duration(text: str) -> int:
    """Milliseconds of ``250ms``, ``30s``, ``5m`` or ``1h``."""
    m = re.fullmatch(r"([0-9]+)(ms|s|m|h)", text)
    if not m or int(m[1]) * _UNITS[m[2]] >= 1 << 64:
        raise ConfigError("InvalidDuration", text)
    return int(m[1]) * _UNITS[m[2]]


def parse_threshold(text: str) -> Threshold:
    """``N/W``: so many within a time, both above zero."""
    n, slash, window = text.partition("/")
    if not slash or not re.fullmatch(r"\+?[0-9]+", n) or not 0 < int(n) < 1 << 32 or not window:
        raise ConfigError("InvalidThresholdSpec", text)
    ms = parse_duration(window)
    if not ms:
        raise ConfigError("InvalidThresholdSpec", text)
    return Threshold(int(n), ms)


def parse_regex_rule(text: str) -> tuple[str, Threshold]:
    """``pattern:N/W``; the pattern may hold colons."""
    pattern, colon, rest = text.rpartition(":")
    try:
        if not colon or not pattern:
            raise ConfigError("InvalidRegexSpec", text)
        return pattern, parse_threshold(rest)
    except ConfigError:
        raise ConfigError("InvalidRegexSpec", text) from None


def parse_binding(text: str, code: str = "InvalidServiceSpec") -> tuple[str, str]:
    """``NAME=VALUE``, both not empty."""
    name, _, value = text.partition("=")
    if not name or not value:
        raise ConfigError(code, text)
    return name, value


def parse_header(text: str) -> tuple[str, str]:
    name, _, value = text.partition(":")
    if not name or not value.lstrip(" \t"):
        raise ConfigError("InvalidHeaderSpec", text)
    return name, value.lstrip(" \t")


@dataclass(frozen=True)
class AgentConfig:
    """Settings of the agent, checked."""

    metrics_token: str
    listen: str = DEFAULT_LISTEN
    error_rate: Threshold | None = None
    regex_rules: tuple[tuple[str, Threshold], ...] = ()
    first_seen: bool = False
    silence_ms: int | None = None
    stderr: bool = True
    alert_file: str | None = None
    webhooks: tuple[str, ...] = ()
    webhook_headers: dict[str, str] = field(default_factory=dict)
    exit_on_alert: bool = False
    services: tuple[tuple[str, str], ...] = ()
    crash_markers: tuple[str, ...] = ()
    journal_units: tuple[tuple[str, str], ...] = ()
    sidecar: str | None = None
    sidecar_headers: dict[str, str] = field(default_factory=dict)
    sidecar_flush_ms: int = DEFAULT_FLUSH_MS
    sidecar_batch: int = DEFAULT_BATCH

    @classmethod
    def of(cls, q: LogQuery) -> AgentConfig:
        """From a query; without any sink alerts go to the error stream."""
        if not q.metrics_token:
            raise ConfigError("MissingMetricsToken")
        if q.sidecar is not None and not q.sidecar.startswith("https://"):
            raise ConfigError("InvalidSidecarUrl", q.sidecar)
        if q.sidecar_batch is not None and not (re.fullmatch(r"\+?[0-9]+", q.sidecar_batch) and int(q.sidecar_batch) < 1 << 32):
            raise ConfigError("InvalidBatchSize", q.sidecar_batch)
        return cls(
            q.metrics_token,
            q.listen or DEFAULT_LISTEN,
            parse_threshold(q.error_rate) if q.error_rate is not None else None,
            tuple(map(parse_regex_rule, q.regex_rules)),
            q.first_seen,
            parse_duration(q.silence) if q.silence is not None else None,
            q.stderr or not (q.alert_file or q.webhooks),
            q.alert_file,
            q.webhooks,
            dict(map(parse_header, q.webhook_headers)),
            q.exit_on_alert,
            tuple(map(parse_binding, q.services)),
            q.crash_markers,
            tuple(parse_binding(x, "InvalidJournalSpec") for x in q.journal_units),
            q.sidecar,
            dict(map(parse_header, q.sidecar_headers)),
            parse_duration(q.sidecar_flush) if q.sidecar_flush is not None else DEFAULT_FLUSH_MS,
            int(q.sidecar_batch) if q.sidecar_batch is not None else DEFAULT_BATCH,
        )

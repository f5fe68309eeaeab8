"""Posting to collectors and webhooks, with retries and counts of what was lost."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

MOST_BODY = 4 << 20
RETRIES, FIRST_WAIT_MS, LONGEST_WAIT_MS = 3, 100, 5000
Post = Callable[[str, bytes, dict[str, str]], int]


def retryable(status: int) -> bool:
    """Whether another try may help: no answer (0), time-outs, too many requests, and server errors."""
    return status in (0, 408, 429) or status >= 500


def wait_ms(retry: int) -> int:
    """Before the first, second... retry: doubled each time, up to a limit."""
    return min(FIRST_WAIT_MS << (retry - 1), LONGEST_WAIT_MS)


def http_post(url: str, body: bytes, headers: dict[str, str], timeout: float = 10.0) -> int:
    """The status of a POST; 0 if there was no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code
    except OSError:
        return 0


@dataclass
class Collector:
    """Sends encoded requests to a collector over https, compressed."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    post: Post = http_post
    sleep: Callable[[float], None] = time.sleep
    sent: int = 0
    failed_retryable: int = 0
    failed: int = 0

    def __post_init__(self) -> None:
        if not self.url.startswith("https://"):
            raise ValueError("a collector's address must start with https://")

    def send(self, path: str, body: bytes, records: int = 1) -> bool:
        packed = gzip.compress(body, 6)
        if len(packed) > MOST_BODY:
            self.failed += records
            return False
        headers = {"Content-Type": "application/x-protobuf", "Content-Encoding": "gzip"} | self.headers
        for attempt in range(RETRIES + 1):
            if attempt:
                self.sleep(wait_ms(attempt) / 1000)
            status = self.post(self.url.rstrip("/") + path, packed, headers)
            if 200 <= status < 300:
                self.sent += records
                return True
            if not retryable(status):
                self.failed += records
                return False
        self.failed_retryable += records
        return False


@dataclass
class Webhook:
    """Posts payloads to addresses without retries; with ``most``, only so many of a batch are taken, the newest are dropped and counted."""

    urls: list[str]
    headers: dict[str, str] = field(default_factory=dict)
    most: int | None = None
    post: Post = http_post
    sent: int = 0
    failed: int = 0
    dropped: int = 0

    def send(self, payloads: Iterable[str]) -> None:
        for i, p in enumerate(payloads):
            if self.most is not None and i >= self.most:
                self.dropped += 1
                continue
            for url in self.urls:
                ok = 0 < self.post(url, p.encode(), {"Content-Type": "application/json"} | self.headers) < 400
                self.sent, self.failed = self.sent + ok, self.failed + (not ok)

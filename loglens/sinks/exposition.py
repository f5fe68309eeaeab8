"""Metrics as text for scrapers, and as a JSON snapshot."""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

from pyspark.sql import DataFrame

from ..operators.metrics import LEVEL_LABELS, ROUTES, RULE_LABELS, STATUSES, alert_counters, line_counters


@dataclass
class Snapshot:
    """Counters at one time."""

    uptime_seconds: int = 0
    files_watched: int = 0
    lines: dict[str, int] = field(default_factory=dict)
    bytes: int = 0
    alerts: dict[str, int] = field(default_factory=dict)
    requests: dict[tuple[str, int], int] = field(default_factory=dict)
    rotations: int = 0

    def add(self, lines: DataFrame | None = None, alerts: DataFrame | None = None) -> None:
        """Add the counts of a batch."""
        for r in line_counters(lines).collect() if lines is not None else []:
            self.lines[r["level"]] = self.lines.get(r["level"], 0) + r["lines"]
            self.bytes += r["bytes"]
        for r in alert_counters(alerts).collect() if alerts is not None else []:
            self.alerts[r["rule"]] = self.alerts.get(r["rule"], 0) + r["count"]

    def text(self, prefix: str = "loglens") -> str:
        families: list[tuple[str, str, str, list[tuple[str, int]]]] = [
            ("up", "gauge", "Whether the agent is up.", [("", 1)]),
            ("uptime_seconds", "gauge", "Seconds since the start.", [("", self.uptime_seconds)]),
            ("files_watched", "gauge", "Files that are followed.", [("", self.files_watched)]),
            ("lines_total", "counter", "Lines by level.", [(f'{{level="{x}"}}', self.lines.get(x, 0)) for x in LEVEL_LABELS]),
            ("bytes_total", "counter", "Bytes of lines.", [("", self.bytes)]),
            ("alerts_fired_total", "counter", "Alerts by rule.", [(f'{{rule="{x}"}}', self.alerts.get(x, 0)) for x in RULE_LABELS]),
            ("http_requests_total", "counter", "Requests by route and status.", [(f'{{route="{r}",code="{c}"}}', self.requests.get((r, c), 0)) for r in ROUTES for c in STATUSES]),
            ("file_rotation_total", "counter", "Files that were rotated or cut.", [("", self.rotations)]),
        ]
        return "".join(f"# HELP {prefix}_{n} {about}\n# TYPE {prefix}_{n} {kind}\n" + "".join(f"{prefix}_{n}{labels} {v}\n" for labels, v in rows) for n, kind, about, rows in families)

    def json(self) -> str:
        requests = [{"route": r, "code": c, "count": n} for r in ROUTES for c in STATUSES if (n := self.requests.get((r, c), 0))]
        return json.dumps({"uptime_seconds": self.uptime_seconds, "files_watched": self.files_watched, "lines_total": {x: self.lines.get(x, 0) for x in LEVEL_LABELS}, "bytes_total": self.bytes, "alerts_fired_total": {x: self.alerts.get(x, 0) for x in RULE_LABELS}, "http_requests_total": requests, "file_rotation_total": self.rotations}, separators=(",", ":"))


def authorised(header: str | None, token: str) -> bool:
    """Whether a request carries the token, compared in constant time."""
    return header is not None and hmac.compare_digest(header.encode(), f"Bearer {token}".encode())


def route_of(path: str) -> str:
    own = path.split("?", 1)[0]
    return own if own in ROUTES[:3] else "other"


def respond(path: str, header: str | None, token: str, snapshot: Snapshot) -> tuple[int, str, str]:
    """(status, content type, body) of a GET; the health route needs no token."""
    route = route_of(path)
    status, kind, body = 200, "text/plain; charset=utf-8", "ok\n"
    if route == "other":
        status, body = 404, "not found\n"
    elif route != "/healthz":
        if not authorised(header, token):
            status, body = 401, "unauthorized\n"
        elif route == "/metrics":
            kind, body = "text/plain; version=0.0.4; charset=utf-8", snapshot.text()
        else:
            kind, body = "application/json", snapshot.json()
    snapshot.requests[(route, status)] = snapshot.requests.get((route, status), 0) + 1
    return status, kind, body


def serve(snapshot: Callable[[], Snapshot], token: str, address: tuple[str, int] = ("127.0.0.1", 9100)) -> ThreadingHTTPServer:
    """A server on the driver that answers from the current snapshot; ``shutdown`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, kind, body = respond(self.path, self.headers.get("Authorization"), token, snapshot())
            self.send_response(status)
            for k, v in (("Content-Type", kind), ("Cache-Control", "no-store"), ("Content-Length", str(len(body.encode())))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer(address, Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server

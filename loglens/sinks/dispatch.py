"""One batch of events to all sinks; the same function serves batches and ``foreachBatch``."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import jsonl, otlp
from .transport import Collector, Webhook

RENDER = {"rule": jsonl.alert_json, "service": jsonl.service_json, "kernel": jsonl.kernel_json}
RECORDS = {"rule": otlp.rule_records, "service": otlp.service_records, "kernel": otlp.kernel_records}


@dataclass
class Dispatcher:
    """Renders events and hands them to the error stream, a folder, webhooks and a collector.

    ``alerts`` counts events by kind; ``stop`` is called after the first batch that has any.
    """

    stderr: bool = False
    folder: str | None = None
    webhook: Webhook | None = None
    collector: Collector | None = None
    resource: dict[str, str] = field(default_factory=dict)
    stop: Callable[[], None] | None = None
    alerts: dict[str, int] = field(default_factory=dict)

    def dispatch(self, events: DataFrame, kind: str) -> int:
        """Sends ``rule``, ``service`` or ``kernel`` events; returns how many."""
        own = events.persist()
        try:
            for r in own.groupBy("kind").count().collect():
                self.alerts[r["kind"]] = self.alerts.get(r["kind"], 0) + r["count"]
            n = own.count()
            if not n:
                return 0
            rendered = own.select(RENDER[kind]().alias("payload"))
            if self.folder:
                jsonl.append_events(rendered, self.folder)
            if self.stderr:
                for r in rendered.toLocalIterator():
                    print(r["payload"], file=sys.stderr)
            if self.webhook:
                self.webhook.send(r["payload"] for r in rendered.toLocalIterator())
            if self.collector:
                for r in otlp.requests_of(RECORDS[kind](own), self.resource).toLocalIterator():
                    self.collector.send("/v1/logs", bytes(r["body"]), r["records"])
        finally:
            own.unpersist()
        if self.stop:
            self.stop()
        return n

    def for_each_batch(self, kind: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, _: self.dispatch(batch, kind) and None

"""Following growing files as a stream: appended lines, rotation, truncation.

The offset of a file is its identity and the place read up to.  A new identity or a smaller file starts again at 0; only
whole lines are read, and at most ``maxBytesPerFile`` bytes of a file in one batch, so no file holds up the others.
Files are listed and read where the driver and executors both see them (a shared mount).
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, line_no bigint, raw string, event string"
MOST_BYTES = 4 << 20
#: Bytes read at a time when the last line end of a file is looked for.
BLOCK = 64 << 10


class Stretch(InputPartition):
    """Part of a file, and whether the file was rotated or cut before it."""

    def __init__(self, path: str, start: int, end: int, restarted: bool) -> None:
        self.path, self.start, self.end, self.restarted = path, start, end, restarted


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pattern = options["path"]
        self.from_end = options.get("from", "end") == "end"
        self.most = int(options.get("maxBytesPerFile", MOST_BYTES))
        self.seen: dict[str, tuple[str, int]] = {}

    def _files(self) -> dict[str, os.stat_result]:
        return {p: os.stat(p) for p in sorted(glob.glob(self.pattern)) if os.path.isfile(p)}

    def initialOffset(self) -> dict:
        own = {p: [f"{s.st_dev}:{s.st_ino}", self._whole(p, 0, s.st_size) if self.from_end else 0, False] for p, s in self._files().items()}
        return {"files": json.dumps(own)}

    def _whole(self, path: str, start: int, end: int) -> int:
        """The end of the last whole line between two places, found from the end backwards; a line longer than the limit is taken in parts."""
        with open(path, "rb") as f:
            at = end
            while at > start:
                begin = max(start, at - BLOCK)
                f.seek(begin)
                cut = f.read(at - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                at = begin
        return end if end - start >= self.most else start

    def latestOffset(self) -> dict:
        known = getattr(self, "_last", None) or json.loads(self.initialOffset()["files"])
        out = {}
        for path, s in self._files().items():
            name = f"{s.st_dev}:{s.st_ino}"
            old, at, _ = known.get(path, [name, 0, False])
            again = old != name or s.st_size < at
            start = 0 if again else at
            out[path] = [name, self._whole(path, start, min(s.st_size, start + self.most)), again]
        self._last = out
        return {"files": json.dumps(out)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (_, stop, again) in after.items():
            at = 0 if again or path not in before else before[path][1]
            if stop > at or again:
                out.append(Stretch(path, at, stop, bool(again)))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.restarted:
            yield partition.path, -1, None, "restart"
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        at = partition.start
        for line in data.split(b"\n"):
            if line:
                yield partition.path, at, line.decode(errors="replace"), "line"
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class FollowSource(DataSource):
    """``spark.readStream.format("follow").option("path", glob)``; option ``from`` is ``end`` (default) or ``start``."""

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FollowReader:
        return FollowReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FollowSource)

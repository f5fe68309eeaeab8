"""Text, journal and follow sources."""

from __future__ import annotations

import gzip
import os
import struct

import pytest

from loglens.operators.filters import LogFilter
from loglens.operators.journal import track_units
from loglens.sources import follow, journal_file, journal_json, kmsg, lz4, text


def test_scan_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo\nlast")
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"zip 1\nzip 2\n"))
    (tmp_path / "c.txt").write_text("no")
    got = text.discover(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r["file"]), r["raw"]) for r in got) == [("a.log", "last"), ("a.log", "one\r"), ("a.log", "two"), ("b.log.gz", "zip 1"), ("b.log.gz", "zip 2")]


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = {r["line_no"]: r["raw"] for r in text.scan_numbered(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: f"line {i}" for i in range(5000)}


def test_last_lines_and_pages(spark):
    df = spark.createDataFrame([("a", i, f"{i}") for i in range(25)] + [("b", 0, "x")], "file string, line_no long, raw string")
    assert sorted(r["line_no"] for r in text.last_lines(df, 3).filter("file = 'a'").collect()) == [22, 23, 24]
    assert {r["page"]: r["count"] for r in text.paginate(df, 10).filter("file = 'a'").groupBy("page").count().collect()} == {1: 10, 2: 10, 3: 5}


def wrap(plain: bytes, block: bytes) -> bytes:
    return len(plain).to_bytes(8, "little") + block


def test_lz4():
    assert lz4.decompress(wrap(b"hello", b"\x50hello")) == b"hello"
    assert lz4.decompress(wrap(b"abcabcabcX", b"\x32abc\x03\x00\x10X")) == b"abcabcabcX"
    long = b"q" * 300
    assert lz4.decompress(wrap(long, b"\xf0\xff\x1e" + long)) == long
    for bad in (b"", wrap(b"hello", b"\x50hel"), wrap(b"hellox", b"\x50hello"), wrap(b"aaaa", b"\x10a\x05\x00"), (1 << 40).to_bytes(8, "little")):
        with pytest.raises(lz4.BadBlock):
            lz4.decompress(bad)


class Builder:
    """A journal file of a few entries."""

    def __init__(self, flags: int = 0) -> None:
        self.compact = bool(flags & journal_file.COMPACT)
        self.data = bytearray(240)
        self.data[:8] = journal_file.MAGIC
        struct.pack_into("<I", self.data, 12, flags)
        struct.pack_into("<Q", self.data, 88, 240)

    def put(self, kind: int, body: bytes, flags: int = 0) -> int:
        self.data += b"\0" * (-len(self.data) % 8)
        at = len(self.data)
        self.data += struct.pack("<BB6xQ", kind, flags, 16 + len(body)) + body
        return at

    def field(self, payload: bytes, flags: int = 0) -> int:
        return self.put(1, b"\0" * (56 if self.compact else 48) + payload, flags)

    def entry(self, n: int, fields: list[int]) -> int:
        items = b"".join(struct.pack("<I" if self.compact else "<Q8x", f) for f in fields)
        return self.put(3, struct.pack("<QQQ16sQ", n, n * 1000, n, b"b" * 16, 0) + items)

    def array(self, entries: list[int], following: int = 0) -> int:
        return self.put(6, struct.pack("<Q", following) + b"".join(struct.pack("<I" if self.compact else "<Q", e) for e in entries))

    def done(self, first: int) -> bytes:
        struct.pack_into("<Q", self.data, 176, first)
        return bytes(self.data)


def sample(flags: int) -> bytes:
    b = Builder(flags)
    unit, first = b.field(b"_SYSTEMD_UNIT=api.service"), b.field(b"MESSAGE=panic: lost")
    packed = b.field(wrap(b"MESSAGE=\tframe", b"\xe0MESSAGE=\tframe"), journal_file.LZ4)
    more = b.array([b.entry(3, [unit, b.field(b"MESSAGE=a=b"), b.field(b"MESSAGE=second")]), 0])
    return b.done(b.array([b.entry(1, [first, unit]), 0, b.entry(2, [packed, unit])], more))


@pytest.mark.parametrize("flags", [0, journal_file.COMPACT | journal_file.LZ4 | journal_file.KEYED])
def test_journal_file(flags):
    got = list(journal_file.Journal(sample(flags)).entries())
    assert [e["fields"]["MESSAGE"] for e in got] == [b"panic: lost", b"\tframe", b"a=b"]
    assert got[0]["seqnum"] == 1 and got[0]["realtime_us"] == 1000 and got[0]["boot_id"] == b"b" * 16
    assert [e["seqnum"] for e in journal_file.Journal(sample(flags)).entries(skip=2)] == [3]


def test_bad_journals():
    good = sample(0)
    for bad in (b"", b"X" * 240, good[:100], good[:12] + struct.pack("<I", 1) + good[16:], good[:176] + struct.pack("<Q", 1 << 40) + good[184:]):
        with pytest.raises(journal_file.BadJournal):
            list(journal_file.Journal(bad).entries())


def test_journal_files_to_crashes(spark, tmp_path):
    (tmp_path / "x.journal").write_bytes(sample(0))
    entries = journal_json.read_any(spark, str(tmp_path))
    (crash,) = track_units(entries, "src", "api*", until_ms=10_000).collect()
    assert (crash["marker"], crash["stack_trace"], crash["file"]) == ("go_panic", "\tframe\n", "journal://api.service")
    assert journal_json.freshest(spark, str(tmp_path)).endswith("x.journal")


def test_exported_journal(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"MESSAGE":"a \\"b\\" \\u00e4","_SYSTEMD_UNIT":"u","PRIORITY":"3","_PID":"9","__REALTIME_TIMESTAMP":"5000"}\nno json\n' + '{"MESSAGE":"' + "x" * 20_000 + '"}\n')
    got = journal_json.read_any(spark, str(tmp_path / "e.json"), format="json").sort("pos").collect()
    assert [(r["message"], r["t_ms"], r["pid"]) for r in got] == [('a "b" ä', 5, "9"), (None, None, None)]
    with pytest.raises(ValueError):
        journal_json.read_any(spark, "x", format="other")


def test_kmsg(spark, tmp_path):
    (tmp_path / "k").write_text("6,1,2,-;hello\n SUBSYSTEM=x\n6,2,3,-;world\n")
    assert sorted(r["record"] for r in kmsg.read(spark, str(tmp_path / "k")).collect()) == ["6,1,2,-;hello", "6,2,3,-;world"]


def test_follow_reader(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("old\n")
    reader = follow.FollowReader({"path": str(tmp_path / "*.log")})
    start = reader.initialOffset()
    with path.open("a") as f:
        f.write("new 1\nnew 2\nhalf")
    end = reader.latestOffset()
    read = lambda a, b: [(r[2], r[3]) for p in reader.partitions(a, b) for r in reader.read(p)]
    assert read(start, end) == [("new 1", "line"), ("new 2", "line")]
    path.write_text("cut\n")
    cut = reader.latestOffset()
    assert read(end, cut) == [(None, "restart"), ("cut", "line")]
    path.rename(tmp_path / "a.old")
    path.write_text("rotated\n")
    assert read(cut, reader.latestOffset()) == [(None, "restart"), ("rotated", "line")]


def test_follow_stream(spark, tmp_path):
    from loglens.streaming.follow import follow_groups, follow_lines

    (tmp_path / "s.log").write_text("[ERROR] a 1\n[INFO] b\n[ERROR] a 2\n")
    found = []
    query = follow_groups(follow_lines(spark, str(tmp_path / "*.log"), LogFilter(levels=("Error",)), "start"), "normalized", lambda df, n: found.extend((r["key"], r["count"]) for r in df.collect()), checkpointLocation=str(tmp_path / "ck"))
    try:
        for _ in range(100):
            if found:
                break
            query.processAllAvailable()
    finally:
        query.stop()
    assert found == [("[error] a #", 2)]


def test_last_line_end_is_found_backwards(tmp_path, monkeypatch):
    from loglens.sources import follow

    monkeypatch.setattr(follow, "BLOCK", 7)
    path = tmp_path / "a.log"
    for data in (b"", b"x", b"x\n", b"one\ntwo\nthree without an end", b"\n" * 20, b"y" * 50, b"a\n" + b"z" * 60):
        path.write_bytes(data)
        reader = follow.FollowReader({"path": str(path), "maxBytesPerFile": "55"})
        for start in range(0, len(data) + 1, 3):
            cut = data.rfind(b"\n", start) + 1
            assert reader._whole(str(path), start, len(data)) == (cut or (len(data) if len(data) - start >= 55 else start))

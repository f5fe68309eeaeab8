"""Content-addressed WARC archive.

A payload is stored once, compressed, under its SHA-256, in the ``payloads`` table; the exact header block of every record
is kept in the ``records`` table with the digest of its payload.  Original records come back by a join: header block,
payload and record end.  Digests are computed again from the bytes on reading, and a mismatch is an error.  Payloads are
compressed before they are shuffled, and opened a few at a time.

Of records with equal payloads of at least ``least`` bytes, that with the largest id is a response and the others are
revisits that refer to it and carry no payload; all smaller ones are responses.  A payload that very many records have is
copied to several tasks for the join, so no task holds all of them.

Defined results: a null payload is empty; a null id counts as less than any other, and rows that share the largest id and
the payload are all responses; repeated rows are repeated records, each with a record id of its own; an empty table gives
an empty archive; null URLs are left out of the header; line ends in URLs are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunks, join_counted, shared_dir

LEAST = 1000
#: The lines of a header block.
VERSION, LINE, CAPTURED, TYPE = "WARC/1.1", "\r\n", "2024-01-01T00:00:00Z", "text/html; charset=utf-8"
RECORD_END = (LINE * 2).encode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive are."""

    payloads: str
    records: str


def _uuid(digest: Column) -> Column:
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _record_id(page: Column, digest: Column, number: Column) -> Column:
    """From the page, the payload and the number of the row, which tells repeated rows apart."""
    return _uuid(F.sha2(F.concat_ws(" ", F.lit("record"), F.coalesce(page.cast("string"), F.lit("-")), digest, number.cast("string")).cast("binary"), 256))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, compressed."""
    squeeze = zstandard.ZstdCompressor()
    for part in chunks(batches, "payload", 1 << 22):
        packed = [squeeze.compress(p) for p in part.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(packed, pa.binary())], [*part.schema.names[:-1], "packed"])


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, captured: str = CAPTURED) -> Archive:
    """Archive every row; returns the place of the archive, below the shared folder."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    keyed = rows.withColumn("sha256", F.sha2("payload", 256))
    light = keyed.select("id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    base = shared_dir(spark, "warc")
    archive = Archive(f"{base}/payloads", f"{base}/records")

    # Row numbers are written once and never computed again.
    light.withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{base}/index")
    light = spark.read.parquet(f"{base}/index")
    # The largest id of each payload, combined before the shuffle and without payloads.
    largest = F.max(F.struct("id", "number"))
    winners = light.groupBy("sha256").agg(largest.alias("w"), F.count("*").alias("records"))
    winners.select("sha256", F.col("w.id").alias("first_id"), F.col("w.number").alias("first_number"), "records").write.parquet(f"{base}/winners")
    winners = spark.read.parquet(f"{base}/winners")
    key = [F.col("id").isNotNull().alias("has_id"), F.coalesce("id", F.lit(0)).alias("k")]
    ids = winners.withColumnRenamed("first_id", "id").select(*key, "sha256", "records")
    packed = keyed.select(*key, "sha256", "payload").mapInArrow(_packed, "has_id boolean, k long, sha256 string, packed binary")
    own = packed.join(ids, ["has_id", "k", "sha256"]).dropDuplicates(["has_id", "k", "sha256"])
    own.select("sha256", "packed", "records").write.option("compression", "none").parquet(archive.payloads)

    linked = join_counted(light, winners, "sha256", "records", ["number"], light.count())
    revisit = (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first_id"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(LINE))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(VERSION + LINE),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(field("WARC-Target-URI", url), F.lit("")),
        field("WARC-Date", F.lit(captured)),
        field("WARC-Record-ID", _record_id(F.col("id"), F.col("sha256"), F.col("number"))),
        field("Content-Type", F.lit(TYPE)),
        F.coalesce(field("X-Page-ID", F.col("id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(field("WARC-Refers-To", _record_id(F.col("first_id"), F.col("sha256"), F.col("first_number"))), field("X-Refers-To-Page-ID", F.col("first_id").cast("string")), field("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(revisit, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha256")))),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(LINE),
    )
    linked.select(header.cast("binary").alias("header"), "sha256").write.option("compression", "zstd").parquet(archive.records)
    return archive


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(F.col("header").cast("string").contains(f"{LINE}{name}: "), found)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The header block and payload digest of each record, with the header's fields."""
    own = spark.read.schema("header binary, sha256 string").parquet(archive.records)
    return own.select(
        "header",
        "sha256",
        _field("X-Page-ID").cast("long").alias("id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("type"),
        _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        _field("Content-Length").cast("long").alias("content_length"),
    )


def opened(sha256: str, packed: bytes) -> bytes:
    """A stored payload; an error if it isn't the one of this digest."""
    payload = zstandard.ZstdDecompressor().decompress(packed)
    if hashlib.sha256(payload).hexdigest() != sha256:
        raise ValueError(f"stored payload differs from its digest {sha256}")
    return payload


def payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """(sha256, payload): the stored payloads, each checked against the digest that it is stored under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "packed", 1 << 20):
            own = [opened(s, p) for s, p in zip(part.column("sha256").to_pylist(), part.column("packed").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("sha256"), pa.array(own, pa.binary())], ["sha256", "payload"])

    return _stored(spark, archive).select("sha256", "packed").mapInArrow(run, "sha256 string, payload binary")


def _stored(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.schema("sha256 string, packed binary, records long").parquet(archive.payloads)


def _rebuilt(spark: SparkSession, archive: Archive, of: Callable[[bytes, bytes], tuple], schema: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """The columns ``kinds`` that ``of`` makes of every original record and the payload that its digest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "packed", 1 << 20):
            rows = []
            for header, sha256, packed in zip(*(part.column(c).to_pylist() for c in ("header", "sha256", "packed")), strict=True):
                payload = opened(sha256, packed)
                block = payload if b"\r\nWARC-Type: response\r\n" in header else b""
                rows.append(of(header + block + RECORD_END, payload))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    own = spark.read.schema("header binary, sha256 string").parquet(archive.records)
    joined = join_counted(own, _stored(spark, archive), "sha256", "records", ["header"], own.count())
    return joined.select("header", "sha256", "packed").mapInArrow(run, schema)


def fields(record: bytes) -> dict[str, str]:
    """The named fields of a record's header block."""
    lines = record.partition(RECORD_END)[0].decode().split(LINE)[1:]
    return dict(line.partition(": ")[::2] for line in lines)


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """(id, record): the exact bytes of every original record, header block first."""
    of = lambda record, _: (_number(fields(record).get("X-Page-ID")), record)
    return _rebuilt(spark, archive, of, "id long, record binary", [("id", pa.int64()), ("record", pa.binary())])


def described(record: bytes, payload: bytes) -> tuple:
    """(id, payload_bytes, payload_digest, record_type, refers_to, url) of a record, from its own bytes.

    A response's figures come from its block, a revisit's from the payload that it names; an error if its header says otherwise.
    """
    own = fields(record)
    kind = own["WARC-Type"]
    block = record[record.index(RECORD_END) + len(RECORD_END) : -len(RECORD_END)]
    body = block if kind == "response" else payload
    digest = hashlib.sha1(body, usedforsecurity=False).hexdigest()
    if own["WARC-Payload-Digest"] != f"sha1:{digest}" or own["Content-Length"] != str(len(block)) or own["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"record and payload disagree: {own['WARC-Record-ID']}")
    return _number(own.get("X-Page-ID")), len(body), digest, kind, _number(own.get("X-Refers-To-Page-ID")), own.get("WARC-Target-URI")


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Per record, rebuilt from header block and payload: id, payload_bytes, payload_digest (SHA-1 of the payload), record_type, refers_to, url."""
    kinds = [("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    return _rebuilt(spark, archive, described, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string", kinds)


def members(spark: SparkSession, archive: Archive) -> DataFrame:
    """(id, member): every original record as a gzip member of its own; laid end to end, members are a WARC file."""
    of = lambda record, _: (_number(fields(record).get("X-Page-ID")), gzip.compress(record, mtime=0))
    return _rebuilt(spark, archive, of, "id long, member binary", [("id", pa.int64()), ("member", pa.binary())])

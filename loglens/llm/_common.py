"""Shared helpers: table access, checkpointed intermediates, and vectorised byte-level tokenising."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at a time by the vectorised operators; one longer text is handled alone.
CHUNK_BYTES = 1 << 18
#: ASCII white space: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII upper case mapped to lower case; every other byte maps to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor of a cluster shares.

    Only where that setting is missing (tests on a local master) is a folder of our own used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """The column of exactly this name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case of its own names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one key that meet in one task of ``join_counted``, at least; and most keys that may have more.
HOT_ROWS, HOT_KEYS = 256, 1 << 17


def join_counted(many: DataFrame, one: DataFrame, key: str, count: str, spread: list[str], total: int, counts: DataFrame | None = None) -> DataFrame:
    """``many``, of about ``total`` rows, joined to ``one``, which has a row for each key and in ``count`` its number of rows in ``many``.

    Keys of very many rows are few, at most HOT_KEYS: their rows are dealt to several tasks by the hash of ``spread``, and
    their row of ``one`` is copied as often.  ``one`` is read twice and must be the same both times.
    """
    hot = max(HOT_ROWS, -(-total // HOT_KEYS))
    salts = F.ceil(F.col(count) / hot).cast("int")
    heavy = (one if counts is None else counts).filter(F.col(count) > hot).select(key, salts.alias("_salts"))
    dealt = many.join(F.broadcast(heavy), key, "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copied = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > hot, salts - 1).otherwise(0))))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def bucket_of(doc_id: int | None, buckets: int) -> int:
    """crc32 of the id written as text, modulo ``buckets``; a missing id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % buckets


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that each slice has about ``limit`` bytes of text, and 1 to 32,768 rows.

    ``column`` holds the texts, or their sizes as whole numbers.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        own = batch.column(column)
        size = pc.fill_null(own if pa.types.is_integer(own.type) else pc.binary_length(own), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // limit + np.arange(len(size)) // 32768  # rows are numbered in 16 bits
        cuts = np.flatnonzero(np.diff(block)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the len+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        grown = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            grown.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = grown
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span in constant time."""
    up, _ = powers(len(data) + 1)
    h = np.empty(len(data) + 1, dtype=np.uint64)
    h[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=h[1:])
    return h


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def token_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-separator bytes, and per row the number of runs; no run spans two rows."""
    space = separators[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))

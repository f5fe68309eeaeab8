"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece wherever its low bits are all ones; a block size of 2**L asks for L such
bits, so the pieces of twice the block size are unions of pieces.  A fingerprint is ``L:first:second``: one base-64
character for each piece at 2**L and at 2**(L+1).  L is the least with at most 64 pieces, so pieces are never merged
to fit and equal texts have equal fingerprints.  Two fingerprints are compared where they have a block size in common,
by the edit distance (insertions and deletions) of the signatures as a share of their lengths; 8 or more characters on
both sides must have a run of 4 in common, else the likeness is 0.

Defined results: null texts are empty, with the fingerprint ``0::``, alike to each other (1) and unlike all else (0);
texts may be of any length; in the order by id, null ids come first and equal ids follow each other by the SHA-256 of
their texts; a table of one row is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, materialise, mix64, powers, prefix_hash, span_hash

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
WINDOW, PIECES, RUN, LEVELS = 7, 64, 4, 40
BATCH = 1 << 18
#: Bytes of text in a part, and most parts (which get larger beyond); sampled rows a part, from which parts are laid out.
PART_BYTES, MOST_PARTS, SAMPLED = 32 << 20, 1 << 16, 64
KEY_BYTES = 25


def _levels(data: np.ndarray) -> np.ndarray:
    """At each place, the number of low one bits of the hash of the seven bytes that end there."""
    up, _ = powers(len(data) + 1)
    base = up[1]
    x = data.astype(np.uint64) + np.uint64(1)
    two = x.copy()
    two[1:] += x[:-1] * base
    four = two.copy()
    four[2:] += two[:-2] * up[2]
    seven = four.copy()
    seven[4:] += (two[:-4] + np.concatenate([np.zeros(2, np.uint64), x[:-6]])[: len(data) - 4] * up[2]) * up[4] if len(data) > 4 else 0
    h = mix64(seven)
    low = ~h & (h + np.uint64(1))  # the lowest zero bit
    return (np.frexp(low.astype(np.float64))[1] - 1).astype(np.int16)


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text."""
    gap = b"\0" * WINDOW  # no window reaches from one text into the next
    data = np.frombuffer(b"".join(x for t in texts for x in (gap, t)), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(size + WINDOW) - size
    level, prefix = _levels(data), prefix_hash(data)
    out: list[tuple[int, list[bytes]]] = []
    at = np.flatnonzero(level > 0)
    height = np.minimum(level[at], LEVELS)
    edge = np.searchsorted(at, np.concatenate([first, first + size - 1])) if len(texts) else np.zeros(0, np.int64)
    starts, ends, owner = [], [], []
    for i, (a, b) in enumerate(zip(edge[: len(texts)].tolist(), edge[len(texts) :].tolist(), strict=True)):
        f, n = int(first[i]), int(size[i])
        if not n:
            out.append((0, [b"", b""]))
            continue
        if n <= PIECES:
            least = 0
        else:
            above = np.cumsum(np.bincount(height[a:b], minlength=LEVELS + 2)[::-1])[::-1]
            least = int(np.argmax(above[1:] < PIECES)) + 1
        for k in (least, least + 1):
            cut = at[a:b][height[a:b] >= k] + 1 if k else np.arange(f + 1, f + n)
            edges = np.concatenate([[f], cut, [f + n]])
            starts.append(edges[:-1])
            ends.append(edges[1:])
            owner.append(len(edges) - 1)
        out.append((least, []))
    if starts:
        h = span_hash(prefix, np.concatenate(starts), np.concatenate(ends))
        signs = np.split(ALPHABET[(h >> np.uint64(58)).astype(np.int64)], np.cumsum(owner)[:-1])
        each = iter(signs)
        for _, own in out:
            if not own:
                own.extend((next(each).tobytes(), next(each).tobytes()))
    return [f"{k}:{a.decode()}:{b.decode()}" for k, (a, b) in out]


def _common(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """The signatures at the finest block size that both fingerprints of each pair have; empty on one side if there is none."""
    left, right = [], []
    for x, y in zip(a, b, strict=True):
        (i, p, q), (j, r, s) = x.split(":"), y.split(":")
        m = int(i) - int(j)
        u, v = (p, r) if m == 0 else (p, s) if m == 1 else (q, r) if m == -1 else ("", "?")
        left.append(u)
        right.append(v)
    return left, right


def _packed(signs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, signs), dtype=np.int64, count=len(signs))
    flat = np.frombuffer("".join(s.ljust(PIECES, "\0") for s in signs).encode(), dtype=np.uint8)
    return flat.reshape(len(signs), PIECES), size


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of the fingerprints of each pair, 0 to 1, symmetric."""
    left, right = _common(a, b)
    x, m = _packed(left)
    y, n = _packed(right)
    rows = np.arange(len(left))
    place = np.zeros((len(left), 128), dtype=np.uint64)
    for i in range(PIECES):
        own = rows[m > i]
        place[own, x[own, i]] |= np.uint64(1 << i)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    state = np.full(len(left), ones, dtype=np.uint64)
    for j in range(PIECES):  # longest common subsequence, a bit for each character of the left side
        own = np.where(n > j, place[rows, y[:, j]], np.uint64(0))
        match = state & own
        state = np.where(n > j, (state + match) | (state & ~own), state)
    inside = np.where(m >= 64, ones, (np.uint64(1) << np.minimum(m, 63).astype(np.uint64)) - np.uint64(1))
    common = np.bitwise_count(~state & inside).astype(np.int64)
    distance = m + n - 2 * common
    out = np.where(m + n > 0, 1 - distance / np.maximum(m + n, 1), 1.0)
    for i in np.flatnonzero((m >= 2 * RUN) & (n >= 2 * RUN) & (out > 0) & (out < 1)):
        u, v = left[i], right[i]
        runs = {u[k : k + RUN] for k in range(len(u) - RUN + 1)}
        if not any(v[k : k + RUN] in runs for k in range(len(v) - RUN + 1)):
            out[i] = 0
    return out


def _key(doc_id: Column, digest: Column) -> Column:
    """Bytes that sort as (null ids first, id, digest)."""
    flipped = doc_id.bitwiseXOR(F.lit(-(2**63)))
    number = F.unhex(F.lpad(F.hex(F.coalesce(flipped, F.lit(0))), 16, "0"))
    return F.concat(F.unhex(F.when(doc_id.isNull(), "00").otherwise("01")), number, F.substring(F.unhex(digest), 1, 16))


def _heads(light: DataFrame, part_bytes: int) -> list[bytes]:
    """The first key of each part, if the rows (key, bytes) are cut into parts of about so many bytes.

    Cuts are keys of a sample by hash.  It has about SAMPLED rows a part, so it is bounded by MOST_PARTS (100 MB); which rows
    it holds depends on them alone.
    """
    total, rows, least = light.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*"), F.min("key")).first()
    parts = min(MOST_PARTS, total // part_bytes + 1)
    if not rows or parts == 1:
        return [bytes(least)] if rows else []
    rate = min(1.0, SAMPLED * parts / rows)
    sample = light.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(rate * (1 << 30))).sort("key").toArrow()
    keys, size = sample["key"].to_pylist(), np.cumsum(sample["bytes"].to_numpy())
    cuts = {keys[i] for i in np.searchsorted(size, size[-1] * np.arange(1, parts) / parts).tolist()} if keys else set()
    return sorted({bytes(least), *cuts})


def with_next(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (part, last, key, doc_id, text) so that, sorted within each part, every row that isn't ``last`` is followed by
    the row that comes next in the order by (id, digest of the text); the last part ends in the first row of all.

    Parts are ranges of that order, of about ``part_bytes`` each, so a task's work doesn't grow with the input, and rows of
    one id may be in several parts.  Each text is shuffled once, and the first of each part once more, to the part before.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.select(_key(F.col("doc_id"), F.sha2("text", 256)).alias("key"), "doc_id", "text")
    light = materialise(own.select("key", F.octet_length("text").cast("long").alias("bytes")), "order")
    heads = _heads(light, part_bytes)
    shared = spark.sparkContext.broadcast(np.array(heads, dtype=f"S{KEY_BYTES}"))

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(shared.value, np.array(key.to_list(), dtype=f"S{KEY_BYTES}"), "right") - 1).astype(np.int32))

    wanted = spark.createDataFrame([(k, n) for n, k in enumerate(heads)], "key binary, number int")
    before = F.pmod(F.col("number") - 1, F.lit(max(len(heads), 1)))
    placed = own.withColumn("part", part_of("key")).join(F.broadcast(wanted), "key", "left")
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("last"))
    places = F.when(F.col("number").isNull(), F.array(here)).otherwise(F.array(here, F.struct(before.cast("int").alias("part"), F.lit(True).alias("last"))))
    out = placed.withColumn("_at", F.explode(places)).select("_at.part", "_at.last", "key", "doc_id", "text")
    return out.repartition(max(1, len(heads)), "part")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many characters (or all) from the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        part, size, ready = None, 0, []

        def give() -> Iterator[pa.RecordBatch]:
            if not ready:
                return
            texts = [t for _, t, _ in ready]
            change = [edited(t, f) for _, t, f in ready]
            raw = [t.encode("utf-8", "surrogatepass") for t in change]
            own = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
            other, nxt = fingerprints(raw), fingerprints([ready[-1][2].encode("utf-8", "surrogatepass")])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in ready], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(own), pa.array(other), pa.array(likeness(own, other)), pa.array(likeness(own, [*own[1:], *nxt]))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            ready.clear()

        for batch in chunks(batches, "text", BATCH):  # no more texts at a time than one step needs
            for p, last, i, t in zip(*(batch.column(c).to_pylist() for c in ("part", "last", "doc_id", "text")), strict=True):
                if held and p == part:
                    ready.append((*held.pop(), t))
                    size += len(ready[-1][1])
                    if size >= BATCH:
                        yield from give()
                        size = 0
                elif held:  # cannot happen: every part ends in the first row of another one
                    raise ValueError("a part without its last row")
                else:
                    yield from give()
                    size = 0
                part = p
                if not last:
                    held.append((i, t))
                else:
                    yield from give()
                    size = 0
        if held:
            raise ValueError("a part without its last row")
        yield from give()

    ordered = with_next(docs, id_col, text_col, part_bytes).sortWithinPartitions("part", "last", "key")
    return ordered.select("part", "last", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

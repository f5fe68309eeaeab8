"""Best-fit packing of token sequences into fixed-length training sequences.

Best-fit decreasing looks only at lengths, and lengths are integers of 1 to ``capacity``.  So the packing
is planned on the histogram of lengths: open bins of equal history form *runs*, a segment tree over the
remaining capacities finds the tightest capacity that still fits in logarithmic time, and as many pieces
as possible are placed on a run at once.  The plan has a size bounded by ``capacity`` alone, whatever the
number of documents, and equals what best-fit decreasing does piece by piece.  Executors then place every
piece by its rank among the pieces of its length.

Defined results: a null text is empty, so its sequence is the end id alone; repeated rows and repeated ids
are packed as separate documents; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, slot long, nth long"
#: Rows of (shard, length) that may be broadcast (about 150 bytes each, so 40 MB); more of them are joined by a shuffle.
BROADCAST_STARTS = 1 << 18


class FitTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while a run of bins has that capacity left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.full = [False] * (2 * self.size)

    def mark(self, remaining: int, present: bool) -> None:
        node = remaining + self.size
        self.full[node] = present
        while node > 1:
            node >>= 1
            self.full[node] = self.full[2 * node] or self.full[2 * node + 1]

    def tightest(self, need: int) -> int:
        """The least marked capacity of ``need`` or more, -1 if there is none."""
        node = need + self.size
        if self.full[node]:
            return need
        while node > 1:
            if not node & 1 and self.full[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.full[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Returns rows (length, first rank, number of pieces, first sequence, offset): pieces of that length with
    ranks from the first on go to consecutive sequences, at that offset.
    """
    tree, runs, placed, bins = FitTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(first: int, count: int, remaining: int) -> None:
        if remaining:
            if not runs[remaining]:
                tree.mark(remaining, True)
            runs[remaining].append((first, count))

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining < 0:
                first, size, remaining = bins, left, capacity
            else:
                first, size = runs[remaining].pop()
                if not runs[remaining]:
                    tree.mark(remaining, False)
            fit = remaining // length  # a bin that took a piece stays the tightest fit until it holds so many
            full = min(size, left // fit)
            rest = min(left - full * fit, fit) if full < size else 0
            for start, count, each in ((first, full, fit), (first + full, 1, rest)):
                if not count or not each:
                    continue
                for k in range(each):
                    placed.append((length, rank, count, start, capacity - remaining + k * length))
                    rank += count
                put(start, count, remaining - each * length)
                left -= count * each
            used = full + (rest > 0)
            if first == bins:
                bins += used
            elif used < size:
                put(first + used, size - used, remaining)
    return placed


@functools.lru_cache(maxsize=2)
def bpe_encoder(json_path: str, ranks_path: str, pattern: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder for a byte-level BPE stored both as a tokenizer file and as a rank table.

    The rank table gives the same ids several times faster; a text that holds the string of an added token
    goes to the tokenizer file itself, which reads such a string as one token.  A worker keeps its encoder for
    all the tasks that it runs.
    """
    import json

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            if any(a in t for a in added):
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(json_path))
                out.append(slow[0].encode(t, add_special_tokens=False).ids)
            else:
                out.append(fast.encode_ordinary(t))
        return out

    return encode


def cut(ids: list[int], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """(start, ids) of the pieces of one document: whole if it fits, else full pieces after a first one that may be shorter."""
    first = len(ids) % capacity or min(len(ids), capacity)
    start = 0
    for end in range(first, len(ids) + 1, capacity):
        yield start, ids[start:end]
        start = end


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise every whole text, close it with ``end_id`` and cut only what is longer than ``capacity``.

    Returns a row per piece: its document, number, start, length and the crc32 of its ids as little-endian
    unsigned 32-bit numbers, with the ids themselves if ``with_ids``; (shard, slot) identify the piece, and nth is
    its place among the pieces of its length in its shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, slot = encoder(), TaskContext.get().partitionId(), 0
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for part in chunks(batches, text_col):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "slot", "nth", "ids")}
            for doc, ids in zip(part.column(id_col).to_pylist(), encode([t or "" for t in part.column(text_col).to_pylist()]), strict=True):
                ids.append(end_id)
                for n, (start, own) in enumerate(cut(ids, capacity)):
                    for k, v in zip(out, (doc, n, start, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes()), slot, seen[len(own)], own if with_ids else None), strict=True):
                        out[k].append(v)
                    slot += 1
                    seen[len(own)] += 1
            n = len(out["slot"])
            arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")), pa.array([shard] * n, pa.int32()), pa.array(out["slot"], pa.int64()), pa.array(out["nth"], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "slot", "nth"]
            if with_ids:
                arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return own.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give each piece (columns length, shard, slot, and others that are kept) a sequence_id and an offset.

    ``items`` is read twice and must be stable (written or checkpointed).  A column nth, the place of a piece among those
    of its length in its shard, is worked out by a window over slot if it is missing.  With it, a piece is placed where it
    stands: only counts by (length, shard) are shuffled, at most ``capacity`` for each input partition, and joined back;
    pieces move only if these counts are too many to be sent out.
    """
    names = [c for c in items.columns if c not in ("shard", "slot", "nth", "sequence_id", "offset")]
    if "nth" not in items.columns:
        items = items.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "length").orderBy("slot")) - 1)
    counts = items.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    counts, starts = starts, starts.drop("n")
    if counts.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    placed: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length, rank, _, first, offset in plan(total, capacity):
        placed.setdefault(length, ([], [], []))
        for side, v in zip(placed[length], (rank, first, offset), strict=True):
            side.append(v)
    placed = {k: tuple(np.asarray(x, np.int64) for x in v) for k, v in placed.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, every = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                at = order[a:b]
                rank = every[at]
                ranks, firsts, offsets = placed[int(length[at[0]])]
                row = np.searchsorted(ranks, rank, "right") - 1
                seq[at], off[at] = firsts[row] + rank - ranks[row], offsets[row]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    ranked = items.join(starts, ["shard", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields if f.name in names)
    return ranked.select(*names, "rank").mapInArrow(place, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``pieces`` then ``pack``: every token of every document at one place of one sequence."""
    return pack(materialise(pieces(docs, encoder, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)


def bpe(json_path: str, ranks_path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """A factory for ``pieces`` that loads the vocabulary once in each worker."""
    return lambda: bpe_encoder(json_path, ranks_path, pattern)

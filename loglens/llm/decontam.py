"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that occurs in a text with at most k edits shares at least m + 1 - q (k + 1) of its q-grams
with it, all of them on diagonals (text place less item place) of which the outermost differ by at most k.  So every
q-gram of a text that some item has is counted in the two overlapping diagonal bands that hold its diagonal; bands are
twice as wide as their distance, and wider than any k.  Only bands that reach the item's bound are aligned, inside the
band, and an item counts as leaked if it is found whole within its edit budget.  A longer item is also searched in
windows of ``WINDOW`` characters from every place on, each as an item of its own, so that a copied part of ``WINDOW``
characters is found wherever it starts; ``share`` tells how much of the item the found part is.  An edit spoils q
q-grams in a row at most, so a window has at least as many edits as such runs are needed to cover its missing q-grams;
windows are aligned by this number, rising, until none can be better.

Characters are UTF-8 bytes of the text in lower case with white space runs as single blanks; k is ``rate`` times m.

Items travel to the executors in blocks of a fixed number of bytes.  A benchmark of one block is searched for in one pass;
for a larger one every block reads no more than row numbers and texts, and what is found is joined to the rows at the end.
Where q-grams are common to many items, texts and items are halved until the hits that are held at a time are few.

Defined results: null and empty texts hold no item; items without ``least`` characters must stand in the text without edits
and not inside a longer word; items with equal texts are each reported; null item ids are reported as null; repeated rows
are each searched; an empty table on either side gives no leaks; texts may be of any length; other columns are passed on
unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import chunks, fresh, materialise, mix64, named, shared_dir

Q = 8
RATE = 0.1
LEAST = 32
#: Characters of a window, and from one to the next.
WINDOW, STEP = 72, 1
#: Bytes of item text that are sent out at once; an index takes about 24 times as much memory.
BLOCK_BYTES = 1 << 23
#: Pairs of equal q-grams that are held at a time.
MOST_HITS = 1 << 21
#: Bytes of a pattern up to which a quick search goes before the alignment.
MOST_BITS = 512
#: Bytes that make up words: ASCII letters and digits, and all beyond ASCII.
IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LEAKS = "array<struct<item_id:bigint,edits:int,start:bigint,length:bigint,share:double>>"


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def align(item: bytes, text: bytes, first: int, last: int, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of the whole item in the text, within the diagonals first..last; None if over budget.

    The alignment may start anywhere; of equal ends the first counts.
    """
    p, t = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    diagonal = np.arange(first, last + 1)
    far = np.int32(1 << 20)
    cost = np.where((diagonal >= 0) & (diagonal <= len(t)), 0, far).astype(np.int32)
    steps = np.arange(len(diagonal), dtype=np.int32)
    padded = np.full(len(p) + len(diagonal) + abs(first) + len(t) + 2, 256, dtype=np.int16)
    shift = max(0, -first)
    padded[shift : shift + len(t)] = t
    for i, c in enumerate(p, 1):
        at = shift + first + i - 1
        here = cost + (padded[at : at + len(diagonal)] != c)
        here[:-1] = np.minimum(here[:-1], cost[1:] + 1)
        here[(diagonal + i < 0) | (diagonal + i > len(t))] = far
        cost = np.minimum.accumulate(here - steps) + steps
        cost[(diagonal + i < 0) | (diagonal + i > len(t))] = far
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return (int(cost[best]), int(diagonal[best]) + len(p)) if cost[best] <= budget else None


def stands(item: bytes, text: bytes, budget: int) -> bool:
    """Whether the whole item is anywhere in the text within the budget, on any diagonal (bits of a column at a time)."""
    bits: dict[int, int] = {}
    for k, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << k
    full, top, cost = (1 << len(item)) - 1, 1 << len(item) - 1, len(item)
    up, down = full, 0  # where a cost is one above, or one below, that of the place before
    for c in text:
        same = bits.get(c, 0)
        kept = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = down | (full ^ (kept | up)), kept & up
        if rise & top:
            cost += 1
        elif fall & top:
            cost -= 1
            if cost <= budget:
                return True
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | (full ^ (kept | rise)), rise & kept
    return cost <= budget


def locate(item: bytes, text: bytes, first: int, last: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, length) of the best place, its start from an alignment backwards from its end."""
    found = align(item, text, first, last, budget)
    if not found:
        return None
    edits, end = found
    back = align(item[::-1], text[:end][::-1], 0 - budget, budget, budget)
    start = end - (back[1] if back else len(item))
    return edits, max(0, start), end - max(0, start)


def grams_at(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes (8 at most) from each place on as a number, scrambled one to one."""
    n = len(data) - q + 1
    if not 0 < q <= 8:
        raise ValueError("q must be 1 to 8")
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(-(-max(n, 0) // 8) * 8, dtype=np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view("<u8")
    return mix64(out[: max(n, 0)] & np.uint64((1 << 8 * q) - 1))


@dataclass
class Index:
    """The q-grams of a block of items, ascending, with the item and place of each."""

    ids: list[int | None]
    texts: list[bytes]
    q: int = Q
    rate: float = RATE
    window: int = WINDOW
    step: int = STEP
    short_of: int = LEAST
    numbers: list[int] | None = None
    owner: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = np.array([len(x) for x in self.texts], dtype=np.int64)
        self.numbers = self.numbers or list(range(len(self.texts)))  # of the items in the whole block
        self._halves: list[Index] = []
        self.budget, self.bound = self.limits(size)
        (self.window_budget,), (self.window_bound,) = self.limits(np.array([self.window]))
        self.least = np.where(size > self.window, np.minimum(self.bound, self.window_bound), self.bound)
        self.stride = int(max(16, self.budget.max(initial=0) + 1))
        data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.concatenate([np.arange(a, b - self.q + 1) for a, b in zip(off, off[1:], strict=False) if b - a >= self.short_of] or [np.zeros(0)]).astype(np.int64)
        h = grams_at(data, self.q)[at]
        owner = np.searchsorted(off, at, "right") - 1
        order = np.argsort(h, kind="stable")
        h, self.owner, self.place = h[order], owner[order].astype(np.int32), (at - off[owner])[order].astype(np.int32)
        self.first = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, np.int64)
        self.distinct, self.times = h[self.first], np.diff(self.first, append=len(h)).astype(np.int32)
        self.first = self.first.astype(np.int32)
        bits = int(min(26, max(16, len(h).bit_length() + 4)))
        self.high = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.distinct >> self.high).astype(np.int64)] = True
        # Items too short for edits, by the number of their first bytes that are looked up, and by these bytes.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, x in enumerate(self.texts):
            if 0 < len(x) < self.short_of:
                head = int(grams_at(np.frombuffer(x[:8], np.uint8), min(len(x), 8))[0])
                self.short.setdefault(min(len(x), 8), {}).setdefault(head, []).append(i)

    def limits(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edit budgets of texts of such sizes, and how many of their q-grams must be left."""
        budget = np.minimum((size * self.rate).astype(np.int64), np.maximum(size // self.q - 1, 0))
        return budget, np.maximum(size + 1 - self.q * (budget + 1), 1)

    def _fewest(self, hit: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Edits that each window has at least (counted up to its budget and one more), from the places that were hit."""
        missing = np.ones(size + 2 * self.q, dtype=bool)
        missing[hit] = False
        place = np.arange(len(missing))
        following = np.minimum.accumulate(np.where(missing, place, len(missing))[::-1])[::-1]
        at, out = starts, np.zeros(len(starts), dtype=np.int64)
        for _ in range(int(self.window_budget) + 1):
            gap = following[np.minimum(at, size)]
            out += gap <= starts + self.window - self.q
            at = gap + self.q
        return out

    def _place(self, pattern: bytes, budget: int, text: bytes, diagonals: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, start, length) of the best place of the pattern around the diagonals of its q-grams."""
        values, often = np.unique(diagonals, return_counts=True)
        main = int(values[often.argmax()])
        if main >= 0 and text[main : main + len(pattern)] == pattern:
            return 0, main, len(pattern)
        low, high = int(values[0]) - budget, int(values[-1]) + budget
        cut = max(0, low)
        around = text[cut : high + len(pattern) + budget]
        if len(pattern) <= MOST_BITS and not stands(pattern, around, budget):
            return None  # most candidates end here, at a fifth of the cost of an alignment
        got = locate(pattern, around, low - cut, high - cut, budget)
        return got and (got[0], got[1] + cut, got[2])

    def _search_short(self, texts: list[bytes], data: np.ndarray, off: np.ndarray, found: list[dict]) -> None:
        """Adds the first place of each short item that stands in a text whole and not inside a longer word."""
        for n, heads in self.short.items():
            values = np.sort(np.array(list(heads), dtype=np.uint64))
            h = grams_at(data, n)
            at = np.flatnonzero(values[np.minimum(np.searchsorted(values, h), len(values) - 1)] == h)
            doc = np.searchsorted(off, at, "right") - 1
            for d, start, head in zip(doc.tolist(), (at - off[doc]).tolist(), h[at].tolist(), strict=True):
                text = texts[d]
                for i in heads[head]:
                    item, end = self.texts[i], start + len(self.texts[i])
                    if i in found[d] or not text.startswith(item, start):
                        continue
                    cut_before = item[0] < 128 and IS_WORD[item[0]] and start and IS_WORD[text[start - 1]]
                    cut_after = item[-1] < 128 and IS_WORD[item[-1]] and end < len(text) and IS_WORD[text[end]]
                    if not cut_before and not cut_after:
                        found[d][i] = (False, 0, start, len(item))

    def search(self, texts: list[bytes]) -> list[list[dict]]:
        """The leaked items of each normalised text, by item id."""
        found: list[dict[int, tuple[bool, int, int, int]]] = [{} for _ in texts]  # by item: in part, edits, start, length
        size = np.array([len(t) for t in texts], dtype=np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self._search_short(texts, data, off, found)
        if len(self.distinct):
            self._search_long([(t, d, 0) for d, t in enumerate(texts)], found)
        name = lambda i: (self.ids[i] is None, self.ids[i] or 0)
        leak = lambda i, part, edits, start, length: {"item_id": self.ids[i], "edits": edits, "start": start, "length": length, "share": self.window / len(self.texts[i]) if part else 1.0}
        return [[leak(i, *f[i]) for i in sorted(f, key=name)] for f in found]

    def halves(self) -> list[Index]:
        if not self._halves:
            cut = len(self.texts) // 2
            self._halves = [Index(self.ids[a:b], self.texts[a:b], self.q, self.rate, self.window, self.step, self.short_of, self.numbers[a:b]) for a, b in ((0, cut), (cut, len(self.texts)))]
        return self._halves

    def _search_long(self, spans: list[tuple[bytes, int, int]], found: list[dict]) -> None:
        """Adds the best place of each item that is found within its edits, or in part.

        ``spans`` are stretches of texts, the number of each one's text, and where it begins there.
        """
        data = np.frombuffer(b"".join(t for t, _, _ in spans), dtype=np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t, _, _ in spans])]).astype(np.int64)
        h = grams_at(data, self.q)
        at = np.flatnonzero(self.seen[(h >> self.high).view(np.int64)])
        if not len(at) or not len(self.distinct):
            return
        row = np.minimum(np.searchsorted(self.distinct, h[at]), len(self.distinct) - 1)
        known = self.distinct[row] == h[at]
        at, row = at[known], row[known]
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + self.q <= off[doc + 1]
        at, row = at[inside], row[inside]
        times = self.times[row]
        if times.sum(dtype=np.int64) > MOST_HITS:
            reach = max(map(len, self.texts)) + int(self.budget.max()) + self.stride
            if len(spans) > 1:
                self._search_long(spans[: len(spans) // 2], found)
                return self._search_long(spans[len(spans) // 2 :], found)
            text, d, begin = spans[0]
            if len(text) > 4 * reach:  # what begins before the middle ends within reach of it
                cut = len(text) // 2
                self._search_long([(text[: cut + reach], d, begin)], found)
                return self._search_long([(text[cut:], d, begin + cut)], found)
            if len(self.texts) > 1:
                for half in self.halves():
                    half._search_long(spans, found)
                return None
        each = np.repeat(self.first[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        where, item = np.repeat(at, times), self.owner[each].astype(np.int64)
        diagonal = where - self.place[each] + self.stride * 64  # items may start before the first text
        doc = np.searchsorted(off, where, "right") - 1
        band = diagonal // self.stride + doc * 2  # a band belongs to one text
        wide = int(band.max(initial=0)) + 2
        key = np.concatenate([(item * wide + band), (item * wide + band - 1)])
        docs, both = np.concatenate([doc, doc]), np.arange(len(key)) % max(1, len(item))
        order = np.argsort(key)
        key, docs, both = key[order], docs[order], both[order]
        start = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(docs, prepend=-1) != 0)) if len(key) else np.zeros(0, np.int64)
        count = np.diff(start, append=len(key))
        ok = count >= self.least[key[start] // wide]
        for a, n in zip(start[ok].tolist(), count[ok].tolist(), strict=True):
            hits = both[a : a + n]
            i, span = int(item[hits[0]]), int(docs[a])
            text, d, begin = spans[span]
            best = found[d].get(self.numbers[i], (True, 1 << 30, 0, 0))
            if best[:2] == (False, 0):
                continue
            pattern = self.texts[i]
            places = self.place[each[hits]].astype(np.int64)
            diagonals = where[hits] - places - off[span]
            distinct = np.unique(places)  # the same place may have been hit again
            if len(distinct) >= self.bound[i] and (got := self._place(pattern, int(self.budget[i]), text, diagonals)):
                best = min(best, (False, got[0], got[1] + begin, got[2]))
            if best[0] and best[1] and len(pattern) > self.window and len(distinct) >= self.window_bound:
                starts = np.array([*range(0, len(pattern) - self.window, self.step), len(pattern) - self.window])
                fewest = self._fewest(distinct, starts, len(pattern))
                order = np.argsort(fewest, kind="stable")
                for w, lower in zip(starts[order].tolist(), fewest[order].tolist(), strict=True):
                    if lower >= best[1] or lower > self.window_budget:
                        break
                    own = (places >= w) & (places <= w + self.window - self.q)
                    if got := self._place(pattern[w : w + self.window], int(self.window_budget), text, diagonals[own] + w):
                        best = min(best, (True, got[0], got[1] + begin, got[2]))
            if best[1] < 1 << 30:
                found[d][self.numbers[i]] = best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> tuple[int, DataFrame]:
    """The number of blocks of about ``limit`` bytes, and the items (i, t, block)."""
    own = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter(F.octet_length("t") > 0)
    total = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-total // limit)
    return n, own.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1))))


LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("share", pa.float64())]))


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, least: int = LEAST, into: str = "leaks", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``into``: the leaked items of each row, with edits, start and length in the normalised text, and share."""
    context = docs.sparkSession.sparkContext
    leaks_field = lambda name: docs.sparkSession.range(0).select(F.array().cast(LEAKS).alias(name)).schema.fields
    n, items = _blocks(benchmark, item_id, item_text, block_bytes)

    def searched(rows: DataFrame, block: int, column: str, all_rows: bool) -> tuple[DataFrame, object]:
        """``rows`` with what they hold of one block, all of them or only those that hold something."""
        pairs = [(r["i"], x) for r in items.filter(F.col("block") == block).sort("i", "t").collect() if (x := normalise(r["t"]))]  # one block at a time is on the driver
        shared = context.broadcast(([i for i, _ in pairs], [x for _, x in pairs]))
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for part in chunks(batches, text_col):
                index = index or Index(*shared.value, q=q, rate=rate, short_of=least)
                got = index.search([normalise(t) for t in part.column(text_col).to_pylist()])
                if not all_rows:
                    own = [k for k, x in enumerate(got) if x]
                    part, got = part.take(pa.array(own, pa.int64())), [got[k] for k in own]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, LEAK)], [*names, column])

        return rows.mapInArrow(run, StructType(rows.schema.fields + leaks_field(column))), shared

    if n <= 1:
        return searched(docs, 0, into, True)[0] if n else docs.withColumn(into, F.array().cast(LEAKS))
    row = fresh(docs, "_row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "leak-rows")  # numbers are written once
    path = shared_dir(docs.sparkSession, "leaks")
    for block in range(n):
        got, shared = searched(rows.select(row, text_col), block, into, False)
        got.drop(text_col).write.mode("append").parquet(path)
        shared.unpersist()
    by_id = F.array_sort(F.flatten(F.collect_list(into)), lambda a, b: F.when(F.coalesce(a["item_id"], F.lit(2**63 - 1)) < F.coalesce(b["item_id"], F.lit(2**63 - 1)), -1).otherwise(1))
    found = docs.sparkSession.read.parquet(path).groupBy(row).agg(by_id.alias(into))
    none = F.array().cast(LEAKS)
    return rows.join(found, row, "left").select(*(named(c) for c in docs.columns), F.coalesce(named(into), none).alias(into))

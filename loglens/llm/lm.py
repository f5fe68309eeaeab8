"""Language-model scoring by logistic context mixing.

A text is its words in lower case (A-Z), each followed by a blank, and one end byte; the model gives the probability of
that byte string bit by bit, so it can be held against a word model of the same tokens.  For every bit, bit predictors
with hashed contexts (the last one to five bytes and the bits of the byte so far) look up how often a zero and a one came
next; their stretched probabilities are mixed by a logistic unit whose weights are chosen by a gate, the confidence of the
three longest contexts; an adaptive table indexed by the byte so far and the mixed probability refines the result.

Counts come from all training texts: n-grams are counted in each task, added up by a shuffle, and turned into bit counts in
tables of 2**22 slots at most for each order (two bytes a slot), the only part that is broadcast.  Weights and refinement
are learned online from the same counted n-grams, each occurrence predicted from all the others (its own count is taken
away first).  As many learners as the n-grams call for, each with about ``GRAMS_EACH`` of them at every size, learn in
parallel from the same start; a shuffle adds up what they learned, in whole numbers, weighted by what each has seen.  What a
learner does depends on its n-grams alone, not on how they come in batches.  A model is fixed while it scores.

The base score is a unigram model over hashed words (64 bits).  Words with more than 1 / 2**19 of all tokens, fewer than
2**19, are looked up in a broadcast table; all others are joined by a shuffle.

Defined results: a null text is empty and consists of the end alone; with no training rows every bit has probability one
half; repeated rows are scored alike; null ids count as the empty text in the fold; texts may be of any length; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, chunks, materialise, mix64, named, prefix_hash, span_hash, text_bytes, token_spans

ORDERS = (1, 2, 3, 4, 5)
MOST_BITS, LEAST_BITS = 22, 14
END, BLANK, PAD = 10, 32, 5
END_KEY = 0
FREQUENT = 1 << 19
#: Distinct n-grams that a learner has, on average.
GRAMS_EACH = 100_000
#: Weights are added up in whole numbers of this share.
_UNIT = 1 << 16
CHUNK = 1 << 19
_STEP = 10  # quantised counts: ten steps for each doubling
_COUNT = np.exp2(np.arange(256) / _STEP) - 1
_PRIOR = 0.4
_LOG = np.log(_COUNT + _PRIOR).astype(np.float32)
_LESS = np.minimum(np.round(_STEP * np.log2(np.maximum(_COUNT - 1, 0) + 1)), 255).astype(np.uint8)
_GATES = 125
_CONF = np.digitize(_COUNT, [0.5, 1.7, 5.5, 29.5]).astype(np.int64)
INPUTS = len(ORDERS) + 1
BUCKETS = 33


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The byte strings of all texts, each after PAD end bytes, laid end to end.

    Returns the bytes, the place where each text's padding starts (and the total length), word hashes, and words per text.
    """
    low = LOWER[data]
    starts, ends, n = token_spans(low, offsets)
    words = span_hash(prefix_hash(low), starts, ends).view(np.int64)
    size = ends - starts
    text = np.repeat(np.arange(len(n)), n)
    length = np.bincount(text, weights=size + 1, minlength=len(n)).astype(np.int64) + PAD + 1
    begin = np.concatenate([[0], np.cumsum(length)])
    out = np.full(begin[-1], BLANK, dtype=np.uint8)
    for k in range(PAD):
        out[begin[:-1] + k] = END
    out[begin[1:] - 1] = END
    # A word's place: its text's start, the padding, and the words before it in its text, each with a blank.
    through = np.cumsum(size + 1)
    before_text = np.concatenate([[0], through])[np.cumsum(n) - n]
    place = begin[text] + PAD + through - (size + 1) - before_text[text]
    shift = np.repeat(place - starts, size)
    inside = np.arange(len(shift)) + np.repeat(starts - (np.cumsum(size) - size), size)
    out[inside + shift] = low[inside]
    return out, begin, words, n


def keys_of(stream: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte that counts, the five bytes before it and itself as a 48-bit number, and its text."""
    padded = np.concatenate([np.full(8, END, np.uint8), stream, np.zeros(16, np.uint8)])
    out = np.empty(-(-len(stream) // 8) * 8, dtype=np.uint64)
    for k in range(8):
        out[k::8] = padded[k + 1 : k + 1 + len(out)].view(">u8")
    length = np.diff(begin)
    text = np.repeat(np.arange(len(length)), length - PAD)
    at = np.arange(len(text)) + (text + 1) * PAD
    return out[at] & np.uint64((1 << 48) - 1), text


def _nodes(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bit of the last byte, high one first: the bits so far behind a leading one, and the bit."""
    byte = (keys & np.uint64(255)).astype(np.int64)
    for b in range(8):
        yield (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1


def table_bits(grams: int) -> list[int]:
    """Slots of each order as a power of two, for so many distinct n-grams."""
    top = int(np.ceil(np.log2(max(4 * grams, 2))))
    return [min(MOST_BITS, max(LEAST_BITS, 16 if o == 1 else top - (ORDERS[-1] - o))) for o in ORDERS]


class Slots:
    """Slot numbers of contexts, one range of numbers for each order."""

    def __init__(self, keys: np.ndarray, bits: list[int]) -> None:
        before = keys >> np.uint64(8)
        self.base = np.concatenate([[0], np.cumsum(np.left_shift(1, bits))]).astype(np.int64)
        self.shift = [np.uint64(64 - b) for b in bits]
        self.hashed = [mix64((before & np.uint64((1 << 8 * o) - 1)) ^ np.uint64(o << 56)) for o in ORDERS]

    def at(self, order: int, node: np.ndarray) -> np.ndarray:
        h = (self.hashed[order] ^ (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> self.shift[order]).astype(np.int64) + self.base[order]


@dataclass
class Model:
    bits: list[int]
    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    rate: float = 0.5

    def inputs(self, slots: Slots, node: np.ndarray, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (a row each) and gates; with ``bit``, one occurrence of it is taken away first."""
        x = np.empty((INPUTS, len(node)), dtype=np.float32)
        gate = np.zeros(len(node), dtype=np.int64)
        for k in range(len(ORDERS)):
            at = slots.at(k, node)
            zero, one = self.zeros[at], self.ones[at]
            if bit is not None:
                zero, one = np.where(bit == 0, _LESS[zero], zero), np.where(bit == 1, _LESS[one], one)
            x[k] = _LOG[one] - _LOG[zero]
            if k >= len(ORDERS) - 3:
                gate = gate * 5 + _CONF[np.maximum(zero, one)]
        x[-1] = 0.3
        return x, gate

    @staticmethod
    def _dot(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        t = weights[0][gate] * x[0]
        for k in range(1, INPUTS):
            t += weights[k][gate] * x[k]
        return np.clip(t, -11.5, 11.5)

    def _refined(self, t: np.ndarray, node: np.ndarray) -> np.ndarray:
        where = (t + 12) * ((BUCKETS - 1) / 24)
        low = where.astype(np.int64)
        part = where - low
        at = node * BUCKETS + low
        return self.refine[at] * (1 - part) + self.refine[at + 1] * part

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of the last byte of each n-gram after the bytes before it."""
        slots, total = Slots(keys, self.bits), np.zeros(len(keys))
        for node, bit in _nodes(keys):
            t = self._dot(self.weights, *self.inputs(slots, node))
            p = 0.5 / (1 + np.exp(-t)) + 0.5 * self._refined(t, node)
            total += np.log(np.where(bit == 1, p, 1 - p))
        return total

    def learn(self, keys: np.ndarray, n: np.ndarray, rng: np.random.Generator, weights: np.ndarray, hits: np.ndarray, epochs: int = 3, batch: int = 8192) -> None:
        """Online steps on counted n-grams; the last pass also fills ``hits``, the ones and all seen by the refinement table."""
        for epoch in range(epochs):
            order = rng.permutation(len(keys))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                slots, count = Slots(keys[own], self.bits), n[own].astype(np.float64)
                for node, bit in _nodes(keys[own]):
                    x, gate = self.inputs(slots, node, bit)
                    t = self._dot(weights, x, gate)
                    error = (bit - 1 / (1 + np.exp(-t))) * count
                    size = np.bincount(gate, weights=count, minlength=_GATES)
                    speed = self.rate / (1 + epoch) * size / (size + 20) / np.maximum(size, 1)
                    for k in range(INPUTS):
                        weights[k] += 0.2 * (speed * np.bincount(gate, weights=error * x[k], minlength=_GATES)).astype(np.float32)
                    if epoch == epochs - 1:
                        where = (t + 12) * ((BUCKETS - 1) / 24)
                        at = node * BUCKETS + np.round(where).astype(np.int64)
                        hits[0] += np.bincount(at, weights=count * bit, minlength=hits.shape[1])
                        hits[1] += np.bincount(at, weights=count, minlength=hits.shape[1])


def _merge(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams and distinct words of some texts, with their counts; the arrays in between are freed on return."""
    stream, begin, words, _ = streams(*text_bytes(column))
    out = []
    for own in (keys_of(stream, begin)[0].view(np.int64), words):
        own = np.sort(own)
        first = np.flatnonzero(np.diff(own, prepend=~own[:1])) if len(own) else np.zeros(0, np.int64)
        out.append((own[first], np.diff(first, append=len(own))))
    return out


def count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, n): n-grams (kind 0) and hashed words (kind 1) of all texts, with the end of each text as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
        texts = 0

        def give(kind: int, least: int) -> Iterator[pa.RecordBatch]:
            if not kept[kind] or sum(len(k) for k, _ in kept[kind]) < least:
                return
            keys, n = _merge(kept[kind])
            kept[kind] = [(keys, n)]
            if len(keys) * 2 >= least:
                kept[kind] = []
                for a in range(0, len(keys), 1 << 18):
                    k = keys[a : a + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[a : a + (1 << 18)])], ["kind", "key", "n"])

        for part in chunks(batches, "text", CHUNK):
            texts += part.num_rows
            for kind, own in enumerate(_counted(part.column("text"))):
                kept[kind].append(own)
                yield from give(kind, 1_000_000)
        if texts:
            kept[1].append((np.array([END_KEY]), np.array([texts])))
        for kind in kept:
            yield from give(kind, 0)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _tables(grams: DataFrame, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Quantised counts of zeros and ones for every slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            slots = Slots(keys, bits)
            for k in range(len(ORDERS)):
                at, two = [], []
                for node, bit in _nodes(keys):
                    at.append(slots.at(k, node) * 2 + bit)
                    two.append(n)
                slot, total = _merge([(np.concatenate(at), np.concatenate(two))]) if len(keys) else (np.zeros(0, np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total)], ["slot", "n"])

    near = grams.repartition(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))).sortWithinPartitions(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF)))
    counts = near.select("key", "n").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    small = F.least(F.lit(255), F.round(F.lit(_STEP) * F.log2(F.col("n") + 1))).cast("int")
    blocks = counts.groupBy(F.shiftright("slot", 16).alias("block")).agg(F.collect_list((F.col("slot").bitwiseAND(F.lit(0xFFFF)) * 256 + small).cast("int")).alias("cells"))
    flat = np.zeros(2 * int(np.sum(np.left_shift(1, bits))), dtype=np.uint8)
    for batch in blocks.toArrow().to_batches():  # at most 2 cells for each slot of tables of fixed size
        cells, off = batch.column("cells").values.to_numpy(), batch.column("cells").offsets.to_numpy()
        at = np.repeat(batch.column("block").to_numpy().astype(np.int64), np.diff(off)) << 16
        own = cells[off[0] : off[-1]]
        flat[at + (own >> 8)] = own & 255
    return flat[0::2].copy(), flat[1::2].copy()


def fit(grams: DataFrame) -> Model:
    """A model from counted n-grams (key, n), which are read several times and must be stable."""
    spark = grams.sparkSession
    n = grams.count()
    bits = table_bits(n)
    zeros, ones = _tables(grams, bits)
    start = np.full((INPUTS, _GATES), 0.25, dtype=np.float32)
    squash = 1 / (1 + np.exp(-(np.arange(BUCKETS) / (BUCKETS - 1) * 24 - 12)))
    model = Model(bits, zeros, ones, start, np.tile(squash, 256).astype(np.float32))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column("key").to_numpy().view(np.uint64), b.column("n").to_numpy()) for b in batches if b.num_rows]  # about GRAMS_EACH rows
        if not own:
            return
        keys, n = np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own])
        weights, hits, seen = start.copy(), np.zeros((2, 256 * BUCKETS)), int(n.sum())
        shared.value.learn(keys, n, np.random.default_rng(5), weights, hits)
        cells = np.concatenate([[seen], np.round(weights.ravel() * _UNIT).astype(np.int64) * seen, hits.ravel().astype(np.int64)])
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "value"])

    mixed = grams.repartition(n // GRAMS_EACH + 1, F.xxhash64("key")).sortWithinPartitions(F.xxhash64("key", F.lit(1)))
    added = mixed.select("key", "n").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    cells = np.zeros(1 + start.size + 2 * 256 * BUCKETS)
    for cell, value in added.collect():  # a row for each weight and each cell of the refinement table, whatever the number of learners
        cells[cell] = float(value)
    total, weights, hits = cells[0], cells[1 : 1 + start.size].reshape(start.shape) / _UNIT, cells[1 + start.size :].reshape(2, -1)
    if not total:
        return model
    prior = 8.0
    refine = (hits[0] + prior * np.tile(squash, 256)) / (hits[1] + prior)
    return Model(bits, zeros, ones, (weights / total).astype(np.float32), refine.clip(1e-5, 1 - 1e-5).astype(np.float32))


class Scorer:
    """Scores n-grams, and keeps the results of those met before up to a fixed number."""

    def __init__(self, model: Model, most: int = 1_000_000) -> None:
        self.model, self.most = model, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """``keys`` ascending and distinct."""
        out = np.empty(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        out[known] = self.values[at[known]]
        new = keys[~known]
        for a in range(0, len(new), 1 << 15):
            out[np.flatnonzero(~known)[a : a + (1 << 15)]] = self.model.log_probability(new[a : a + (1 << 15)])
        if len(new) and len(self.keys) < self.most:
            self.keys, self.values = np.concatenate([self.keys, new]), np.concatenate([self.values, out[~known]])
            order = np.argsort(self.keys)
            self.keys, self.values = self.keys[order], self.values[order]
        return out


def score(docs: DataFrame, training: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    The model and the word counts come from all rows of ``training``.
    """
    spark = docs.sparkSession
    counted = materialise(count(training, text_col), "counts")
    grams, words = counted.filter("kind = 0").select("key", "n"), counted.filter("kind = 1").select("key", "n")
    model = fit(grams)
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = total // FREQUENT
    common = words.filter(F.col("n") > least).toArrow() if total else None  # fewer than FREQUENT rows
    keys = common["key"].to_numpy() if common else np.zeros(0, np.int64)
    order = np.argsort(keys)
    scale = np.log10(total + 0.5 * (kinds + 1))
    keys, logs = keys[order], (np.log10(common["n"].to_numpy()[order] + 0.5) if common else np.zeros(0)) - scale
    shared = spark.sparkContext.broadcast((model, keys, logs))

    def scored_part(part: pa.RecordBatch, scorer: Scorer, uid: int) -> pa.RecordBatch:
        """One batch of results; the arrays in between are freed on return."""
        _, common, logs = shared.value
        rows = part.num_rows
        stream, begin, words, n = streams(*text_bytes(part.column("_text")))
        key, text = keys_of(stream, begin)
        both = np.sort(key << np.uint64(16) | text.astype(np.uint64))
        gram = both >> np.uint64(16)
        first = np.flatnonzero(np.diff(gram, prepend=~gram[:1]))
        each = np.repeat(scorer(gram[first]), np.diff(first, append=len(gram)))
        logp = np.bincount((both & np.uint64(0xFFFF)).astype(np.int64), weights=each, minlength=rows)

        word = np.concatenate([words, np.full(rows, END_KEY)])
        owner = np.concatenate([np.repeat(np.arange(rows), n), np.arange(rows)])
        by = np.argsort(word)
        word, owner = word[by], owner[by]
        first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
        at = np.minimum(np.searchsorted(common, word[first]), max(len(common) - 1, 0))
        is_common = common[at] == word[first] if len(common) else np.zeros(len(first), dtype=bool)
        value = np.where(is_common, logs[at] if len(common) else 0, 0)
        times = np.diff(first, append=len(word))
        own = np.repeat(is_common, times)
        base = np.bincount(owner, weights=np.repeat(value, times), minlength=rows)
        known = np.bincount(owner[own], minlength=rows)
        rare, whose = word[~own], owner[~own]
        rare = rare[np.argsort(whose, kind="stable")]
        off = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=rows))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in keep), pa.array(np.arange(uid, uid + rows)), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(logp), pa.array(np.diff(begin) - PAD), pa.ListArray.from_arrays(pa.array(off), pa.array(rare))],
            [*keep, "_uid", "n_tokens", "_known", "_base", "_logp", "_bytes", "_rare"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        scorer = None
        for part in chunks(batches, "_text", CHUNK):
            scorer = scorer or Scorer(shared.value[0])
            yield scored_part(part, scorer, uid)
            uid += part.num_rows

    own = docs.select(*(named(c) for c in keep), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])
    scored = materialise(own.mapInArrow(run, f"{schema}, _uid long, n_tokens long, _known long, _base double, _logp double, _bytes long, _rare array<long>"), "scored")
    n = F.coalesce("n", F.lit(0))
    rare = scored.select("_uid", F.explode("_rare").alias("key")).join(words.filter(F.col("n") <= least), "key", "left")
    rest = rare.groupBy("_uid").agg(F.sum(F.log10(n + 0.5) - F.lit(float(scale))).alias("_rest"), F.sum((n > 0).cast("long")).alias("_more"))
    joined = scored.drop("_rare").join(rest, "_uid", "left")
    ln10 = float(np.log(10))
    return joined.select(
        *(named(c) for c in keep),
        "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_rest", F.lit(0.0))).alias("base_score"),
        (F.col("_logp") / ln10).alias("score"),
        (-F.col("_logp") / float(np.log(2)) / F.col("_bytes")).alias("bits_per_byte"),
    )

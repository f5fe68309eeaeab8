"""N-gram Jaccard join by MinHash banding.

Words are runs of bytes other than ASCII white space, with A-Z in lower case; a text's n-grams are the distinct
runs of ``n`` words (all its words if it has fewer).  Texts of equal n-gram sets form one *text class* and are
joined through one representative, so copies cost one row each.  Band and row counts are chosen for the target
recall at the threshold; classes that share a band hash are candidates, and every pair of them is verified once,
in the first band that the two share, on the full n-gram sets.

Stages: (1) features; (2) bands that more than one class has; (3) inside each of them, pairs that share an earlier
band or whose sketches rule out the threshold are left out, with no more than hashes at hand; (4) n-gram sets travel
only to groups where they have a pair left, and are compared; (5) connected components of the links.

So work follows the pairs that share bands, not the size of components: a chain of texts costs as much a text as a
pair does.  A band that many classes have is cut into blocks by hash; a pair of blocks is compared as matrices, what
leaves stage 3 is a row with a bit for each other row of a pair of smaller blocks, and what leaves stage 4 a number of
links per class and a spanning forest of them.  No list of all pairs of a group is ever built.

Besides the recall of the bands, a pair is lost if the low 32 bits of an earlier band agree by chance (one in 10**8), and
n-grams are compared by 48 bits of their hashes.

Defined results: texts without any word (null, empty, white space) have equal, empty sets and form one class;
a null id is kept as null and never becomes a class id unless all ids of the class are null; repeated rows and
ids count as separate documents; an empty table gives no rows; other columns are ignored; texts may be of any
length.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, chunks, join_counted, materialise, mix64, prefix_hash, span_hash, text_bytes, token_spans
from .graph import connected_components

THRESHOLD = 0.8
WORDS = 5
#: Bytes of one-byte minima in a sketch; its standard error at the threshold is 0.035.
SKETCH = 128
#: Sketches this far (in standard errors) below the threshold rule a pair out.
SLACK = 6.0
#: Classes in a block of stage 3, on average, and at most in one of stage 4.
BLOCK, PART = 1024, 128
RECALL = 0.99999
#: Ids that may be broadcast (8 MB); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective pair that reaches the recall at the threshold with at most so many hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts end to end, and the number of each text's (repeats included)."""
    low = LOWER[data]
    starts, ends, words = token_spans(low, offsets)
    token = span_hash(prefix_hash(low), starts, ends)
    first = np.cumsum(words) - words
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.repeat(np.minimum(words, n), count)
    gram = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        own = size > k
        if own.all():
            gram = mix64(gram * np.uint64(0x9E3779B97F4A7C15) + token[at + k])
        else:
            gram[own] = mix64(gram[own] * np.uint64(0x9E3779B97F4A7C15) + token[at[own] + k])
    return gram, count


def _sets(part: pa.RecordBatch, column: str, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    gram, count = shingles(*text_bytes(part.column(column)), n)
    end = np.cumsum(count)
    for a, b in zip((end - count).tolist(), end.tolist(), strict=True):
        own = np.sort(gram[a:b])
        yield own[np.flatnonzero(np.diff(own, prepend=~own[:1]))] if b > a else own


def features(docs: DataFrame, bands: int, rows: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, node (128-bit digest of the n-gram set), size of the set, band hashes, sketch."""
    hashes = bands * rows
    rng = np.random.default_rng(99)
    mult = rng.integers(0, 2**32, hashes + SKETCH, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, hashes + SKETCH, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            node, size = [], []
            least = np.full((part.num_rows, len(mult)), 0xFFFFFFFF, dtype=np.uint32)
            for i, own in enumerate(_sets(part, "text", n)):
                node.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                size.append(len(own))
                low = (own >> np.uint64(32)).astype(np.uint32)
                for k in range(0, len(low), 512):
                    np.minimum(least[i], (mult[:, None] * low[None, k : k + 512] + add[:, None]).min(axis=1), out=least[i])
            sketch = ((least[:, hashes:] * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
            key = np.tile(np.arange(bands, dtype=np.uint64), (part.num_rows, 1))
            for k in range(rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k * bands : (k + 1) * bands])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(node) + 1, bands, dtype=np.int32)), pa.array(key.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node, pa.binary()), pa.array(size, pa.int32()), flat, pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "node", "size", "bands", "sketch"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, node binary, size int, bands array<long>, sketch binary")


def shared_bands(classes: DataFrame, bands: int) -> DataFrame:
    """(band, node, blocks) of the bands that several classes have, and the number of blocks that a band is cut into.

    Bands are counted before anything else moves; the rows of a band that very many classes have are dealt to several tasks.
    """
    band = classes.select("node", F.explode("bands").alias("band"))
    counts = materialise(band.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "bands")
    return join_counted(band, counts, "band", "m", ["node"], bands * classes.count()).select("band", "node", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))


def _blocked(shared: DataFrame) -> DataFrame:
    """Copies of the rows of each band for every pair of its blocks: columns (bi, bj, own), own the row's block.

    Blocks are chosen by hash, so nothing has to be numbered; a row is copied as often as its band has blocks.
    """
    own = shared.withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    other = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("bi", F.least("own", "_o")).withColumn("bj", F.greatest("own", "_o")).drop("blocks", "_o")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rebatch sorted rows so that no group (equal ``keys``) spans two batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            col = batch.column(k)
            if batch.num_rows > 1:
                new[1:] |= pc.not_equal(col.slice(1), col.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            if held and col[0] != held[-1].column(k)[-1]:
                new[0] = True
        at = np.flatnonzero(new)
        if not len(at):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, at[-1])]
        held = [batch.slice(at[-1])]
        whole = pa.Table.from_batches([b for b in done if b.num_rows], schema=batch.schema).combine_chunks().to_batches()
        yield from whole
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _edges(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        col = batch.column(k)
        if batch.num_rows > 1:
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], batch.num_rows], strict=True))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A root for each of n nodes, equal within the components of the links (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        live = low < high
        if not live.any():
            break
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while (root != root[root]).any():
            root = root[root]
    return root


class _Group:
    """Arrays of the rows of one batch in stage 3."""

    def __init__(self, batch: pa.RecordBatch, floor: float, threshold: float) -> None:
        n = batch.num_rows
        self.size, self.own = batch.column("size").to_numpy(), batch.column("own").to_numpy()
        self.sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(n, SKETCH)
        self.bands = batch.column("low").flatten().to_numpy().reshape(n, -1)
        self.number = (self.bands == batch.column("band").to_numpy().astype(np.int32)[:, None]).argmax(axis=1)  # which of its bands a group shares
        self.floor, self.threshold = floor, threshold

    def alike(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the pairs the sizes and sketches don't rule out."""
        a, b = self.size[low], self.size[high]
        out = np.minimum(a, b) >= self.threshold * np.maximum(a, b)
        at = np.flatnonzero(out)
        for k in range(0, len(at), 65536):
            own = at[k : k + 65536]
            out[own] = (self.sketch[low[own]] == self.sketch[high[own]]).mean(axis=1) >= self.floor
        return out

    def first_here(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the pairs share no earlier band than that of their group."""
        out = np.ones(len(low), dtype=bool)
        for k in range(0, len(low), 65536):
            a, b = low[k : k + 65536], high[k : k + 65536]
            out[k : k + 65536] = (self.bands[a] == self.bands[b]).argmax(axis=1) == self.number[a]
        return out

    def pairs_of(self, a: int, b: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a large group, those that share an earlier band left out by whole matrices."""
        own = self.own[a:b]
        open_ = np.triu(np.ones((b - a, b - a), dtype=bool), 1) if same else np.triu(own[:, None] != own[None, :], 1)
        for k in range(int(self.number[a])):
            if not open_.any():
                break
            column = self.bands[a:b, k]
            open_ &= column[:, None] != column[None, :]
        i, j = np.nonzero(open_)
        return i + a, j + a


def _pairs(own: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs to compare: within one block all, between two blocks those across."""
    if same:
        return np.triu_indices(len(own), 1)
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    return np.repeat(left, len(right)), np.tile(right, len(left))


KEYS = ["band", "bi", "bj"]
PARTS = [*KEYS, "part"]
#: Groups of more rows are handled as matrices, smaller ones together as lists of pairs.
SMALL = 24


def parts_of(link: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """A symmetric matrix of links as pairs of blocks of at most PART places.

    Gives the number of each pair of blocks that has links, its places that have one, where they are among the places of the
    pair, and their rows as bits.
    """
    n = len(link)
    for number, (s, t) in enumerate(itertools.combinations_with_replacement(range(0, n, PART), 2)):
        place = np.arange(s, min(s + PART, n)) if s == t else np.concatenate([np.arange(s, s + PART), np.arange(t, min(t + PART, n))])
        own = link[np.ix_(place, place)]
        if s != t:
            own = own & ((place < t)[:, None] != (place < t)[None, :])
        at = np.flatnonzero(own.any(axis=1))
        if len(at):
            yield number, place[at], at, np.packbits(own[at], axis=1)


def candidates(classes: DataFrame, bands: int, threshold: float = THRESHOLD) -> DataFrame:
    """(band, bi, bj, part, pos, node, mask): the classes of each pair of blocks that have pairs left, in pairs of smaller blocks
    (``part``), their place there, and a bit for every place that they make a pair with.

    ``classes`` has one row per class.
    """
    # A one-byte minimum agrees by chance once in 256; at the threshold agreement has mean t and error sqrt(t(1-t)/SKETCH).
    floor = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SKETCH)
    low = F.transform("bands", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")).alias("low")
    rows = _blocked(shared_bands(classes, bands).join(classes.select("node", "size", low, "sketch"), "node"))

    def laid(batch: pa.RecordBatch, edges: list[tuple[int, int]], low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows of pairs that are left, of the groups of a batch."""
        if not len(low):
            return
        group = np.searchsorted(np.array([a for a, _ in edges]), low, "right") - 1
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        at, part, pos, mask = [], [], [], []
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
            a, b = edges[int(group[x])]
            link = np.zeros((b - a, b - a), dtype=bool)
            link[low[x:y] - a, high[x:y] - a] = True
            for number, place, where, bits in parts_of(link | link.T):
                at.append(place + a)
                part.append(np.full(len(place), number, np.int32))
                pos.append(where.astype(np.int32))
                mask.extend(r.tobytes() for r in bits)
        taken = batch.select([*KEYS, "node"]).take(pa.array(np.concatenate(at)))
        yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in KEYS), pa.array(np.concatenate(part)), pa.array(np.concatenate(pos)), taken.column("node"), pa.array(mask, pa.binary())], [*PARTS, "pos", "node", "mask"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, KEYS):
            g = _Group(batch, floor, threshold)
            same = batch.column("bi").to_numpy() == batch.column("bj").to_numpy()
            edges = _edges(batch, KEYS)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            count = 0
            # The pairs of one large group, or of some small ones, are held at a time.
            for a, b in [*edges, (0, 0)]:
                if b - a > SMALL:
                    low, high = g.pairs_of(a, b, bool(same[a]))
                    own = g.alike(low, high)
                    yield from laid(batch, edges, low[own], high[own])
                elif b - a > 1:
                    i, j = _pairs(g.own[a:b], bool(same[a]))
                    held.append((i + a, j + a))
                    count += len(i)
                if held and (count > 1 << 17 or b == 0):
                    low, high = (np.concatenate(x) for x in zip(*held, strict=True))
                    own = g.first_here(low, high)
                    low, high = low[own], high[own]
                    own = g.alike(low, high)
                    yield from laid(batch, edges, low[own], high[own])
                    held, count = [], 0

    ordered = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "own")
    return ordered.select("node", "size", "low", "sketch", "own", *KEYS).mapInArrow(find, "band long, bi int, bj int, part int, pos int, node binary, mask binary")


def common_grams(sets: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many n-grams the sets of each pair share.

    Few pairs are merged one by one; the intersections of many come from products of incidence matrices over n-grams that
    at least two of the sets have.
    """
    if len(low) * 8 < len(sets) ** 2 or len(sets) <= 4:
        out = np.empty(len(low), dtype=np.int64)
        for k, (i, j) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            both = np.concatenate([sets[i], sets[j]])
            both.sort(kind="stable")
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        return out
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    gram = np.cumsum(np.diff(flat, prepend=flat[:1]) != 0)
    times = np.bincount(gram)
    shared = times[gram] > 1
    column = (np.cumsum(times > 1) - 1)[gram[shared]]
    row = row[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 8192
    at = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        if b > a:
            incidence = np.zeros((len(sets), min(width, int(column[b - 1]) - k * width + 1)), dtype=np.float32)
            incidence[row[a:b], column[a:b] - k * width] = 1
            common += incidence @ incidence.T
    return common[low, high].round().astype(np.int64)


def verify(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links decided on full sets: rows (node, other, texts, docs).

    ``members`` are ``candidates`` with the copies and the n-gram set of each class.  A row says that the node has so
    many linked classes and documents among its pairs in one pair of blocks, and that ``other`` is in the same component
    (the node itself if none is).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, PARTS):
            grams, node, mask = batch.column("grams"), batch.column("node"), batch.column("mask")
            copies, pos = batch.column("copies").to_numpy(), batch.column("pos").to_numpy()
            texts, docs, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.arange(len(node))
            for a, b in _edges(batch, PARTS):
                sets = [unpacked(g.as_buffer()) for g in grams.slice(a, b - a)]
                link = np.unpackbits(np.frombuffer(b"".join(mask.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1), axis=1)[:, pos[a:b]]
                low, high = np.nonzero(np.triu(link, 1))
                size = np.array([len(s) for s in sets])
                common = common_grams(sets, low, high)
                ok = common >= threshold * (size[low] + size[high] - common) - 1e-6
                low, high = low[ok], high[ok]
                n, weight = b - a, copies[a:b]
                texts[a:b] = np.bincount(low, minlength=n) + np.bincount(high, minlength=n)
                docs[a:b] = np.bincount(low, weights=weight[high], minlength=n) + np.bincount(high, weights=weight[low], minlength=n)
                root[a:b] = forest(n, low, high) + a
            at = np.flatnonzero(texts)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(root[at])), pa.array(texts[at]), pa.array(docs[at])], ["node", "other", "texts", "docs"])

    ordered = members.repartition(*PARTS).sortWithinPartitions(*PARTS, "pos")
    return ordered.select("node", "copies", "grams", "pos", "mask", *PARTS).mapInArrow(run, "node binary, other binary, texts long, docs long")


def packed(grams: np.ndarray) -> bytes:
    """The upper 48 bits of ascending hashes, six bytes each."""
    high = grams >> np.uint64(16)
    high = high[np.flatnonzero(np.diff(high, prepend=~high[:1]))] if len(high) else high
    return high.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, grams) of each row's text: the digest, and the distinct hashes of its n-grams as ``packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = list(_sets(part, "text", n))
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array([packed(s) for s in sets], pa.binary())], ["node", "grams"])

    return docs.select("text").mapInArrow(run, "node binary, grams binary")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_linked_texts, n_copies.

    class_id is the least doc_id among the documents connected by links of Jaccard similarity >= ``threshold``
    (its own id if it has none); n_links counts the other documents that the row is linked to, copies included;
    n_linked_texts counts linked classes of other n-gram sets; n_copies the documents of the same set.
    """
    bands, rows = banding(threshold, recall)
    feats = materialise(features(docs, bands, rows, n, id_col, text_col), "features")
    # One row stands for each class from here on; copies are combined before the shuffle.
    first = [F.first(c).alias(c) for c in ("size", "bands", "sketch")]
    classes = materialise(feats.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *first), "classes")
    left = materialise(candidates(classes.filter("size > 0"), bands, threshold), "candidates")
    times = left.groupBy("node").agg(F.count("*").alias("m"))
    chosen = materialise(times.join(classes.select("node", "least", "copies"), "node"), "chosen")
    # The texts of one document of each class that has candidates.
    ids = chosen.select("least").distinct()
    if chosen.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).cast("string").alias("text"))
    texts = own.join(ids, own["least"].eqNullSafe(ids["least"]), "left_semi")
    sets = gram_sets(texts, n).dropDuplicates(["node"])  # ids may be repeated
    sets = sets.join(chosen.select("node", "copies", "m"), "node")
    # A class with very many pairs is in very many groups.
    members = join_counted(left, sets, "node", "m", PARTS, left.count(), chosen)
    links = materialise(verify(members, threshold), "links")
    component = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    linked = component.join(classes.select("node", "least"), "node")
    class_ids = linked.groupBy("component").agg(F.min("least").alias("class_least"), F.count("*").alias("m"))
    of = materialise(class_ids, "components")
    members = join_counted(component, of, "component", "m", ["node"], component.count())
    per_node = classes.select("node", "least", "copies").join(members.select("node", "class_least").join(counts, "node"), "node", "left")
    per_node = materialise(per_node.select("node", "copies", F.coalesce("class_least", "least").alias("class_id"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs")), "classes-linked")
    out = join_counted(feats.select("doc_id", "node"), per_node, "node", "copies", ["doc_id"], feats.count())
    return out.select("doc_id", "class_id", (F.col("docs") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_linked_texts"), F.col("copies").alias("n_copies"))

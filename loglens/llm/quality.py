"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a fixed random *index vector* given by its hash; the *word vector* is the sum of the index vectors
of the words around it in the training texts (random indexing).  Words are hashed into a fixed number of rows, once
as they stand and once as their shape (runs of lower-case letters, capitals, digits and each other byte), so that a
word never seen still has the vector of its shape.  A document is the mean of its word vectors and of its shape
vectors with a few length and variety figures; a network with one hidden layer gives a logit, which a temperature
fitted on rows kept out of the gradient turns into a probability.

The classifier is fitted on at most ``fit_rows`` labelled rows (those of least hash); scoring covers every row.

Defined results: null and empty texts have all-zero vectors and get a score like any other; with no labelled rows
every score is 0.5; texts may be of any length; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ._common import chunks, materialise, mix64, named, prefix_hash, span_hash, text_bytes, token_spans

ROWS = 1 << 15
DIMS = 24
WINDOW = 2
FIT_ROWS = 12_000
THRESHOLD = 0.3
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
EXTRAS = 6


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vector rows of all words and of their shapes; per text its words, distinct words, and words equal to the one before."""
    starts, ends, n = token_spans(data, offsets)
    own = span_hash(prefix_hash(data), starts, ends)
    kind = _CLASS[data]
    change = np.ones(len(kind), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    at = np.concatenate([[0], np.cumsum(change)])
    shape = span_hash(prefix_hash(kind[change]), at[starts], at[ends])
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = np.sort((row << np.uint64(44)) | (own >> np.uint64(20)))
    distinct = np.bincount((key[np.flatnonzero(np.diff(key, prepend=~key[:1]))] >> np.uint64(44)).astype(np.int64), minlength=len(n)) if len(key) else np.zeros(len(n), np.int64)
    again = np.bincount(row[1:][(own[1:] == own[:-1]) & (row[1:] == row[:-1])].astype(np.int64), minlength=len(n))
    mask = np.uint64(ROWS - 1)
    return (own & mask).astype(np.int64), ((shape & mask) + np.uint64(ROWS)).astype(np.int64), n, distinct, again


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors of all hashed words and shapes, from their row number alone."""
    h = mix64(np.arange(2 * ROWS * DIMS, dtype=np.uint64)).reshape(2 * ROWS, DIMS) % np.uint64(12)
    return (h == 0).astype(np.int64) - (h == 1).astype(np.int64)


def context_sums(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, table: np.ndarray) -> None:
    """Add to each word's (and shape's) row the index vectors of the words and shapes within the window."""
    word, shape, n, _, _ = words(data, offsets)
    text = np.repeat(np.arange(len(n)), n)
    for step in range(1, WINDOW + 1):
        near = text[step:] == text[:-step]
        for own in (word, shape):
            a, b = own[:-step][near], own[step:][near]
            np.add.at(table, a, index[shape[step:][near]] + index[word[step:][near]])
            np.add.at(table, b, index[shape[:-step][near]] + index[word[:-step][near]])


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    word, shape, n, distinct, again = words(data, offsets)
    out = np.zeros((len(n), 2 * DIMS + EXTRAS), dtype=np.float32)
    end = np.cumsum(n)
    for i, (a, b) in enumerate(zip((end - n).tolist(), end.tolist(), strict=True)):
        if b > a:
            out[i, :DIMS] = vectors[word[a:b]].mean(axis=0, dtype=np.float64)
            out[i, DIMS : 2 * DIMS] = vectors[shape[a:b]].mean(axis=0, dtype=np.float64)
    size, some = np.diff(offsets), np.maximum(n, 1)
    out[:, -6] = again / some
    out[:, -5] = np.log1p(n)
    out[:, -4] = distinct / some
    out[:, -3] = np.log1p(size / some)
    out[:, -2] = np.sqrt(distinct) / np.log1p(some)
    out[:, -1] = n == 0
    return out


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 80, seed: int = 7) -> Model:
    """Fit the network by Adam on nine tenths of the rows and its temperature on the rest."""
    if not len(x):
        d = 2 * DIMS + EXTRAS
        return Model(vectors, np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(x)) % 10 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z, t = ((x - center) / scale)[~held], y[~held].astype(np.float64)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(order), 128):
            b = order[a : a + 128]
            h = np.tanh(z[b] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[b]) / len(b)
            back = np.outer(d, p[2]) * (1 - h * h)
            grad = [z[b].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grad):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, center, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if not held.any():
        return model
    logit, t = model.logits(x[held]), y[held]
    loss = lambda temp: np.logaddexp(0, np.where(t == 1, -logit, logit) / temp).mean()
    best = min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss)
    return Model(vectors, center, scale, p[0], p[1], p[2], float(p[3][0]), float(best))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the documents of at most ``fit_rows`` labels (id, label of 0 or 1), those of least id hash.

    Labels are chosen before any text is read, so only a bounded list of ids is sent to the documents.
    """
    spark = docs.sparkSession
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).alias("h")).filter("label in (0, 1) and _id is not null")
    chosen = F.broadcast(chosen.orderBy("h", "label").limit(fit_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "_id").select("text", "label", "h")
    sample = materialise(rows, "quality-fit").repartition(4, "h").sortWithinPartitions("h", "label", "text")

    sum_names = [f"c{k}" for k in range(DIMS)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, part_sum = index_vectors(), np.zeros((2 * ROWS, DIMS), dtype=np.int64)
        for part in chunks(batches, "text"):
            context_sums(*text_bytes(part.column("text")), index, part_sum)
        own = np.flatnonzero(part_sum.any(axis=1))
        for a in range(0, len(own), 8192):
            some = own[a : a + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(part_sum[some, k]) for k in range(DIMS))], ["row", *sum_names])

    # Whole numbers, so the order of adding doesn't matter; the result has 2 * ROWS rows at most.
    added = sample.select("text").mapInArrow(sums, "row long, " + ", ".join(f"{c} long" for c in sum_names)).groupBy("row").agg(*[F.sum(c).alias(c) for c in sum_names]).toArrow()
    total = np.zeros((2 * ROWS, DIMS), dtype=np.int64)
    total[added["row"].to_numpy()] = np.stack([added[c].to_numpy() for c in sum_names], axis=1)
    unseen = ~total.any(axis=1)
    total[unseen] = index_vectors()[unseen]
    vectors = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            x = pooled(*text_bytes(part.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["h", "label", "x"])

    got = sample.mapInArrow(pool, "h long, label int, x binary").orderBy("h", "label", "x").toPandas()
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(len(got), 2 * DIMS + EXTRAS).astype(np.float64)
    return train(x, got["label"].to_numpy(), vectors)


def classify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The ``keep`` columns of every row, with score and predicted (1 if score >= threshold) under the names ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, source):
            score = shared.value.score(pooled(*text_bytes(part.column(source)), shared.value.vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, *into])

    own = docs.select(*(named(c) for c in keep), *([] if text_col in keep else [F.col(text_col).cast("string").alias("_text")]))
    source = text_col if text_col in keep else "_text"
    return own.mapInArrow(run, StructType([*own.schema.fields[: len(keep)], StructField(into[0], DoubleType()), StructField(into[1], IntegerType())]))

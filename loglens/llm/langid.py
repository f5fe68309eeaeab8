"""Language identification by rank-order n-gram profiles.

A text becomes letters in lower case with single blanks around words; its 1- to 3-grams are ranked by frequency
(ties by hash).  A language profile is the same ranking over all training texts of that language.  The distance
of a document to a profile adds up, over the document's most frequent n-grams, how far each is from its place
in the profile; n-grams missing there cost the profile's length.  The nearest profile wins (ties: first in order).

Defined results: null texts and texts without a letter are ``und`` with score 0; with no training rows every text
is ``und``; a text may be of any length; repeated rows are scored alike; a column of more than ``MOST_LANGUAGES``
languages is an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import chunks, mix64, named

#: Places in a profile, and most frequent n-grams of a document that are compared.
PROFILE = 400
UNKNOWN = "und"
#: Most languages; a column with more distinct values is refused, not cut.  There are about 8,000 language codes.
MOST_LANGUAGES = 10_000
#: Distances, texts times languages, that are held at a time.
MOST_CELLS = 1 << 22
#: Bytes of text handled at a time: the arrays made of them fit a core's cache.
CHUNK = 1 << 17
_BITS = np.uint64(40)
_MASK = np.uint64((1 << 40) - 1)
_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letter[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram hash, count) of all n-grams of the texts, by row and hash; the hash has 40 bits."""
    low = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    row = np.repeat(np.arange(len(low), dtype=np.uint64), np.fromiter(map(len, low), dtype=np.int64, count=len(low)))
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a word
    if len(keep):
        keep[:-1] |= letter[1:]  # and the last one before a word
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    row, letter = row[keep], letter[keep]
    single = np.ones(len(code), dtype=bool)
    single[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    code, row, letter = code[single], row[single], letter[single]
    two = np.flatnonzero((row[1:] == row[:-1]) & (letter[1:] | letter[:-1]))
    three = np.flatnonzero((row[2:] == row[:-2]) & letter[1:-1])
    one = np.flatnonzero(letter)
    gram = np.concatenate([code[one], code[two] << np.uint64(21) | code[two + 1], code[three] << np.uint64(42) | code[three + 1] << np.uint64(21) | code[three + 2]])
    keys = np.concatenate([row[one], row[two], row[three]]) << _BITS | mix64(gram) & _MASK
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    keys_, count = keys[first], np.diff(first, append=len(keys))
    return (keys_ >> _BITS).astype(np.int64), keys_ & _MASK, count


def _top(row: np.ndarray, gram: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank) of each row's k most frequent n-grams."""
    order = np.argsort((row.astype(np.uint64) << np.uint64(32)) + (np.uint64(0xFFFFFFFF) - np.minimum(count, 0xFFFFFFFF).astype(np.uint64)), kind="stable")
    row, gram = row[order], gram[order]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row)))
    own = rank < k
    return row[own], gram[own], rank[own]


@dataclass(frozen=True)
class Profiles:
    """Languages in order, all profiled n-grams ascending, and from ``first`` on the languages that have each and their ranks.

    Only n-grams that a language has are stored, ``size`` of each, so the whole grows with the number of languages alone.
    """

    languages: list[str]
    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """From rows (language, n-gram, rank)."""
        languages = sorted({lang for lang, _, _ in rows})
        number = {x: i for i, x in enumerate(languages)}
        gram = np.array([g for _, g, _ in rows], dtype=np.uint64)
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        owner = np.array([number[lang] for lang, _, _ in rows], dtype=np.int64)[order]
        return cls(languages, grams, np.append(first, len(rows)), owner, np.array([r for _, _, r in rows], dtype=np.int64)[order], size)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is 1 less the distance as a share of the largest possible."""
        if len(texts) > 1 and len(texts) * len(self.languages) > MOST_CELLS:
            parts = [self.predict(half) for half in (texts[: len(texts) // 2], texts[len(texts) // 2 :])]
            return parts[0][0] + parts[1][0], np.concatenate([p[1] for p in parts])
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        row, gram, count = ngrams([t or "" for t in texts])
        if not len(row) or not self.languages:
            return lang, score
        row, gram, rank = _top(row, gram, count, self.size)
        start = np.flatnonzero(np.diff(row, prepend=-1))
        n = np.diff(start, append=len(row))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        own = np.flatnonzero(self.grams[at] == gram)
        times = self.first[at[own] + 1] - self.first[at[own]]
        each = np.repeat(self.first[at[own]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        saved = self.size - np.abs(self.ranks[each] - np.repeat(rank[own], times))  # below the cost of an n-gram that is missing
        place = np.repeat(np.repeat(np.arange(len(start)), n)[own], times) * len(self.languages) + self.owner[each]
        total = (n * self.size)[:, None] - np.bincount(place, weights=saved, minlength=len(start) * len(self.languages)).reshape(len(start), -1)
        best = total.argmin(axis=1)
        for r, b, s in zip(row[start].tolist(), best.tolist(), (1 - total.min(axis=1) / (n * self.size)).tolist(), strict=True):
            lang[r], score[r] = self.languages[b], s
        return lang, score


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """(lang, gram, rank) of each language's most frequent n-grams; no task passes on more than ``size`` rows of a language."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            for lang in [k for k, v in kept.items() if len(v[0]) >= least]:
                g, n = kept.pop(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for part in chunks(batches, text_col, CHUNK):
            langs = np.asarray(part.column(lang_col).to_pylist(), dtype=object)
            row, gram, n = ngrams(part.column(text_col).to_pylist())
            for lang in dict.fromkeys(langs.tolist()):
                own = (langs == lang)[row]
                old = kept.get(lang, (gram[:0], n[:0]))
                g, inverse = np.unique(np.concatenate([old[0], gram[own]]), return_inverse=True)
                kept[lang] = g, np.bincount(inverse, weights=np.concatenate([old[1], n[own]]), minlength=len(g)).astype(np.int64)
            yield from flush(500_000)
        yield from flush(0)

    own = docs.select(F.col(text_col).alias(text_col), F.col(lang_col).cast("string").alias(lang_col)).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = own.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = most_frequent(counts, size)
    rows = top.limit(MOST_LANGUAGES * size + 1).collect()
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Profiles.of([(r["lang"], r["gram"], r["rank"]) for r in rows], size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns of every row, with lang_pred and score under the names ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x size entries, MOST_LANGUAGES x size at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, source, CHUNK):
            lang, score = shared.value.predict(part.column(source).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, *into])

    own = docs.select(*(named(c) for c in keep), *([] if text_col in keep else [F.col(text_col).cast("string").alias("_text")]))
    source = text_col if text_col in keep else "_text"
    return own.mapInArrow(run, StructType([*own.schema.fields[: len(keep)], StructField(into[0], StringType()), StructField(into[1], DoubleType())]))


def least_scores(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language the least score that texts of it get, over all rows with a text and a language."""
    own = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = identify(own, profiles, "text", ("lang",), ("_found", "_score"))
    return {r["lang"]: r["least"] for r in found.filter("lang = _found").groupBy("lang").agg(F.min("_score").alias("least")).collect()}  # a row for each language

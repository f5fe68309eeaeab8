"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), and all but the last return the columns of ``docs``.

Every stage works on all rows that the one before it kept, with null and repeated ids and null texts as its operator
defines them.  Further columns, of whatever name and type, are passed on by all stages but the last; stages choose names
for what they add that ``docs`` doesn't have.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, neardup, packing, quality
from ._common import fresh, materialise, table

#: A text is in no language that was learned if it scores less than this share of the least score among texts of the nearest
#: one that it was learned from, or less than LEAST_LANGUAGE (clean texts score about 0.4 to 0.9).
LANGUAGE_SHARE, LEAST_LANGUAGE = 0.9, 0.25
SEQUENCE, END_ID = 1024, 2
#: Rows that may be broadcast as row numbers (8 MB); more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def remainder(column: str, buckets: int) -> F.Column:
    """crc32 of the id as text, modulo ``buckets``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def fit_quality(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """The quality model from the labelled rows outside the held-out fold."""
    own = labels.select("doc_id", "quality").filter(remainder("doc_id", 5) != 0)
    return quality.fit(docs.filter(remainder("doc_id", 5) != 0), own)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs, "_score"), fresh(docs, "_predicted")
    scored = quality.classify(docs, model, keep=tuple(docs.columns), into=names)
    return scored.filter(F.col(names[1]) == 1).drop(*names)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the table itself."""
    training = docs.select("doc_id", "text", "lang").filter(remainder("doc_id", 4) != 2)
    profiles = langid.learn(training)
    floors = {k: max(LEAST_LANGUAGE, LANGUAGE_SHARE * v) for k, v in langid.least_scores(training, profiles).items()}
    names = fresh(docs, "_lang"), fresh(docs, "_likeness")
    found = langid.identify(docs, profiles, keep=tuple(docs.columns), into=names)
    least = F.lit(LEAST_LANGUAGE)
    if floors:
        least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(floors.items()) for x in kv]), F.col(names[0])), least)
    return found.filter((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= least)).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near duplicates.

    Rows are told apart by a number, so null and repeated ids do no harm.  It is written with them: it depends on how a
    scan is split, which may change between the jobs that read it.
    """
    row = fresh(docs, "_row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    classes = neardup.jaccard_join(rows, id_col=row)
    dropped = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias(row))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, row, "left_anti").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    name = fresh(docs, "_leaks")
    return decontam.mark_leaks(docs, table(spark, sf_dir, "benchmark"), into=name).filter(F.size(name) == 0).drop(name)


def packed(docs: DataFrame, with_ids: bool) -> DataFrame:
    """Pieces of all documents with their place in training sequences."""
    import public_tokenizers as P

    encoder = packing.bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return packing.pack_documents(docs, encoder, SEQUENCE, END_ID, with_ids=with_ids)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document, with its place and its token ids.

    Sorted by offset, the ids of a sequence_id are that sequence.  Columns are doc_id, piece, start, length, ids_crc32, ids,
    sequence_id and offset; all others of ``docs`` end here.
    """
    return packed(docs, True)

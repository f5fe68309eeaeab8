"""Corpus pipeline: quality, language, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglens.llm import pipeline_stages as stages
from loglens.llm._common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: In order; each stage gets what the one before it kept.
STAGES: list[tuple[str, Stage]] = [
    ("quality", stages.keep_quality),
    ("language", stages.keep_language),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontaminate", stages.drop_contaminated),
    ("pack", stages.pack),
]
#: A fitted network, language profiles and a tokenizer have no SQL form; tests compare with a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages one by one against plain expectations, and the whole of it."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loglens.llm import decontam, neardup
from loglens.llm._common import materialise

from .helpers import SMALL, documents, folder, languages_with_a_rare_text, odd_documents
from .test_neardup import grams

MIDDLE = "/root/testdata/sf0.01"


def test_registered():
    found = entry.queries()
    assert found["pipeline"] and {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontaminate", "pack"]


def test_stages_on_the_middle_tables(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = pd.read_parquet(f"{MIDDLE}/labels.parquet").set_index("doc_id")["quality"]
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        before = now.toPandas()
        now = materialise(stage(spark, now, MIDDLE), "test-stage")
        own = now.toPandas()
        sizes.append(len(own))
        if name != "pack":
            assert list(own.columns) == list(before.columns) and set(own["doc_id"]) <= set(before["doc_id"])
        gone = set(before["doc_id"]) - set(own["doc_id"])
        if name == "quality":
            known = labels[labels.index.isin(before["doc_id"])]
            assert known[known == 1].index.isin(own["doc_id"]).mean() > 0.98 and known[known == 0].index.isin(gone).mean() > 0.95
        elif name == "language":
            assert not gone
        elif name == "near_duplicates":
            sets = {i: grams(t) for i, t in zip(own["doc_id"], own["text"], strict=True)}
            index: dict = {}
            for i, s in sets.items():
                for g in s:
                    index.setdefault(g, []).append(i)
            near = {(a, b) for ids in index.values() for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
            assert not near and gone
        elif name == "decontaminate":
            items = [decontam.normalise(t) for t in pd.read_parquet(f"{MIDDLE}/benchmark.parquet")["text"]]
            holds = {i for i, t in zip(before["doc_id"], before["text"], strict=True) if any(x in decontam.normalise(t) for x in items)}
            assert gone == holds and holds
        else:
            assert set(own["doc_id"]) == set(before["doc_id"])
            assert (own.groupby("sequence_id")["length"].sum() <= 1024).all()
            assert own["sequence_id"].nunique() <= 1.01 * own["length"].sum() / 1024 + 1
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > sizes[4]


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    rows = got.toPandas()
    assert len(rows) > 100 and (rows["ids"].map(len) == rows["length"]).all()
    assert all(zlib.crc32(np.asarray(i, "<u4").tobytes()) == c for i, c in zip(rows["ids"], rows["ids_crc32"], strict=True))
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 1024


#: Names that stages and operators use inside, some in another case, with types that a schema written as text would spoil.
INSIDE = ["_score", "_predicted", "_lang", "_LIKENESS", "_row", "_row_", "_leaks", "score", "predicted", "_text", "text_", "_salt", "_found", "node", "band", "leaks"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    kinds = {c: F.lit(c) for c in INSIDE} | {"odd name, with: marks": F.struct(F.lit(1).alias("a b"), F.array(F.lit("x")).alias("c,d")), "when": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")}
    docs = documents(spark, [(i, " ".join(f"the word number {i * k % 97}" for k in range(60)), "en", "s", 1) for i in range(1, 30)]).withColumns(kinds)
    path = folder(spark, tmp_path, documents=docs)
    now = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = materialise(stage(spark, now, path), "test-names")
        assert out.columns == docs.columns and out.count() and out.schema == now.schema
        assert out.select(*INSIDE).distinct().collect() == [tuple(INSIDE)]
    out = corpus_pipeline.STAGES[0][1](spark, now, path)
    assert out.columns == docs.columns and out.count() >= 0


def test_languages_that_were_not_learned_go(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    other = ["To jest tekst napisany w języku polskim, który mówi o wielu sprawach życia codziennego i o czasie", "Bu metin Türkçe yazılmıştır ve günlük hayatın birçok konusundan bahsetmektedir çünkü zaman hızlı geçiyor", "qzxw vkjq wxyz qqqq zzxj kkwq pqxz", "Это русский текст о погоде", "这是中文文本"]
    more = docs.sparkSession.createDataFrame([(-1 - i, t, None, "s", 1) for i, t in enumerate(other)], docs.schema)
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(more), MIDDLE)
    assert kept.filter("doc_id < 0").count() == 0 and kept.count() == docs.count()


def test_language_keeps_every_text_it_learned_from(spark):
    ids = iter(i for i in range(100_000) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(next(ids), t, lang, "s", len(t)) for t, lang, _ in languages_with_a_rare_text()]
    kept = dict(corpus_pipeline.STAGES)["language"](spark, documents(spark, rows).repartition(3), SMALL)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("rows", [[], None])
def test_odd_and_empty_tables(spark, tmp_path, rows):
    docs = documents(spark, rows, clash=True)
    path = folder(spark, tmp_path, documents=docs)
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, now, path), "test-odd")
        if name != "pack":
            assert out.columns == docs.columns
        if name == "near_duplicates" and rows is None:
            texts = [grams(r["text"]) for r in out.select("text").collect()]
            assert len(texts) == len(set(texts))
        now = out
    assert corpus_pipeline.run(spark, path).count() >= (0 if rows is not None else 1)


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rows = []
    for g in range(20):
        base = [f"g{g}w{k}" for k in range(100)]
        for c in range(rng.randint(1, 5)):
            own = list(base)
            if c:
                own[rng.randrange(100)] = f"e{rng.random()}"
            rows.append((None if g == 0 else g, " ".join(own), "en", "s", 1))
    out = stage(spark, documents(spark, rows), SMALL)
    assert sorted(r["text"][:4].split("w")[0] for r in out.collect()) == sorted(f"g{g}" for g in range(20))
    assert len(odd_documents()) == 16


def test_near_duplicates_when_scans_are_split_anew(spark, monkeypatch):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    words = [" ".join(f"t{g}w{k}" for k in range(60)) for g in range(40)]
    rows = [(i, words[i % 40], "en", "s", 1) for i in range(60)]
    docs = materialise(documents(spark, rows).repartition(8), "test-split")
    join = neardup.jaccard_join

    def then_split(*args, **kw):
        classes = materialise(join(*args, **kw), "test-classes")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        return classes

    monkeypatch.setattr(neardup, "jaccard_join", then_split)
    try:
        out = [r["text"] for r in stage(spark, docs, SMALL).collect()]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(out) == sorted(words)

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from loglens.llm import packing
from loglens.llm._common import materialise

from .helpers import documents, odd_documents

BPE = packing.bpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def best_fit(lengths, capacity):
    """Piece by piece, looking at every bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return Counter(bins)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 50, 128])
    lengths = [rng.randint(1, rng.choice([capacity, 5])) for _ in range(rng.randint(0, 250))]
    fill: dict[int, int] = {}
    ranks = Counter()
    for length, rank, count, first, offset in packing.plan(dict(Counter(lengths)), capacity):
        assert rank == ranks[length]
        ranks[length] += count
        for i in range(first, first + count):
            assert fill.get(i, 0) == offset
            fill[i] = offset + length
    assert ranks == Counter(lengths)
    assert Counter(capacity - f for f in fill.values()) == best_fit(lengths, capacity)


def test_plan_refuses_other_lengths():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)
    assert packing.plan({}, 10) == []


def test_fit_tree():
    t = packing.FitTree(20)
    assert t.tightest(0) == -1
    for r in (3, 7, 20):
        t.mark(r, True)
    assert [t.tightest(n) for n in (0, 3, 4, 8, 20)] == [3, 3, 7, 20, 20]
    t.mark(20, False)
    assert t.tightest(8) == -1


def test_cut_keeps_all_ids():
    for n in range(1, 30):
        got = list(packing.cut(list(range(n)), 7))
        assert [i for _, p in got for i in p] == list(range(n)) and all(len(p) == 7 for _, p in got[1:])
        assert [s for s, _ in got] == list(np.cumsum([0, *[len(p) for _, p in got[:-1]]]))


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["", "a b", "  x\n\n y's 12 ", "größe 你好 \U0001f600", "<|endoftext|> mid <|endoftext|>", "\x00\x01", "a" * 5000]
    assert BPE()(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_tokenizer_on_a_whole_table():
    import pandas as pd
    from tokenizers import Tokenizer

    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"].fillna("").tolist()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert BPE()(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("clash", [False, True])
def test_packs_odd_documents_whole(spark, clash):
    docs = documents(spark, clash=clash)
    got = packing.pack_documents(docs, BPE, 1024, 2, with_ids=True).toPandas()
    by_sequence = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in by_sequence:
        assert list(s["offset"]) == list(np.cumsum([0, *s["length"][:-1]])) and s["length"].sum() <= 1024
    assert all(zlib.crc32(np.asarray(i, "<u4").tobytes()) == c and len(i) == n for i, c, n in zip(got["ids"], got["ids_crc32"], got["length"], strict=True))
    ids = [[*i, 2] for i in BPE()([t or "" for _, t, *_ in odd_documents()])]
    assert got["length"].sum() == sum(map(len, ids)) and (got["piece"] == 0).sum() == len(ids)
    long = got[got["doc_id"] == 7].sort_values("piece")
    assert [i for p in long["ids"] for i in p] == ids[9]
    assert len(by_sequence) == sum(best_fit(got["length"], 1024).values())


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), BPE).count() == 0


@pytest.mark.parametrize("sent_out", [packing.BROADCAST_STARTS, 0])
def test_pack_over_many_partitions(spark, monkeypatch, sent_out):
    monkeypatch.setattr(packing, "BROADCAST_STARTS", sent_out)
    items = spark.range(0, 3000, 1, 13).selectExpr("id % 60 + 1 as length", "spark_partition_id() as shard", "id as slot", "id as keep")
    got = packing.pack(materialise(items, "t"), 64).toPandas()
    assert sorted(got["keep"]) == list(range(3000))
    x = got.sort_values(["sequence_id", "offset"])
    assert ((x.groupby("sequence_id")["length"].cumsum() - x["length"]) == x["offset"]).all() and x.groupby("sequence_id")["length"].sum().max() <= 64
    assert x["sequence_id"].nunique() == sum(best_fit(got["length"], 64).values())

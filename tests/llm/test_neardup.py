from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import neardup
from loglens.llm.graph import connected_components

from .helpers import documents


def grams(text, n=5):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(class, links, linked texts, copies) of each row, from all pairs."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, texts = Counter(), defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                if a != b:
                    texts[i].add(b)
                    texts[j].add(a)
                root[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(known) if known else None
    return Counter((rows[i][0], least[find(i)], links[i], len(texts[i]), sum(s == sets[i] for s in sets)) for i in range(len(rows)))


def joined(df, **options):
    return Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_linked_texts"], r["n_copies"]) for r in neardup.jaccard_join(df, **options).collect())


@pytest.mark.parametrize("clash", [False, True])
def test_odd_documents(spark, clash):
    df = documents(spark, clash=clash)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert joined(df) == brute(rows)


def test_empty_and_unlinked_tables(spark):
    assert neardup.jaccard_join(documents(spark, [])).count() == 0
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(5)], "doc_id long, text string")
    assert joined(df) == Counter((i, i, 0, 0, 1) for i in range(5))


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PART", 5)
    monkeypatch.setattr("loglens.llm._common.HOT_ROWS", 4)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((100 - i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"y{i}.{k}" for k in range(30))) for i in range(10)] + [(2000 + i, "same words here for all of us") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, recall=0.9999999) == brute(rows)


def test_work_follows_pairs_not_components(spark):
    """A chain of texts, each alike only to its neighbours, is one component; its texts travel as often as those of single pairs."""
    counts = []
    for n in (500, 1000):
        words = [f"w{i}" for i in range(12 * n + 150)]
        df = spark.createDataFrame([(i, " ".join(words[12 * i : 12 * i + 150])) for i in range(n)], "doc_id long, text string")
        bands, rows = neardup.banding()
        feats = neardup.features(df, bands, rows, 5, "doc_id", "text").withColumn("copies", F.lit(1))
        counts.append(neardup.candidates(feats, bands).count())
        if n == 500:
            got = neardup.jaccard_join(df)
            assert got.select("class_id").distinct().count() == 1 and {r["n_links"] for r in got.collect()} == {1, 2}
    assert counts[0] <= 500 * 6 and counts[1] <= 2.2 * counts[0]


def test_parts_hold_every_link_once(monkeypatch):
    monkeypatch.setattr(neardup, "PART", 4)
    rng = np.random.default_rng(2)
    for n in (1, 3, 4, 5, 13):
        link = np.triu(rng.random((n, n)) < 0.3, 1)
        seen = np.zeros((n, n), dtype=int)
        for _, place, at, bits in neardup.parts_of(link | link.T):
            own = np.unpackbits(bits, axis=1)[:, at]
            seen[np.ix_(place, place)] += own
        assert (seen == (link | link.T)).all()


def test_grams_are_packed():
    g = np.sort(np.random.default_rng(1).integers(0, 2**64, 50, dtype=np.uint64))
    assert (neardup.unpacked(neardup.packed(g)) == g >> np.uint64(16)).all() and neardup.packed(g[:0]) == b"" and len(neardup.unpacked(b"")) == 0


def test_banding():
    for recall in (0.9, 0.99, 0.9995, 0.99999):
        bands, rows = neardup.banding(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 256
    assert neardup.banding()[1] >= 6


def test_recall_at_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = [f"{i}w{k}" for k in range(104)]
        o = list(w)
        for p in (10, 40):  # two words changed: 10 of 100 n-grams on either side, a similarity of 90/110
            o[p] = f"new{rng.random()}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(o))]
    got = neardup.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_links = 1").count()
    assert got >= 0.99 * len(rows)


def test_forest_and_compare():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 40))))
        root = neardup.forest(n, a, b)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert [label[i] == label[j] for i in range(n) for j in range(n)] == [root[i] == root[j] for i in range(n) for j in range(n)]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(2000, 2100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in root}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

"""Quality, language and language-model scoring: held-out accuracy, plain versions, odd inputs."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglens.llm import langid, lm, quality, queries
from loglens.llm._common import bucket_of, text_bytes

from .helpers import SMALL, documents, folder, languages_with_a_rare_text, odd_documents

MIDDLE = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = queries.op1_quality(spark, MIDDLE).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    x = got.merge(pd.read_parquet(f"{MIDDLE}/labels.parquet"), on="doc_id").query("held_out")
    good, bad = x[x["quality"] == 1]["score"].to_numpy(), x[x["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (x[x["quality"] == 1]["predicted"] == 1).mean() > 0.97


def test_quality_words():
    texts = ["Ab ab AB!! ab ab", "", "  ", "ÄÖ 12-34"]
    import pyarrow as pa

    word, shape, n, distinct, again = quality.words(*text_bytes(pa.array(texts)))
    assert list(n) == [5, 0, 0, 2] and list(distinct) == [3, 0, 0, 2] and list(again) == [1, 0, 0, 0]
    assert len(word) == len(shape) == 7 and shape[1] == shape[3] != shape[0]


def test_random_indexing_word_by_word():
    import pyarrow as pa

    texts = ["a b c d e f a b", "", "x", "a A b 1 c-3", "one two one two one"]
    data, offsets = text_bytes(pa.array(texts))
    word, shape, n, distinct, again = quality.words(data, offsets)
    index, got = quality.index_vectors(), np.zeros((2 * quality.ROWS, quality.DIMS), dtype=np.int64)
    quality.context_sums(data, offsets, index, got)
    want = np.zeros_like(got)
    first = 0
    for t, size in zip(texts, n.tolist(), strict=True):
        assert size == len(t.split())
        for i in range(size):
            for j in range(size):
                if 0 < abs(i - j) <= quality.WINDOW:
                    for own in (word, shape):
                        want[own[first + i]] += index[word[first + j]] + index[shape[first + j]]
        first += size
    assert (got == want).all() and set(np.unique(index)) == {-1, 0, 1}
    vectors = np.random.default_rng(1).normal(size=got.shape).astype(np.float32)
    x = quality.pooled(data, offsets, vectors)
    first = 0
    for k, t in enumerate(texts):
        w, size = t.split(), int(n[k])
        for part, own in ((x[k, : quality.DIMS], word), (x[k, quality.DIMS : 2 * quality.DIMS], shape)):
            mean = sum((vectors[own[first + i]].astype(float) for i in range(size)), np.zeros(quality.DIMS)) / max(size, 1)
            assert np.allclose(part, mean, atol=1e-6)
        some, kinds = max(size, 1), len(set(w))
        rest = [sum(a == b for a, b in zip(w, w[1:])) / some, math.log1p(size), kinds / some, math.log1p(len(t.encode()) / some), math.sqrt(kinds) / math.log1p(some), not w]
        assert np.allclose(x[k, 2 * quality.DIMS :], rest, atol=1e-6)
        first += size


def test_fit_adds_up_all_chosen_texts(spark):
    import pyarrow as pa

    rows = [(i, f"word{i % 7} comes after word{i % 3} and before word{i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    table = np.zeros((2 * quality.ROWS, quality.DIMS), dtype=np.int64)
    quality.context_sums(*text_bytes(pa.array([t for _, t in rows])), quality.index_vectors(), table)
    unseen = ~table.any(axis=1)
    table[unseen] = quality.index_vectors()[unseen]
    want = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)
    assert np.allclose(quality.fit(docs, labels).vectors, want, atol=1e-6)


def test_quality_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    d = 2 * quality.DIMS + quality.EXTRAS
    x = rng.normal(size=(3000, d))
    p = 1 / (1 + np.exp(-2 * x[:, 0] - 2 * np.maximum(x[:, 1], 0)))
    y = (rng.random(3000) < p).astype(int)
    model = quality.train(x[:2500], y[:2500], np.zeros((1, 1)))
    s = model.score(x[2500:])
    assert ((s > 0.5) == (p[2500:] > 0.5)).mean() > 0.8 and np.abs(s - p[2500:]).mean() < 0.15
    assert (quality.train(x[:0], y[:0], np.zeros((1, 1))).score(x[:5]) == 0.5).all()


@pytest.mark.parametrize("clash", [False, True])
def test_quality_odd_inputs(spark, clash):
    docs = documents(spark, clash=clash)
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, 1), (None, 1), (5, None), (1, 1), (99, 0), (2, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).toPandas()
    assert len(got) == len(odd_documents()) and got["score"].between(0, 1).all()
    empty = quality.fit(docs, labels.limit(0))
    assert set(quality.classify(docs, empty).toPandas()["score"]) == {0.5}
    assert quality.classify(documents(spark, []), model).count() == 0


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        p = f" {w} "
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def test_ngrams_like_the_plain_version():
    texts = ["Hello, World  x", "", "ÄÖü 12 ab-c", "ΑΒΓ 你好", "a", "--- 1", "İ ß"]
    row, gram, count = langid.ngrams(texts)
    for i, t in enumerate(texts):
        own = plain_ngrams(t)
        assert sorted(count[row == i]) == sorted(own.values())
        assert len(set(gram[row == i])) == len(own)
    again = langid.ngrams(["Hello, World  x"])
    assert (again[1] == gram[row == 0]).all()


def test_distance_like_the_plain_version():
    texts = {"aa": "the cat and the hat and the bat", "bb": "le chat et le chien et le rat"}
    size = 20
    order = {k: [g for _, g in sorted((-n, g) for g, n in zip(*langid.ngrams([t])[1:], strict=True))][:size] for k, t in texts.items()}
    p = langid.Profiles.of([(k, g, r) for k in order for r, g in enumerate(order[k])], size)
    query = "the rat and the chat"
    own = [g for _, g in sorted((-n, g) for g, n in zip(*langid.ngrams([query])[1:], strict=True))][:size]
    cost = {k: sum(abs(i - o.index(g)) if g in o else size for i, g in enumerate(own)) for k, o in order.items()}
    lang, score = p.predict([query, None, "12", ""])
    assert lang == [min(cost, key=cost.get), "und", "und", "und"]
    assert score[0] == pytest.approx(1 - min(cost.values()) / (len(own) * size)) and list(score[1:]) == [0, 0, 0]


def hashed(gram):
    """The 40-bit hash of an n-gram of one to three characters."""
    h = functools.reduce(lambda a, c: a << 21 | ord(c), gram, 0)
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) % 2**64
    return (h ^ (h >> 31)) % 2**40


def test_profiles_like_the_plain_version(spark, monkeypatch):
    rows = [(t, lang) for _, t, lang, *_ in odd_documents()] + [("ab ab cd", "xx"), ("zz", "yy"), (None, "xx"), ("ab", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    counts = {}
    for t, lang in rows:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_ngrams(t))
    size = 30
    want = {}
    for lang, c in counts.items():
        order = sorted(((-n, hashed(g)) for g, n in c.items()))[:size]
        want |= {(lang, g): r for r, (_, g) in enumerate(order)}
    p = langid.learn(df, size=size)
    got = {(p.languages[p.owner[k]], int(g)): int(p.ranks[k]) for i, g in enumerate(p.grams) for k in range(p.first[i], p.first[i + 1])}
    assert got == want and p.languages == sorted(lang for lang in counts if counts[lang])
    texts = ["ab cd", "größe", None, "x y z"]
    whole = p.predict(texts)
    monkeypatch.setattr(langid, "MOST_CELLS", 2)
    halves = p.predict(texts)
    assert halves[0] == whole[0] and (halves[1] == whole[1]).all()
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.learn(df, size=5)


def test_a_task_passes_on_few_rows_of_a_language(spark):
    counts = spark.range(10).select((F.col("id") % 2).cast("string").alias("lang"), F.col("id").alias("gram"), F.lit(1).alias("n"))
    assert "WindowGroupLimit" in langid.most_frequent(counts, 5)._jdf.queryExecution().executedPlan().toString()


def test_language_on_held_out_rows(spark):
    got = queries.op4_language(spark, MIDDLE).toPandas()
    docs = pd.read_parquet(f"{MIDDLE}/documents.parquet", columns=["doc_id", "lang"])
    x = got.merge(docs, on="doc_id").query("held_out")
    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"] and got["score"].between(0, 1).all()
    assert (x["lang"] == x["lang_pred"]).mean() > 0.98


def test_least_scores_are_of_all_training_texts(spark):
    rows = languages_with_a_rare_text()
    odd = [(None, "l0"), ("nothing of a language", None), ("", "l0"), ("123", "l1")]
    docs = spark.createDataFrame([*[r[:2] for r in rows], *odd], "text string, lang string").repartition(3)
    profiles = langid.learn(docs)
    found, score = profiles.predict([r[0] for r in rows])
    want: dict[str, float] = {}
    for (_, lang, _), f, s in zip(rows, found, score.tolist(), strict=True):
        if f == lang:
            want[lang] = min(s, want.get(lang, 1.0))
    assert len(want) == 12 and langid.least_scores(docs, profiles) == want
    assert langid.least_scores(docs.limit(0), profiles) == {}


@pytest.mark.parametrize("clash", [False, True])
def test_language_odd_inputs(spark, clash):
    docs = documents(spark, clash=clash)
    got = langid.identify(docs, langid.learn(docs)).toPandas()
    assert len(got) == len(odd_documents())
    none = got[got["doc_id"].isin([4, 5, 6, 10])]
    assert set(none["lang_pred"]) == {"und"} and set(none["score"]) == {0}
    assert set(langid.identify(docs, langid.learn(documents(spark, []))).toPandas()["lang_pred"]) == {"und"}
    assert langid.identify(documents(spark, []), langid.learn(docs)).count() == 0


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def base_scores(rows, training):
    counts = Counter(t for text in training for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    scale = total + 0.5 * (kinds + 1)
    return [(len(ts := tokens(t)), sum(counts[x] > 0 for x in ts), total, sum(math.log10((counts[x] + 0.5) / scale) for x in ts)) for t in rows]


def test_streams_like_the_plain_version():
    import pyarrow as pa

    texts = ["Ab  cd\n", "", " x", "größe\x0bA", None, "a b c"]
    stream, begin, words, n = lm.streams(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        want = "".join(f"{w} " for w in tokens(t)[:-1]).encode() + b"\n"
        assert bytes(stream[begin[i] : begin[i + 1]]) == b"\n" * lm.PAD + want
    keys, text = lm.keys_of(stream, begin)
    place = 0
    for i in range(len(texts)):
        own = bytes(stream[begin[i] : begin[i + 1]])
        for k in range(lm.PAD, len(own)):
            assert int(keys[place]) == int.from_bytes(own[k - 5 : k + 1], "big") and text[place] == i
            place += 1
    assert place == len(keys) and list(n) == [2, 0, 1, 2, 0, 3] and len(words) == 8


def test_model_probabilities_add_up():
    rng = np.random.default_rng(1)
    bits = [16, 14, 14, 14, 14]
    size = sum(1 << b for b in bits)
    model = lm.Model(bits, rng.integers(0, 60, size, dtype=np.uint8), rng.integers(0, 60, size, dtype=np.uint8), rng.normal(0.3, 0.2, (lm.INPUTS, 125)).astype(np.float32), rng.uniform(0.05, 0.95, 256 * lm.BUCKETS).astype(np.float32))
    for before in (0x0A0A0A0A0A, 0x6162636465):
        keys = np.arange(256, dtype=np.uint64) | np.uint64(before << 8)
        assert np.exp(model.log_probability(keys)).sum() == pytest.approx(1)
    scorer = lm.Scorer(model, most=100)
    for _ in range(3):
        own = np.unique(rng.integers(0, 500, 80).astype(np.uint64))
        assert scorer(own) == pytest.approx(model.log_probability(own))


def plain_slot(model, order, before, node):
    """The slot of a context of ``order`` + 1 bytes and the bits so far, with whole numbers."""
    m64 = 2**64 - 1
    h = (before & (1 << 8 * lm.ORDERS[order]) - 1) ^ lm.ORDERS[order] << 56
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & m64
    h = (h ^ h >> 31 ^ node * 0x9E3779B97F4A7C15) & m64
    h = h * 0xD6E8FEB86659FD93 & m64
    return (h >> 64 - model.bits[order]) + sum(1 << b for b in model.bits[:order])


def plain_bytes(text):
    return b"".join(w.encode() + b" " for w in tokens(text)[:-1]) + b"\n"


def plain_log2(model, counts, text):
    """Bits of a text, bit by bit, from plain counts of zeros and ones."""
    raw = b"\n" * lm.PAD + plain_bytes(text)
    total = 0.0
    for at in range(lm.PAD, len(raw)):
        before, byte = int.from_bytes(raw[at - 5 : at], "big"), raw[at]
        for b in range(8):
            node, bit = 1 << b | byte >> 8 - b, byte >> 7 - b & 1
            x, gate = [], 0
            for k in range(len(lm.ORDERS)):
                pair = [min(255, round(10 * math.log2(n + 1))) for n in counts[plain_slot(model, k, before, node)]]
                near = [2 ** (q / 10) - 1 for q in pair]
                x.append(math.log(near[1] + 0.4) - math.log(near[0] + 0.4))
                if k >= 2:
                    gate = gate * 5 + sum(max(near) >= e for e in (0.5, 1.7, 5.5, 29.5))
            t = sum(float(model.weights[k][gate]) * v for k, v in enumerate([*x, 0.3]))
            t = min(max(t, -11.5), 11.5)
            where = (t + 12) * 32 / 24
            low = int(where)
            cells = model.refine[node * 33 + low], model.refine[node * 33 + low + 1]
            refined = cells[0] * (1 - (where - low)) + cells[1] * (where - low)
            p = 0.5 / (1 + math.exp(-t)) + 0.5 * refined
            total += math.log2(p if bit else 1 - p)
    return total


def test_score_like_a_bit_by_bit_mixer(spark):
    texts = ["The cat sat on the mat", "the cat ate the rat", "größe Übung", "", "a cat  sat\ton THE rat", "0 1 2"]
    training = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:4])], "doc_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    grams = lm.count(training).filter("kind = 0").select("key", "n")
    model = lm.fit(grams)
    counts = defaultdict(lambda: [0, 0])
    for t in texts[:4]:
        raw = b"\n" * lm.PAD + plain_bytes(t)
        for at in range(lm.PAD, len(raw)):
            before, byte = int.from_bytes(raw[at - 5 : at], "big"), raw[at]
            for b in range(8):
                for k in range(len(lm.ORDERS)):
                    counts[plain_slot(model, k, before, 1 << b | byte >> 8 - b)][byte >> 7 - b & 1] += 1
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, training).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_log2(model, counts, t) * math.log10(2), rel=1e-4)


def test_scores_do_not_depend_on_batches(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    seen = []
    for size in ("10000", "50"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            seen.append({r["doc_id"]: (r["score"], r["n_known"]) for r in lm.score(docs, docs.filter("doc_id % 3 > 0")).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1]


def test_several_learners_are_averaged(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    grams = lm.count(docs).filter("kind = 0").select("key", "n").persist()
    monkeypatch.setattr(lm, "GRAMS_EACH", grams.count() // 4)
    model = lm.fit(grams)
    assert np.isfinite(model.weights).all() and 0 < model.refine.min() and model.refine.max() < 1
    assert np.abs(model.weights - 0.25).max() > 0.05
    grams.unpersist()


def test_scores_of_the_small_tables(spark):
    got = queries.op2_lm(spark, SMALL).toPandas()
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    held = {i: bucket_of(i, 5) == 1 for i in docs["doc_id"]}
    want = base_scores(docs["text"], [t for i, t in zip(docs["doc_id"], docs["text"], strict=True) if not held[i]])
    own = got.set_index("doc_id").loc[docs["doc_id"]]
    assert (own["held_out"] == [held[i] for i in docs["doc_id"]]).all()
    for column, k in (("n_tokens", 0), ("n_known", 1), ("train_tokens", 2)):
        assert list(own[column]) == [w[k] for w in want]
    assert own["base_score"].to_numpy() == pytest.approx([w[3] for w in want])
    assert (own["score"] < 0).all() and 1 < own["bits_per_byte"].mean() < 3


def test_scores_adapt_to_the_corpus(spark):
    """Text like the training text is likelier than other text, and the held-out bits fall with more of it."""
    a = [(i, " ".join(f"alpha beta gamma delta {i % 7}" for _ in range(30))) for i in range(40)]
    train = spark.createDataFrame(a, "doc_id long, text string")
    probe = spark.createDataFrame([(1, "alpha beta gamma delta 3"), (2, "zq xj vk wy qp 3 fhgjr")], "doc_id long, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm.score(probe, train).collect()}
    less = {r["doc_id"]: r["bits_per_byte"] for r in lm.score(probe, train.limit(1)).collect()}
    assert got[1] < 1 < got[2] and got[1] < less[1]


@pytest.mark.parametrize("clash", [False, True])
def test_scores_of_odd_documents(spark, clash):
    docs = documents(spark, clash=clash)
    got = lm.score(docs, docs).toPandas()
    texts = [t for _, t, *_ in odd_documents()]
    want = base_scores(texts, texts)
    assert sorted(got["base_score"]) == pytest.approx(sorted(w[3] for w in want))
    assert sorted(got["n_tokens"]) == sorted(w[0] for w in want) and (got["n_known"] == got["n_tokens"]).all()
    assert lm.score(documents(spark, []), docs).count() == 0
    none = lm.score(docs, documents(spark, [])).toPandas()
    assert (none["train_tokens"] == 0).all() and (none["n_known"] == 0).all() and none["bits_per_byte"].to_numpy() == pytest.approx(8, abs=0.5)


def test_frequent_and_rare_words_agree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    texts = [r["text"] for r in docs.sort("doc_id").collect()]
    got = [r["base_score"] for r in lm.score(docs, docs).sort("doc_id").collect()]
    assert got == pytest.approx([w[3] for w in base_scores(texts, texts)])


def test_queries_with_odd_tables(spark, tmp_path):
    path = folder(spark, tmp_path, documents=documents(spark))
    for name in ("op1_quality", "op2_lm", "op4_language"):
        assert queries.queries()[name](spark, path).count() == len(odd_documents())

"""Licence scans, chat formatting, archives, fingerprints, decontamination."""

from __future__ import annotations

import gzip
import hashlib
import json
import random
import re

import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from loglens.llm import chat, decontam, fingerprint, license_table, licenses, queries, warc
from loglens.llm._common import _BYTE

from .helpers import CLASHES, SMALL, documents, folder, odd_documents

# ---- licences


NAMES = {licenses.normal(s): k for k, s in license_table.SENTENCES}


def plain_scan(text):
    """(rule, first, last, known, longest) from pieces one after the other."""
    if text is None:
        return []
    parts = []
    for line in re.sub(licenses.ASIDE, " ", text.replace("|", " ")).lower().split("\n"):
        line = re.sub(r"^[^\w\n]*(\(?[0-9a-z]{1,2}\)|rem|dnl)[ \t]+", "", line, flags=re.ASCII)
        for x in re.sub(r"([.!?])[ \t\r]+", r"\1\n", line).split("\n"):
            parts.append((re.sub(r"[^a-z0-9]+", " ", x).strip(), x[-1:] in (".", "!", "?")))
    known, i = [], 0
    while i < len(parts):
        best, said, j = None, "", i
        while j < len(parts) and parts[j][0] and any(n.startswith(said + parts[j][0]) for n in NAMES):
            said += parts[j][0]
            if said in NAMES:
                best = (i, NAMES[said], j)
            said += "|" if parts[j][1] else " "
            j += 1
        if best:
            known.append(best)
        i = best[2] + 1 if best else i + 1
    hits = [(r, a, a + len(seq) - 1) for a in range(len(known)) for r, _, seq in license_table.RULES if [k for _, k, _ in known[a : a + len(seq)]] == seq]
    return sorted((r, known[a][0], known[b][2], len(known), not any(x <= a and y >= b and y - x > b - a for _, x, y in hits)) for r, a, b in hits)


def license_texts():
    first = dict(reversed(license_table.SENTENCES))
    header = f"{first['APACHE-NOTICE']}\nSome prose. {first['APACHE-COMPLIANCE'].upper()}! {first['APACHE-COPY']}"
    more = ["SPDX-License-Identifier: MIT", "/* SPDX-License-Identifier: GPL-2.0-only */", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "(the MIT License", 'Licensed under the Apache License, Version 2.0;\nyou may not use this file except in compliance with the License.']
    return [None, "", "no such thing", "Released under the MIT License.", "x. Licensed under CC BY-NC 4.0. Released under the MIT License.\nAll rights reserved.", header, first["BSD-GRANT"], f"{first['MIT-CONDITION']} {first['MIT-GRANT']} {first['MIT-CONDITION']}", "released under the mit license and more", "license", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License. Released under the MIT License.", *more, *(s for _, s in license_table.SENTENCES)]


@pytest.mark.parametrize("clash", [False, True])
def test_licenses(spark, clash):
    rows = [(i, t) for i, t in enumerate(license_texts())] + [(None, "Released under the MIT License."), (3, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        df = df.withColumns({c: F.lit(1) for c in (*CLASHES, "k", "h", "m", "_id", "license")})
    got = sorted((str(r["doc_id"]), r["rule"], r["first_sentence"], r["last_sentence"], r["n_known"], r["longest"]) for r in licenses.scan(df).collect())
    assert got == sorted((str(i), *x) for i, t in rows for x in plain_scan(t))
    assert licenses.scan(df.limit(0)).count() == 0


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
MIT = """The MIT License (MIT)

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
"""
FILES = {"mit-text": MIT, "apache-header-text": APACHE, "gpl-3.0-later-header": GPL, "bsd-text": BSD, "bsd-3-text": BSD3, "mpl-2-header": MPL, "lgpl-2.1-later-header": LGPL, "isc-text": ISC}


def longest_rules(rows):
    out = {}
    for r in rows:
        if r["longest"]:
            out.setdefault(r["doc_id"], []).append(r["rule"])
    return out


@pytest.mark.parametrize("lead", ["", " * ", "# ", "// ", "-- ", ";; ", "\t% ", "rem ", "dnl ", "> "])
def test_files_as_they_are_wrapped(spark, lead):
    texts = {rule: "Some code.\n\n" + "".join(f"{lead}{line}\n" for line in t.splitlines()) + "\nmore code\n" for rule, t in FILES.items()}
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).collect()
    got = longest_rules(rows)
    for i, (rule, t) in enumerate(texts.items()):
        assert rule in got[i], (rule, got.get(i), t)
    own = sorted((r["doc_id"], r["rule"], r["first_sentence"], r["last_sentence"], r["n_known"], r["longest"]) for r in rows)
    assert own == sorted((i, *x) for i, t in enumerate(texts.values()) for x in plain_scan(t))


def test_other_line_ends_and_list_marks(spark):
    marks = [BSD.replace("1. ", "(1) ").replace("2. ", "(2) "), BSD.replace("1. ", "* ").replace("2. ", "* "), BSD.replace("1. ", "a) ").replace("2. ", "b) "), BSD.replace("\n", "\r\n")]
    broken = ["All rights\n\nreserved.", "All rights.\nReserved", "We say all\nrights reserved", "All\nrights reserved for us"]
    texts = [*marks, "Prose.\nAll|rights\nreserved.\nProse", *broken]
    got = longest_rules(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == {0: ["bsd-text"], 1: ["bsd-text"], 2: ["bsd-text"], 3: ["bsd-text"], 4: ["all-rights-reserved"]}


def test_a_table_of_ones_own(spark):
    df = spark.createDataFrame([(1, "Use it well, friend! Be kind.\nBe kind"), (2, "All rights reserved.")], "doc_id long, text string")
    known, rules = [("WELL", "use it well, Friend."), ("KIND", "Be kind")], [("both", "Own", ["WELL", "KIND"]), ("kind", "Own", ["KIND"])]
    got = sorted((r["doc_id"], r["rule"], r["first_sentence"], r["longest"]) for r in licenses.scan(df, known=known, rules=rules).collect())
    assert got == [(1, "both", 0, True), (1, "kind", 1, False), (1, "kind", 2, True)]


def test_licenses_match_sql_and_use_no_python(spark, tmp_path):
    import duckdb

    own = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).to_numpy()))
    files = [lead + t.replace("\n", "\n" + lead) for t in FILES.values() for lead in ("", " * ")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*license_texts(), *files])], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view odd as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert own(licenses.scan(df).toPandas()) == own(con.sql(licenses.scan_sql("odd")).df())
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    df = queries.op3_licenses(spark, SMALL)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert own(df.toPandas()) == own(con.sql(queries.oracle_sql()["op3_licenses"]).df())


def test_table_of_sentences():
    without = {k for k, s in license_table.SENTENCES if not any(t in s.lower() for t in license_table.TRIGGERS)}
    assert all(set(seq) - without for _, _, seq in license_table.RULES)
    assert {k for _, _, seq in license_table.RULES for k in seq} <= {k for k, _ in license_table.SENTENCES}
    assert len(NAMES) == len(license_table.SENTENCES) and len({r for r, _, _ in license_table.RULES}) == len(license_table.RULES)
    assert len(NAMES) >= 60 and len(license_table.RULES) >= 40


def test_a_text_of_many_sentences(spark):
    df = spark.createDataFrame([(1, "All rights reserved.\nother words here\n" * 30_000)], "doc_id long, text string")
    assert licenses.scan(df).groupBy("rule", "longest", "n_known").count().collect() == [("all-rights-reserved", True, 30_000, 30_000)]


# ---- chat


@pytest.mark.parametrize("seed", range(30))
def test_turns_come_back(seed):
    rng = random.Random(seed)
    bits = ["\\", "###", "</turn>", "<|", "image 0", "|>", ":", " ", "\n", "x", "ä", ": "]
    text, role = ("".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(2))
    formatted, (a, b), attached = chat.format_turn(role, text, loss_role=role)
    assert chat.read_turn(formatted) == (role, text) and chat.unescape(formatted[a:b]) == text
    assert not attached and not chat.attachment_of(formatted)
    body = formatted[len(chat.HEADER) : -len(chat.END)]
    assert not re.search(r"(?<!\\)(?:\\\\)*(###|</turn>|<\|)", body)


def test_typed_parts():
    parts = ["see ", {"type": "image", "ref": "a.png", "width": 280, "height": 57}, {"type": "text", "text": "<|image 9|>"}, {"type": "audio", "url": "b.wav", "seconds": 2.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "odd", "x": 1}, {"type": "text"}]
    formatted, (a, b), attached = chat.format_turn("assistant", parts)
    assert [(x["kind"], x["ref"], x["tokens"]) for x in attached] == [("image", "a.png", 30), ("audio", "b.wav", 63), ("document", "c.pdf", 1536)]
    assert chat.attachment_of(formatted) == [("image", 0), ("audio", 1), ("document", 2)]
    assert formatted[a:b].startswith("see <|image 0|>\\<|image 9|><|audio 1|>") and formatted[b:] == chat.END
    assert chat.format_turn("user", None)[0] == "### user: </turn>\n"
    with pytest.raises(ValueError):
        chat.read_turn("no turn")


def plain_digests(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len(chat.format_turn(r, t)[0]) for r, t in turns))
    return out


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### x</turn>"), (1, 2, "assistant", None), (2, 5, None, "x"), (2, None, "system", ""), (None, 0, "assistant", "ä\\"), (3, 0, "assistant", "y" * 300_000), (3, 1, "a: b", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("formatted", "loss_start", "content")})
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got == plain_digests(rows)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    twice = chat.read_back(chat.format_turns(df.unionAll(df))).filter("conv_id = 3").first()
    assert twice["n_turns"] == 4


def test_typed_contents(spark):
    parts = [{"type": "text", "text": "see <|image 0|> "}, {"type": "image", "ref": "a.png", "width": 560, "height": 280}, None, {"type": "audio", "ref": "b.wav", "seconds": 2.5}, {"type": "text", "text": None}, {"type": "document", "ref": "c.pdf", "pages": 3}]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [{"type": "text", "text": "ok"}]), (2, 0, "assistant", []), (3, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    turns = chat.format_turns(df, "content")
    first = turns.filter("conv_id = 1 and turn = 0").first()
    assert first["formatted"] == "### user: see \\<|image 0|> <|image 0|><|audio 1|><|document 2|></turn>\n"
    assert [(a["position"], a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [(0, "image", "a.png", 200), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 1536)]
    got = {r["conv_id"]: (r["n_turns"], r["n_attachments"], r["attachment_tokens"], r["loss_chars"]) for r in chat.read_back(turns).collect()}
    assert got == {1: (2, 3, 200 + 63 + 1536, 2), 2: (1, 0, 0, 0), 3: (1, 0, 0, 0)}
    with pytest.raises(Exception, match="disagree"):
        chat.read_back(turns.withColumn("attachments", F.slice("attachments", 1, 2))).collect()


def test_json_contents(spark):
    parts = json.dumps([{"type": "text", "text": "a"}, {"type": "image", "ref": "r"}])
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", "[no json")], "conv_id long, turn long, role string, text string")
    got = chat.format_turns(df, json_parts=True).sort("turn").collect()
    assert [len(r["attachments"]) for r in got] == [1, 0] and got[0]["formatted"] == "### user: a<|image 0|></turn>\n"
    assert chat.format_turns(df).filter("size(attachments) > 0").count() == 0


# ---- archives


def test_archive(spark, tmp_path):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "u1", big), (5, "u2\r\nX: y", big), (3, None, big), (7, "u3", "small"), (8, "u4", "small"), (9, "u5", None), (10, "u6", ""), (None, "u7", other), (11, "u8", other), (12, "u9", "q" * 200_000), (12, "u9", "q" * 200_000), (None, "v", "only null" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha256", "id", "payload", "header")})
    archive = warc.write(df)
    got = sorted((str(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(spark, archive).collect())
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = last.get(h or "")
        again = len(body) >= 1000 and i != first
        want.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want)
    assert warc.payloads(spark, archive).count() == len({h or "" for _, _, h in rows})
    whole = {(r["id"], bytes(r["record"])) for r in warc.reconstruct(spark, archive).collect()}
    record = next(x for i, x in whole if i == 12)
    head, _, rest = record.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 200000" in head and rest == b"q" * 200_000 + b"\r\n\r\n"
    assert next(x for i, x in whole if i == 1).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert b"u2%0D%0AX: y" in next(x for i, x in whole if i == 5)
    ids = [warc.fields(bytes(r["record"]))["WARC-Record-ID"] for r in warc.reconstruct(spark, archive).collect()]
    assert len(set(ids)) == len(rows)
    by_id = {warc.fields(x)["WARC-Record-ID"]: i for i, x in whole}
    assert all(by_id[warc.fields(x)["WARC-Refers-To"]] == int(warc.fields(x)["X-Refers-To-Page-ID"]) for _, x in whole if b"WARC-Type: revisit" in x)
    file = b"".join(bytes(r["member"]) for r in warc.members(spark, archive).collect())
    assert sorted(gzip.decompress(file)) == sorted(b"".join(x for _, x in whole))


def test_hot_payloads_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("loglens.llm._common.HOT_ROWS", 3)
    df = spark.range(100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 70, F.lit("same" * 300)).when(F.col("id") < 90, "").otherwise(F.col("id").cast("string")).alias("html"))
    got = warc.read(spark, warc.write(df)).toPandas()
    assert len(got) == 100 and sorted(got["id"]) == list(range(100))
    assert (got[got["id"] < 69]["refers_to"] == 69).all() and (got[got["id"] >= 69]["record_type"] == "response").all()


def test_archive_notices_damage(spark):
    archive = warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"))
    spark.createDataFrame([("0" * 64, bytearray(zstandard.compress(b"abc")), 1)], "sha256 string, packed binary, records long").write.mode("append").parquet(archive.payloads)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.payloads(spark, archive).collect()


def test_empty_archive(spark):
    archive = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(spark, archive).count() == 0


# ---- fingerprints

MASK, BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def plain_fingerprint(text: bytes) -> str:
    """Byte by byte."""
    if not text:
        return "0::"
    padded = b"\0" * 7 + text
    level = []
    for i in range(len(text)):
        h = mix(sum((padded[i + 7 - j] + 1) * pow(BASE, j, 1 << 64) for j in range(7)) & MASK)
        level.append(len(re.search("1*$", bin(h)[2:].zfill(64))[0]))
    k = 0 if len(text) <= 64 else next(k for k in range(1, 64) if sum(x >= k for x in level[:-1]) < 64)

    def signature(k):
        out, h, start = "", 0, 0
        for i, byte in enumerate(text):
            h = h + int(_BYTE[byte]) * pow(BASE, i - start, 1 << 64) & MASK
            if level[i] >= k or i == len(text) - 1:
                out += chr(fingerprint.ALPHABET[mix(h + i - start + 1 & MASK) >> 58])
                h, start = 0, i + 1
        return out

    return f"{k}:{signature(k)}:{signature(k + 1)}"


def plain_likeness(a, b):
    (i, *x), (j, *y) = ((int(p[0]), p[1], p[2]) for p in (a.split(":"), b.split(":")))
    if abs(i - j) > 1:
        return 0.0
    u, v = (x[0], y[0]) if i == j else (x[0], y[1]) if i > j else (x[1], y[0])
    row = list(range(len(v) + 1))
    for c, p in enumerate(u, 1):
        old, row[0] = row[0], c
        for d, q in enumerate(v, 1):
            old, row[d] = row[d], old if p == q else 1 + min(row[d], row[d - 1])
    if not u and not v:
        return 1.0
    like = 1 - row[-1] / (len(u) + len(v))
    long = len(u) >= 8 and len(v) >= 8 and 0 < like < 1
    return 0.0 if long and not any(u[k : k + 4] in v for k in range(len(u) - 3)) else like


def test_fingerprints_like_the_plain_version():
    rng = random.Random(11)
    texts = [b"", b"a", "größe".encode(), b"same" * 100, b"\0" * 90] + [bytes(rng.randrange(97, 105) for _ in range(n)) for n in (5, 63, 64, 65, 66, 300, 900, 900)]
    texts.append(texts[-1][:700] + b"changed end" + texts[-1][711:])
    got = fingerprint.fingerprints(texts)
    assert got == [plain_fingerprint(t) for t in texts] == [fingerprint.fingerprints([t])[0] for t in texts]
    pairs = [(a, b) for a in got for b in got]
    assert list(fingerprint.likeness(*zip(*pairs, strict=True))) == pytest.approx([plain_likeness(a, b) for a, b in pairs])
    assert fingerprint.likeness([got[-1]], [got[-2]])[0] > 0.6 and fingerprint.fingerprints([]) == []


def plain_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, f = t or "", f or ""
        e = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("clash", [False, True])
def test_edits_of_odd_documents(spark, clash):
    df = documents(spark, clash=clash)
    got = fingerprint.fingerprint_edits(df).toPandas()
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    ids = [str(int(i)) if pd.notna(i) else "None" for i in got["doc_id"]]
    assert sorted(zip(ids, got["n_chars"], got["edited_sha256"], strict=True)) == plain_edits(rows)
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()


def test_edits_over_many_parts(spark):
    rows = [(i * 7 % 1000, f"text {i} " * (i % 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = fingerprint.fingerprint_edits(df, part_bytes=2000).toPandas()
    assert sorted(zip(got["doc_id"].astype(str), got["n_chars"], got["edited_sha256"], strict=True)) == plain_edits(rows)
    pairs = {(f, e): n for f, e, n in zip(got["fingerprint"], got["edited_fingerprint"], got["near_edited"], strict=True)}
    assert all(abs(n - plain_likeness(f, e)) < 1e-9 for (f, e), n in list(pairs.items())[:200])
    following = dict(zip((r[0] for r in sorted(rows)), (r[1] for r in sorted(rows)[1:] + sorted(rows)[:1]), strict=True))
    for r in got.itertuples():
        assert abs(r.near_next - plain_likeness(r.fingerprint, plain_fingerprint(following[r.doc_id].encode()))) < 1e-9
    one = fingerprint.fingerprint_edits(df.limit(1)).toPandas()
    assert len(one) == 1 and one["near_next"][0] == 1
    assert fingerprint.fingerprint_edits(df.limit(0)).count() == 0


def test_parts_follow_bytes_and_split_one_id(spark):
    df = spark.range(3000).select(F.lit(5).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sizes = [r["count"] for r in fingerprint.with_next(df, "doc_id", "text", part_bytes=2000).filter("not last").groupBy("part").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 10 and max(sizes) < 900
    few = fingerprint.with_next(df, "doc_id", "text").select("part").distinct().count()
    assert few == 1


# ---- decontamination


def edit_distance_within(item: bytes, text: bytes) -> int:
    """Least number of edits that make the item a part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(item, 1):
        old, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            old, row[j] = row[j], min(old + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edited_item(rng, item: str, edits: int) -> str:
    own = list(item)
    for _ in range(edits):
        k = rng.randrange(len(own))
        kind = rng.random()
        if kind < 0.4:
            own[k] = rng.choice("abcdefgh")
        elif kind < 0.7:
            del own[k]
        else:
            own.insert(k, rng.choice("abcdefgh"))
    return "".join(own)


def test_leaks_like_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randint(9, 30)).capitalize() + ".") for i in range(12)]
    texts = []
    for k in range(80):
        i, item = rng.choice(items)
        m = len(item)
        planted = edited_item(rng, item, rng.choice([0, 0, m // 20, m // 10 - 1, m // 10, m // 8, m // 5])) if k % 4 else ""
        texts.append((k, f"{prose(rng.randint(0, 40))} {planted}\n{prose(rng.randint(0, 40))}"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], x["item_id"]): x for r in decontam.mark_leaks(docs, bench).collect() for x in r["leaks"]}
    own = {i: decontam.normalise(t) for i, t in items}
    for k, t in texts:
        text = decontam.normalise(t)
        for i, item in own.items():
            d = edit_distance_within(item, text)
            x = got.get((k, i))
            assert (x is not None and x["share"] == 1) == (d <= int(len(item) * decontam.RATE)), (k, i, d, len(item))
            if x and x["share"] < 1:
                windows = [item[a : a + decontam.WINDOW] for a in [*range(0, len(item) - decontam.WINDOW, decontam.STEP), len(item) - decontam.WINDOW]]
                best = min(edit_distance_within(w, text) for w in windows)
                assert x["edits"] == best <= int(decontam.WINDOW * decontam.RATE) and x["share"] == decontam.WINDOW / len(item)
            elif x:
                assert x["edits"] == d and edit_distance_within(text[x["start"] : x["start"] + x["length"]], item) <= 2 * d
    small = decontam.mark_leaks(docs, bench, block_bytes=200)
    assert {(r["doc_id"], x["item_id"], x["edits"]) for r in small.collect() for x in r["leaks"]} == {(k, i, x["edits"]) for (k, i), x in got.items()}


def test_many_blocks_and_common_grams(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(30)]
    stem = "which of the following answers is the best one to give here "
    items = [(i if i else None, stem + " ".join(rng.choice(words) for _ in range(12))) for i in range(8)] + [(90, "short one")]
    texts = [" ".join([rng.choice(words) for _ in range(40)] + ([edited_item(rng, items[i][1], i % 3)] if i % 3 else []) + [rng.choice(words) for _ in range(150 * (i == 5) + 20)]) for i in range(8)] + [stem * 2, "a short one here", None]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _row long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: r["leaks"] for r in decontam.mark_leaks(docs, bench).collect()}
    assert any(whole.values()) and len(whole) == len(texts)
    parts = decontam.mark_leaks(docs, bench, block_bytes=400)
    assert parts.columns == ["doc_id", "text", "_row", "leaks"] and {r["doc_id"]: r["leaks"] for r in parts.collect()} == whole
    index = decontam.Index([i for i, _ in items], [decontam.normalise(t) for _, t in items])
    own = [decontam.normalise(t) for t in texts]
    want = index.search(own)
    monkeypatch.setattr(decontam, "MOST_HITS", 400)
    again = decontam.Index(index.ids, index.texts).search(own)
    assert [[(x["item_id"], x["edits"], x["share"]) for x in r] for r in again] == [[(x["item_id"], x["edits"], x["share"]) for x in r] for r in want]


def test_leaks_in_odd_documents(spark):
    item = "This is the passage of a benchmark, which nobody should train on."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (None, item.upper()), (5, "another passage that is nowhere to be found in here")], "item_id long, text string")
    rows = [*odd_documents(), (50, f"x {item.replace(' ', chr(10))} y", "en", "s", 1), (51, "y" * 300_000 + item, "en", "s", 1), (51, "y" * 300_000 + item, "en", "s", 1), (52, item[:50], "en", "s", 1)]
    docs = spark.createDataFrame(rows, documents(spark, []).schema).withColumns({c: F.lit(1) for c in CLASHES if c != "leaks"})
    out = decontam.mark_leaks(docs, bench)
    assert out.columns == [*docs.columns, "leaks"]
    got = [(r["doc_id"], [(x["item_id"], x["edits"]) for x in r["leaks"]]) for r in out.collect() if r["leaks"]]
    assert sorted(got) == [(50, [(1, 0), (None, 0)]), (51, [(1, 0), (None, 0)]), (51, [(1, 0), (None, 0)])]
    assert decontam.mark_leaks(docs.limit(0), bench).count() == 0
    assert decontam.mark_leaks(docs, bench.limit(0)).filter(F.size("leaks") > 0).count() == 0


def test_leaked_parts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(80)
    docs = [(0, prose(50)), (1, f"{prose(30)} {item[40:40 + decontam.WINDOW + decontam.STEP]} {prose(30)}"), (2, f"{prose(30)} {item[-140:]}"), (3, item[10:70]), (4, f"{item[:100].upper()} {prose(9)}"), (5, item)]
    out = decontam.mark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    got = {r["doc_id"]: r["leaks"][0]["share"] for r in out.collect() if r["leaks"]}
    assert got == {1: decontam.WINDOW / len(item), 2: decontam.WINDOW / len(item), 4: decontam.WINDOW / len(item), 5: 1.0}


def test_leaked_parts_from_every_place():
    rng = random.Random(16)
    item = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(50)).encode()
    index = decontam.Index([9], [item])
    n = decontam.WINDOW
    assert n <= 72
    for a in range(0, len(item) - n + 1):
        copied = item[a : a + n]
        changed = copied[:30] + b"#" + copied[31:50] + copied[52:]
        got = [x[0] for x in index.search([b"before it " + copied + b" and after", b"before it " + changed + b" and after"])]
        assert got[0]["edits"] == 0 and 0 < got[1]["edits"] <= 3 and got[0]["share"] == n / len(item), a


def test_short_items_are_searched_exactly(spark):
    items = [(1, "To be?"), (2, "x"), (3, "a phrase of under 32 bytes"), (4, "\u4f60\u597d"), (5, "  "), (None, "X")]
    docs = [(0, "said: to  be? yes"), (1, "unto be? box"), (2, "an x."), (3, "A phrase of\nunder 32 bytes"), (4, "a phrase of under 33 bytes"), (5, "\u55ef\u4f60\u597d\u5417"), (6, None), (7, "caf\u00e9x")]
    out = decontam.mark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: [(x["item_id"], x["edits"], x["start"], x["length"], x["share"]) for x in r["leaks"]] for r in out.collect() if r["leaks"]}
    assert got == {0: [(1, 0, 6, 6, 1.0)], 2: [(2, 0, 3, 1, 1.0), (None, 0, 3, 1, 1.0)], 3: [(3, 0, 0, 26, 1.0)], 5: [(4, 0, 3, 6, 1.0)]}


def test_alignment_stays_in_its_band():
    rng = random.Random(2)
    for _ in range(200):
        item = bytes(rng.randrange(97, 101) for _ in range(rng.randint(5, 25)))
        text = bytes(rng.randrange(97, 101) for _ in range(rng.randint(0, 40)))
        d = edit_distance_within(item, text)
        got = decontam.align(item, text, -len(item), len(text), len(item))
        assert got and got[0] == d
        assert decontam.align(item, text, -len(item), len(text), d - 1) is None
        assert decontam.stands(item, text, d) and not decontam.stands(item, text, d - 1)


def test_queries_with_odd_tables(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (1, "u", "x")], "page_id long, url string, html string")
    talks = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    path = folder(spark, tmp_path, documents=documents(spark), pages=pages, conversations=talks)
    rows = {n: queries.queries()[n](spark, path).count() for n in ("op3_licenses", "op6_jaccard", "op7_chat", "op8_warc", "op9_fingerprint", "op10_decontaminate")}
    assert rows == {"op3_licenses": 0, "op6_jaccard": len(odd_documents()), "op7_chat": 2, "op8_warc": 2, "op9_fingerprint": len(odd_documents()), "op10_decontaminate": 0}

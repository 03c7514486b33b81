"""Operators 3, 6, 8 and 10: exact results on odd texts, round trips and SQL."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pointwright.llm import fingerprints, license_scan, queries, ranges, sentencepiece_codec, token_files
from pointwright.llm.words import Words

from .conftest import DOCS, SMALL, odd_rows, words

BPE, PIECES = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("ab Z'.7\n\t\r 　é日🙂\u0085 <|")), max_size=30), max_size=8)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()))
    assert [[w.text(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [words(t) for t in texts]
    h = w.hashes()
    seen = {}
    assert all(seen.setdefault(w.text(i), h[i]) == h[i] for i in range(len(w))) and len(set(seen.values())) == len(seen)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_library(texts):
    e = token_files.encoder(BPE)
    ids, off = e.encode(pa.array([*texts, "<|endoftext|> x"], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == e.plain([*texts, "<|endoftext|> x"])


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 2)
    e = token_files.Encoder(BPE)
    for texts in (["alpha beta gamma"], ["delta beta"], ["alpha"]):
        ids, _ = e.encode(pa.array(texts))
        assert ids.tolist() == e.plain(texts)[0]


def test_token_files_round_trip(spark, odd, clashing, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    e = token_files.encoder(BPE)
    rows = sorted((r[0], r[1] or "") for r in odd_rows() if r[0] is not None)
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*e.plain([t])[0], 2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    for k, df in enumerate((odd, clashing)):
        path = f"file://{tmp_path}/t{k}"
        token_files.write(df, path, BPE)
        assert [tuple(r) for r in token_files.read(spark, path).orderBy("start").collect()] == want
    d = spark.read.parquet(f"{path}/dictionary").first()
    block = next(b.asDict() for b in spark.read.parquet(f"{path}/blocks").collect() if 11 in np.frombuffer(b.doc_ids, dtype="<i8"))
    assert token_files.document(block, 11, bytes(d.dictionary), d.width).tolist() == next(w[4] for w in want if w[0] == 11)
    with pytest.raises(ValueError):
        token_files.document(block, 11, b"other", d.width)
    with pytest.raises(KeyError):
        token_files.document(block, -5, bytes(d.dictionary), d.width)
    token_files.write(none, f"file://{tmp_path}/none", BPE)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def test_sentencepiece_equals_the_library(odd, clashing, none):
    sp = sentencepiece_codec.codec(PIECES).sp
    for df in (odd, clashing):
        got = sentencepiece_codec.encode(df, PIECES, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), keep=("doc_id", "text")).collect()
        assert len(got) == len(odd_rows())
        for r in got:
            ids = sp.encode(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (sp.decode(ids) if ids else "")
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece_codec.encode(none, PIECES).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_codec.encode(odd.withColumnRenamed("lang", "ids"), PIECES, keep=("ids",))


def test_decode(spark):
    sp = sentencepiece_codec.codec(PIECES).sp
    df = spark.createDataFrame([(1, sp.encode("over the hills")), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in sentencepiece_codec.decode(df, PIECES).collect()} == {1: "over the hills", 2: "", 3: ""}


@given(st.text(alphabet=st.sampled_from(list("ab  .é日🙂\n ▁")), max_size=40))
@settings(max_examples=200, deadline=None)
def test_piece_spans_cover_the_text(text):
    c = sentencepiece_codec.codec(PIECES)
    ids = c.encode([text])[0]
    spans = c.spans(text, ids)
    assert all(a <= b for a, b in spans) and all(p[1] <= q[1] for p, q in zip(spans, spans[1:], strict=False))
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in spans) == raw  # the identity map: pieces tile the source


def test_spans_of_many_texts_are_those_of_each(monkeypatch):
    """Running sums give them without reading the texts; only texts that hold the mark itself are read."""
    c = sentencepiece_codec.codec(PIECES)
    texts = ["", " ", "over the hills", "  two  spaces ", "a\nb \0 c", "日本 語 🙂", "a▁ b", "▁", "<s> </s>"]
    ids = c.encode(texts)
    flat = np.array([i for x in ids for i in x], dtype=np.int32)
    want, read, bounds = [c.spans(t, x) for t, x in zip(texts, ids, strict=True)], [], c.bounds
    monkeypatch.setattr(c, "bounds", lambda t, x: (read.append(t), bounds(t, x))[1])
    assert [[tuple(p) for p in b.tolist()] for b in c.all_bounds(texts, ids, flat)] == want
    assert set(read) == {"", "a▁ b", "▁"}


def test_the_query_and_the_pipeline_take_spans(spark, odd):
    """Their digests are of spans that cover each text from end to end."""
    c = sentencepiece_codec.codec(PIECES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = {}
    for i, t in texts.items():
        spans = c.spans(t, c.encode([t])[0])
        assert b"".join(t.encode()[a:b] for a, b in spans) == t.encode()
        want[i] = hashlib.sha256(b"".join(x.to_bytes(8, "little") for pair in spans for x in pair)).hexdigest()
    assert {r.doc_id: r.spans_sha256 for r in queries.op8_sentencepiece(spark, SMALL).collect()} == want
    assert "spans_sha256" in corpus_pipeline.encoded(spark, odd, SMALL).columns


def trie(keys):
    """A double array for single-byte keys: byte -> offset of its replacement."""
    units = [0] * 1024
    units[0] = 1 << 10  # children of the root at 1 ^ byte
    for byte, value in keys.items():
        at = 1 ^ byte
        base = 512 + 2 * byte  # a leaf's value stands at at ^ offset
        units[at] = byte | 1 << 8 | (base ^ 0) << 10
        units[at ^ base] = value | 1 << 31
    return np.array(units, dtype="<u4").tobytes()


def test_character_map_records_its_source():
    body = trie({ord("A"): 0, ord("!"): 2})
    m = sentencepiece_codec.CharacterMap(len(body).to_bytes(4, "little") + body + b"a\0??\0")
    text, source = m.normalise("bA!é".encode())
    assert text == "ba??é".encode() and source.tolist() == [0, 1, 2, 2, 3, 4, 5]
    assert m.longest(b"zz", 0) is None


BSD = """{0}Copyright (c) 2019, Some Body
{0}All rights reserved.
{0}
{0}Redistribution and use in source and binary forms, with or without
{0}modification, are permitted provided that the following conditions are met:
{0}
{0}{1}Redistributions of source code must retain the above copyright notice, this
{0}   list of conditions and the following disclaimer.
{0}
{0}{2}Redistributions in binary form must reproduce the above copyright notice,
{0}   this list of conditions and the following disclaimer in the documentation
{0}   and/or other materials provided with the distribution.
"""
BSD_3 = """{0}
{0}{3}Neither the name of the copyright holder nor the names of its
{0}   contributors may be used to endorse or promote products derived from
{0}   this software without specific prior written permission.
"""
AS_IS = """{0}
{0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
{0}AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """{0}Licensed under the Apache License, Version 2.0 (the "License");
{0}you may not use this file except in compliance with the License.
{0}You may obtain a copy of the License at
{0}
{0}    http://www.apache.org/licenses/LICENSE-2.0
{0}
{0}Unless required by applicable law or agreed to in writing, software
{0}distributed under the License is distributed on an "AS IS" BASIS,
{0}WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
{0}See the License for the specific language governing permissions and
{0}limitations under the License.
"""
MIT = """{0}Permission is hereby granted, free of charge, to any person obtaining a copy
{0}of this software and associated documentation files (the "Software"), to deal
{0}in the Software without restriction, including without limitation the rights
{0}to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
{0}copies of the Software, and to permit persons to whom the Software is
{0}furnished to do so, subject to the following conditions:
{0}
{0}The above copyright notice and this permission notice shall be included in all
{0}copies or substantial portions of the Software.
{0}
{0}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
{0}IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
{0}FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
{0}AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
GNU = """{0}This {1} is free software{2} you can redistribute it and/or modify
{0}it under the terms of the GNU {3}General Public License as published by
{0}the Free Software Foundation{4} either version {5} of the License, or
{0}(at your option) any later version.
{0}
{0}This {1} is distributed in the hope that it will be useful,
{0}but WITHOUT ANY WARRANTY; without even the implied warranty of
{0}MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{0}GNU {3}General Public License for more details.
"""
ZLIB = """{0}This software is provided 'as-is', without any express or implied
{0}warranty.  In no event will the authors be held liable for any damages
{0}arising from the use of this software.
{0}
{0}Permission is granted to anyone to use this software for any purpose,
{0}including commercial applications, and to alter it and redistribute it
{0}freely, subject to the following restrictions:
"""
UNLICENSE = """{0}This is free and unencumbered software released into the public domain.
{0}
{0}Anyone is free to copy, modify, publish, use, compile, sell, or
{0}distribute this software, either in source code form or as a compiled
{0}binary, for any purpose, commercial or non-commercial, and by any
{0}means.
"""
MPL = """{0}This Source Code Form is subject to the terms of the Mozilla Public
{0}License, v. {1}. If a copy of the MPL was not distributed with this
{0}file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
NOTICES = [
    (BSD + AS_IS, ("1. ", "2. "), "BSD-2-Clause"), (BSD + BSD_3 + AS_IS, ("1. ", "2. ", "3. "), "BSD-3-Clause"), (BSD + BSD_3 + AS_IS, ("* ", "* ", "* "), "BSD-3-Clause"), (BSD + BSD_3 + AS_IS, ("(a) ", "(b) ", "(c) "), "BSD-3-Clause"),
    (APACHE, (), "Apache-2.0"), (MIT, (), "MIT"), (ZLIB, (), "Zlib"), (UNLICENSE, (), "Unlicense"), (MPL, ("2.0",), "MPL-2.0"), (MPL, ("1.1",), ""),
    (GNU, ("program", ":", "", ",", "3"), "GPL-3.0-or-later"), (GNU, ("program", ";", "", ";", "2"), "GPL-2.0-or-later"), (GNU, ("program", ":", "Affero ", ",", "3"), "AGPL-3.0-or-later"), (GNU, ("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1-or-later"),
    (APACHE.replace("See the License", "Something else stands here. See the License"), (), "Apache-2.0"), (APACHE.replace("You may obtain", "You cannot obtain"), (), ""),
]


def matched(text):
    """Licences of a text by another way: its words (without marks that lead lines) hold the words of a rule's sentences, in order; longer rules take theirs first."""
    lines = [re.sub(r"^\s*(/\*+|\*+/|\*+|//+!?|#+|;+|--+|%+|>+|<!--|dnl\s|rem\s)?[ \t]*((\(?[0-9]{1,2}[.)]|\(?[a-z]\)|-|•)[ \t]+)?", "", x) for x in (text or "").lower().splitlines()]
    body = " " + " ".join(re.findall("[a-z0-9]+", "\n".join(lines))) + " "
    rules = [(name, [" " + " ".join(re.findall("[a-z0-9]+", license_scan.SENTENCES[i].lower())) + " " for i in ids]) for name, ids in license_scan.RULES]
    found = set()
    for name, sentences in sorted(rules, key=lambda r: -sum(map(len, r[1]))):
        at, places = 0, []
        for s in sentences:
            at = body.find(s, at)
            if at < 0:
                break
            places.append((at, at + len(s)))
            at += len(s) - 1
        else:
            found.add(name)
            for a, b in places:
                body = body[:a] + " " + "?" * (b - a - 2) + " " + body[b:]
    return ",".join(sorted(found))


@pytest.mark.parametrize("leader", ["", " * ", "// ", "# ", "-- ", "    "])
def test_license_notices_as_published(spark, leader):
    """Whole notices, wrapped, numbered, bulleted and in comments, against words in order."""
    texts = [f.format(leader, *marks) for f, marks, _ in NOTICES] + ["Some text before.\n" + f.format(leader, *marks).replace("\n", "\r\n") + "int main()" for f, marks, _ in NOTICES]
    want = [w for _, _, w in NOTICES] * 2
    got = {r.doc_id: r.licenses for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    whole = len(NOTICES) - 1  # the last has half of a sentence, which words in order take for another
    assert [matched(t) for t in texts[:whole]] == want[:whole]


def test_licenses_of_the_documents_by_words_in_order(spark):
    df = queries.documents(spark, SMALL)
    text = {r.doc_id: r.text for r in df.collect()}
    got = license_scan.scan(df).collect()
    assert len(got) == len(text) and any(r.licenses for r in got) and all(r.licenses == matched(text[r.doc_id]) for r in got)


def test_license_rules(spark, none, clashing):
    s = license_scan.SENTENCES
    texts = {2: "x.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", 3: "no licence at all", 4: f"{s[9]}. {s[8]}.", 5: None, 6: "", 7: " ".join(f"{s[i]}." for i in (8, 9, 10, 11)), 8: "This work is LICENSED under the GNU General Public License,  version 3!", 9: " ".join(f"{s[i]}." for i in (16, 17, 18, 16, 17, 18, 19))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan(df).collect()}
    assert got == {2: "CC-BY-NC-4.0,MIT", 3: "", 4: "", 5: "", 6: "", 7: "Apache-2.0", 8: "GPL-3.0-only", 9: "BSD-2-Clause,BSD-3-Clause"}
    assert license_scan.scan(none).count() == 0 and license_scan.scan(clashing).count() == len(odd_rows())
    assert license_scan.scan(clashing, keep=("score", "n")).columns == ["doc_id", "score", "n", "n_known", "licenses", "n_licenses"]
    assert all(any(c in " ".join(license_scan._cut(s[ids[0]])) for c in license_scan.CUES) for _, ids in license_scan.RULES)


def test_spans_and_extensions_are_brute_force():
    rng = np.random.default_rng(1)
    points = rng.integers(97, 99, 300).astype("<u4")
    h = fingerprints.PrefixHashes(points)
    i, j = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    most = 300 - np.maximum(i, j)
    want = [next((k for k in range(m) if points[a + k] != points[b + k]), m) for a, b, m in zip(i, j, most, strict=True)]
    assert h.common_extension(i, j, most).tolist() == want
    assert all(h.equal(int(a), int(b), int(n)) for a, b, n in zip(i, j, want, strict=True))


def jaccard(a, b):
    s, t = ({x[i : i + 16] for i in range(len(x) - 15)} or ({x} if x else set()) for x in (a, b))
    return len(s & t) / len(s | t) if s | t else 1.0


def test_next_document_is_brute_force(spark, random_docs):
    rows, df = random_docs
    texts = dict(sorted((r[0], r[1]) for r in rows))
    ids = list(texts)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(df).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(t, edited)) < 0.3 and abs(r.near_next - jaccard(t, after)) < 0.3
        assert r.common_prefix == next((p for p in range(min(len(t), len(edited))) if t[p] != edited[p]), min(len(t), len(edited)))
    prints = {}
    for i in ids:
        assert prints.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_odd_rows(spark, odd, clashing, none):
    for df in (odd, clashing):
        got = fingerprints.compare_with_next(df).collect()
        assert len(got) == len([r for r in odd_rows() if r[0] is not None])
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compare_with_next(none).count() == 0
    one = fingerprints.compare_with_next(odd.where("doc_id = 11")).first()
    assert one.near_next == 1.0
    assert fingerprints.fingerprint(clashing).count() == len(odd_rows())


def test_ranges_hold_every_id_once_and_are_even(spark):
    rng = np.random.default_rng(5)
    spread = rng.choice(1 << 40, 4000, replace=False) - (1 << 39)
    ids = np.concatenate((spread, np.full(2000, 77)))  # a third of the rows have one id
    df = spark.createDataFrame([(int(i),) for i in ids] + [(None,)], "doc_id long").repartition(6)
    firsts = ranges.first_ids(df, "doc_id", 16)
    assert firsts == sorted(set(firsts)) and firsts[0] == ids.min() and set(firsts) <= set(ids.tolist()) and 8 <= len(firsts) <= 16
    part = ranges.range_of(ids, np.array(firsts))
    assert part.min() == 0 and part.max() == len(firsts) - 1
    assert np.bincount(ranges.range_of(spread, np.array(firsts))).max() < 1000
    own = df.where("doc_id is not null").withColumn("part", ranges.part_of(df, F.col("doc_id"), firsts)).collect()
    assert all(r.part == sum(f <= r.doc_id for f in firsts) - 1 for r in own) and len(own) == len(ids)
    assert ranges.first_ids(df.limit(0), "doc_id", 16) == []

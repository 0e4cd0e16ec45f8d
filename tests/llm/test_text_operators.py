"""Pieces, quality, mixing, secrets, passages, licences against libraries, held-out rows and brute force."""

import re
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tesselon.llm import licences, mixing, pieces, quality, secrets
from tesselon.llm.entries import PIECES, op4_mixing, op9_quality_classifier
from tesselon.llm.pieces import Normaliser, PieceTransducer, with_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    with open(PIECES, "rb") as f:
        return PieceTransducer(f.read())


def test_pieces_equal_the_library(spark, coder):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = ["", " ", "  a", "a  b   c    d ", "\n", "\n\n  x\n y \n", "é😀　x▁y", "\t\x00 a", "日本語 テスト", "<s> </s> <0x41>", "a" * 300, "x " * 50, "▁▁▁", " " * 40 + "z", "A" * 3000]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        ids = coder.encode(t)
        assert ids == lib.encode(t), repr(t[:60])
        assert coder.decode(ids) == lib.decode(ids)


def test_little_is_kept_and_ids_stay_equal(spark, monkeypatch):
    for name, most in (("KNOWN_WORDS", 40), ("KNOWN_PARTS", 20), ("KNOWN_PAIRS", 30)):
        monkeypatch.setattr(pieces, name, most)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as f:
        few = PieceTransducer(f.read())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in [*texts, *texts[:20]]:
        assert few.encode(t) == lib.encode(t), repr(t[:60])
    for known, most in [*((w, 40) for w in few.words), (few.parts, 20), (few.pairs, 30)]:
        assert len(known) <= most and len(known.older) <= most
    assert {type(x) for w in few.words for x in w.values()} == {bytes}


def test_pieces_are_the_only_path_that_holds_together(coder):
    """Brute force over all segmentations: exactly one has neighbours that all hold together."""

    def ways(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in coder.ids or k == 1:
                for rest in ways(s[k:]):
                    yield [s[:k], *rest]

    for word in ("▁hello", "▁ration", "▁thing", "banana", "▁▁▁x", "ß★"):
        fit = [w for w in ways(word) if all(coder.hold_together(a, b) for a, b in zip(["", *w], w))]
        assert fit == [[arc.piece for arc in coder.bpe_path(word)]]


def field(n, kind, raw):
    size, lead = len(raw), b""
    while size > 127:
        lead, size = lead + bytes([size & 127 | 128]), size >> 7
    return bytes([n << 3 | kind]) + (lead + bytes([size]) + raw if kind == 2 else raw)


def piece(text, score, kind=1):
    return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))


def model_of(pieces, kind, normaliser):
    """A model of the given pieces behind unknown and control pieces."""
    return piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + b"".join(pieces) + field(2, 2, field(3, 0, bytes([kind]))) + normaliser


PLAIN = field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
SQUEEZED = field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x01"))
BYTES = [piece(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
UNITS = [("▁", -2.1), ("▁a", -3.2), ("a", -3.7), ("b", -4.1), ("ab", -5.3), ("▁ab", -6.9), ("bc", -5.9), ("c", -4.4), ("▁the", -3.3), ("the", -5.1), ("1", -4.7), ("fi", -5.6), ("f", -6.1), ("i", -4.9), ("é", -7.3), ("カ", -8.3), ("ガ", -7.9), ("...", -6.6), (".", -4.2), ("▁▁", -4.0)]
ODD_TEXTS = ["", " ", "   ", "abc", " the  abc ", "ﬁabc① the…", "the\u3000\u00a0abc\tc", "a\r\nb\n\nc ", "e\u0301a", "\u30ab\u3099b ｶﾞ", "\u00a8a \u00a8", "zz★ the zé★★", "a▁b ▁c▁", "\u200ba\u00adb\x01c", "ab" * 40, "１２ ab", "日本語 ab", "<s> ab"]


def test_unigram_model_takes_the_cheapest_path():
    t = PieceTransducer(model_of([piece(p, s) for p, s in (("▁a", -1.0), ("b", -1.0), ("▁ab", -2.5), ("bc", -0.2), ("▁", -3.0))], 1, PLAIN))
    assert t.encode("abc") == [2, 5]
    assert t.encode("ab") == [2, 3]
    assert t.encode("az") == [2, 0]


@pytest.mark.parametrize("rules", [None, "nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("with_bytes", [True, False])
def test_normaliser_and_pieces_equal_the_library(rules, with_bytes):
    """Unigram models with and without a character map and byte fallback: composed paths equal the library's encodings."""
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto() if rules else SQUEEZED
    extra = [piece("[X]", 0.0, 4)] + (BYTES if with_bytes else [])
    kind = field(2, 2, field(3, 0, b"\x01") + (bytes([35 << 3 & 127 | 128, 35 >> 4]) + b"\x01" if with_bytes else b""))
    model = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + b"".join([piece(p, s) for p, s in UNITS] + extra) + kind + normaliser
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=model), PieceTransducer(model)
    for text in [*ODD_TEXTS, "the[X]abc [X] a[X"]:
        assert own.encode(text) == lib.encode(text), repr(text)


def test_a_rule_over_a_space_keeps_the_text_whole():
    own = Normaliser({"a b": "c", "ab": "d", "\t": " "}, ["abx"], True, True)
    assert own.run("xa babab\t \tabx ") == ("▁xcdd▁abx", 2)  # the longest rule; spaces squeezed, the last one owed


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert with_pieces(docs, PIECES).where("not round_trip").count() == 0


def test_hashed_features_do_not_depend_on_company():
    texts = ["one two  two", "", "Three,\nfour", " x ", "\xe9t\xe9 99 \u65e5\u672c"]
    ids, docs = quality.hashed_features(texts)
    for i, t in enumerate(texts):
        own, _ = quality.hashed_features([t])
        assert sorted(own.tolist()) == sorted(ids[docs == i].tolist())


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    share, rows, out, bias = rng.dirichlet(np.ones(5)), rng.standard_normal((5, 4)), rng.standard_normal((2, 4)), rng.standard_normal(2)

    def loss(rows, out, bias):
        logit = out @ (share @ rows) + bias
        return np.log(np.exp(logit).sum()) - logit[1]

    found = quality.gradients(share, rows, out, bias, 1)
    for k, grad in enumerate(found):
        for at in np.ndindex(grad.shape):
            moved = [[x.copy() for x in (rows, out, bias)] for _ in range(2)]
            moved[0][k][at] += 1e-5
            moved[1][k][at] -= 1e-5
            assert abs((loss(*moved[0]) - loss(*moved[1])) / 2e-5 - grad[at]) < 1e-6


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["red", "blue", "green"] if k % 2 else ["one", "two", "three"], 12)) for k in range(60)]
    score = quality.score_texts(texts, quality.train(quality.shares(texts), [k % 2 for k in range(60)]))
    assert (score[1::2] > 0.7).all() and (score[::2] < 0.3).all()


def test_quality_bounds_what_one_task_gets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    whole, few = quality.fit_quality(docs, labels), quality.fit_quality(docs, labels, most_features=2000)
    assert len(whole) == len(few) and (whole != few).any()


def test_quality_on_held_out_rows(spark):
    rows = op9_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_never_sees_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit_quality(docs, labels) == quality.fit_quality(docs, flipped)).all()


def test_rates_meet_the_targets(spark):
    rows = op4_mixing(spark, "/root/testdata/sf0.01").collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    p = np.array([[r[f"p_{k}"] for k in range(4)] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1)
    share = (tokens * rate) @ p / tokens.sum()
    assert np.allclose(share, [0.2, 0.4, 0.2, 0.2], atol=1e-4)


def test_posteriors_by_hand(spark):
    import re as _re

    import xxhash

    domains, buckets = ["a", "b"], 64
    texts = {1: "red red Green, blue", 2: "blue blue sky", 3: "rare words only here", 4: "red sky unknownword", 5: "", 6: None, 7: "zzz"}
    labels = {1: "a", 2: "b", 3: "a", 9: "b"}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    model = mixing.domain_model(docs, spark.createDataFrame(sorted(labels.items()), "doc_id long, domain string"), domains, buckets)

    def words(t):
        return [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in _re.split(r"\W+", (t or "").lower()) if w]

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    count = {}
    for i, d in labels.items():
        for h in words(texts.get(i)):
            count.setdefault(signed(h) % buckets, [0, 0])[domains.index(d)] += 1
    total = [sum(c[k] for c in count.values()) for k in range(2)]
    logs = {b: [np.log((c[k] + 1) / (total[k] + len(count) + 1)) for k in range(2)] for b, c in count.items()}
    assert {r["bucket"]: (round(r["l_0"], 9), round(r["l_1"], 9)) for r in model.collect()} == {b: (round(x, 9), round(y, 9)) for b, (x, y) in logs.items()}
    for r in mixing.posteriors(docs, model, domains, buckets, 2.0).collect():
        known = [logs[signed(h) % buckets] for h in words(texts[r["doc_id"]]) if signed(h) % buckets in logs]
        mean = np.mean(known, axis=0) * min(2, len(known)) if known else np.zeros(2)
        want = np.exp(mean - mean.max())
        assert np.allclose([r["p_0"], r["p_1"]], want / want.sum()) and r["tokens"] == len(words(texts[r["doc_id"]]))


def test_unmet_targets_are_told_and_rates_repeat(spark):
    df = spark.createDataFrame([(1, 10, 1.0, 0.0), (2, 30, 1.0, 0.0)], "doc_id long, tokens long, p_0 double, p_1 double")
    with pytest.warns(UserWarning, match="unmet"):
        rates = mixing.fitted_rates(df, [20.0, 20.0]).collect()
    assert np.allclose([r["rate"] for r in rates], 0.5)
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7), (3, "d", 8)], "doc_id long, text string, _rate int")
    rates = spark.createDataFrame([(1, 3.0), (1, 2.0), (2, 0.0), (None, 2.0)], "doc_id long, rate double")
    got = sorted(r["text"] + str(r["_rate"]) for r in mixing.repeated(docs, rates).collect())
    assert got == ["a5", "a5", "a5", "b6", "c7", "c7", "d8"]


def test_rates_equal_projected_gradient_by_hand(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    tokens = rng.integers(0, 50, 300)
    targets = [tokens.sum() * v for v in (1.4, 0.1, 0.05)]
    df = spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p_0 double, p_1 double, p_2 double")
    got = {r["doc_id"]: r["rate"] for r in mixing.fitted_rates(df, targets, rounds=25).collect()}
    weigh = np.linalg.inv((p * tokens[:, None]).T @ p)
    rate = np.ones(300)
    for _ in range(25):
        gap = (tokens * rate) @ p - targets
        rate = np.maximum(0, rate - p @ (weigh @ gap))
    assert (rate == 0).any()
    assert np.allclose([got[i] for i in range(300)], rate, atol=1e-6)


def test_trigram_queries():
    assert secrets.trigram_query("abc(de|fg)") == [frozenset({"abc", "bcd", "cde"}), frozenset({"abc", "bcf", "cfg"})]
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("ab|abcd") is None
    assert secrets.trigram_query("x?abcd") == [frozenset({"abc", "bcd"})]
    assert secrets.trigram_query("ABC.*xyz") == [frozenset({"abc", "xyz"})]


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_matches_fulfil_their_query(rule):
    samples = {
        "assign": ["Password: abcdef", 'API_KEY"="x', "apikey=1", "tOkEn  :'zz"], "access": ["AKIA" + "A1" * 8], "hex": ["0a" * 12], "pem": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
        "forge": ["ghp_" + "a" * 36], "chat": ["xoxb-1234567890"], "jwt": ["eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10],
    }
    query = secrets.trigram_query(rule.regex)
    for s in samples[rule.kind]:
        assert re.search(rule.regex, s)
        assert query is None or any(all(t in s.lower() for t in clause) for clause in query)


def by_regex(text):
    found = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.regex, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def test_secrets_by_hand(spark):
    texts = [
        "token: token: abcdefgh", "token=api_key=abcdefgh", "😀 secret = abc123 then PASSWD:'zzzzzzz", "AKIA" + "A" * 20 + " AKIAshort", "x" + "0123456789abcdef" * 3, "ſecret = abcdefgh", "api key", "tok en", "Passwordpassword=abcdef",
        "ghp_" + "Z" * 40, "secret" * 50, "token = " + "ab" * 5000, "-----BEGIN EC PRIVATE KEY-----", "password=1\npassword=123456", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(df).collect()}
    assert got == {i: by_regex(t or "") for i, t in enumerate(texts)}


def test_redaction_merges_and_keeps_columns(spark):
    key = "token = " + "ab" * 20
    many = "".join(f"w{i} secret: abcdef{i} " for i in range(700))
    rows = [(1, key + " x", 1, 2), (2, key, 1, 2), (3, "é😀 " + key + "," + key, 1, 2), (4, many, 1, 2)]
    got = {r["doc_id"]: (r["text"], r["_rules"], r["_key"]) for r in secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string, _rules int, _key int")).collect()}
    assert got == {1: ("[SECRET] x", 1, 2), 2: ("[SECRET]", 1, 2), 3: ("é😀 [SECRET],[SECRET]", 1, 2), 4: ("".join(f"w{i} [SECRET] " for i in range(700)), 1, 2)}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token = abcdef1234567890abcdef1234 b AKIA" + "Q" * 16 + " c"), (2, "plain"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()} == {1: "a [SECRET] b [SECRET] c", 2: "plain", 3: None}


def test_licence_sequences(spark):
    s = licences.SENTENCES
    full = " ".join(s[f"mit-{k}"] for k in (1, 2, 3))
    rows = [(1, "Some text. " + full), (2, s["mit-1"]), (3, s["mit-2"] + " " + s["mit-1"]), (4, "x\nreleased   UNDER the MIT license\ny"), (5, s["apache2-short"] + "\n" + s["cc0-short"]), (6, s["gpl-1"] + " " + s["gpl-2"])]
    got = {r["doc_id"]: (r["licences"], r["n_matches"]) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("", 0), 3: ("", 0), 4: ("MIT", 1), 5: ("Apache-2.0,CC0-1.0", 2), 6: ("GPL-3.0-or-later", 1)}


WRAPPED = {
    "MIT": """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
    "GPL-3.0-or-later": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "BSD-2-Clause": "code\n// SPDX-License-Identifier: BSD-2-Clause\nint x;",
}


def test_wrapped_and_commented_licences(spark):
    names = sorted(WRAPPED)
    rows = [(k, f"int main()\n\n{WRAPPED[n]}\n\nint more;") for k, n in enumerate(names)] + [(100, "\n\n".join(WRAPPED[n] for n in ("MIT", "BSD-3-Clause"))), (100, "nothing"), (100, "nothing")]
    got = sorted((r["doc_id"], r["licences"], r["n_matches"]) for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([*((k, n, 1) for k, n in enumerate(names)), (100, "BSD-3-Clause,MIT", 2), (100, "", 0), (100, "", 0)])

"""Runs of periodic words against brute force, and the digest query against a plain reading of its rules."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import DATA

from tesselon.llm.entries import QUERIES
from tesselon.llm.periodic import document_runs, periodic, runs_of, with_repeats


def all_runs(words, times, least):
    """Each period by itself: stretches where words that far apart are equal, if no smaller period explains them."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            part = words[i : i + size]
            if size >= max(times * q, least) and not any(all(part[k] == part[k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(150):
        words = rng.integers(1, rng.integers(2, 5), rng.integers(1, 45))
        if seed % 2:
            words = np.resize(words[: rng.integers(1, 9)], len(words))
            words[rng.integers(0, len(words))] = 3
        assert [tuple(r) for r in runs_of(words).tolist()] == all_runs(words.tolist(), 2, 2)


def test_stretches_lose_no_run():
    rng = np.random.default_rng(3)
    for _ in range(200):
        docs = [np.resize(rng.integers(0, 6, rng.integers(1, 14)), rng.integers(0, 90)) for _ in range(rng.integers(1, 6))]
        for d in docs:
            if len(d):
                d[rng.integers(0, len(d))] = 2
        starts = np.cumsum([0, *map(len, docs)])
        of, runs = document_runs(np.concatenate(docs).astype(np.int64), np.repeat(np.arange(len(docs)), list(map(len, docs))))
        got = sorted((k, s - starts[k], size, q) for k, (s, size, q) in zip(of.tolist(), runs.tolist()))
        assert got == sorted((k, *r) for k, d in enumerate(docs) for r in all_runs(d.tolist(), 4, 6))


def told(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words, 4, 6)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    short = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 6000}
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, DATA).collect()]
    assert len(got) == docs.count()
    got = sorted(r for r in got if r[0] in short)
    assert got == sorted(told(k, t) for k, t in short.items())
    assert sum(r[1] for r in got) > 10


def test_long_and_odd_texts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic(odd_docs).collect()]
    assert len(rows) == odd_docs.count()
    for key, runs, collapsed in rows:
        if key == 5:
            assert runs == [(0, 40000, 5)] and collapsed == "lorem ipsum dolor sit amet"
        elif key in (2, 3, 4):
            assert (runs, collapsed) == ([], "")
        else:
            assert runs == []
    assert periodic(no_docs).count() == with_repeats(no_docs).count() == 0
    texts = {1: "a " * 7, 2: "x a b a b a b a b y", 3: "a a a a a", 4: "a\x0bb\fa b a\rb a b a\x1cb", 5: "ü ü ü ü ü ü ü é"}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic(df).collect()}
    assert got == {1: ([(0, 7, 1)], "a"), 2: ([(1, 8, 2)], "x a b y"), 3: ([], "a a a a a"), 4: ([(0, 8, 2)], "a b a\x1cb"), 5: ([(0, 7, 1)], "ü é")}

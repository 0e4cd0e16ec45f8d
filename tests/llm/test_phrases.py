"""Collocations against counting by hand; tests/llm/test_sql.py holds the query against SQL."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.llm.phrases import best_collocations, collocations, phrase_counts, ranked, scored, three_way


@pytest.mark.parametrize("least", [1, 3, 6])
def test_partitions_are_counts(least):
    rng = np.random.default_rng(least)
    for _ in range(150):
        n = int(rng.integers(0, 70))
        flat = np.r_[rng.integers(-1, rng.integers(1, 6), n), [-1] * 3]
        at = np.flatnonzero(flat[:n] != -1)
        weight = rng.integers(1, 4, len(at))
        got = [(tuple(flat[a : a + d].tolist()), w) for a, d, w in zip(*(x.tolist() for x in three_way(flat, at, weight, 3, least)))]
        want = Counter()
        for a, w in zip(at.tolist(), weight.tolist()):
            for d in (1, 2, 3):
                want[tuple(flat[a : a + d].tolist())] += w
                if flat[a + d - 1] == -1:
                    break
        assert len(got) == len(dict(got)) and dict(got) == {k: w for k, w in want.items() if w >= least}


def counts(rows, longest):
    found = Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            for d in range(longest + 1):
                for i in range(len(words) - max(d, 1) + 1):
                    found[lang or "und", " ".join(words[i : i + d]), d] += 1
    return found


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    kinds = ["Ab", "ab", "c", "ÄB", "\x1c", "d\x00", "e", "f", "zz", " "]
    gaps = [" "] * 8 + ["\t", ", ", "\n", "\x0b", "!"]
    return [([None, "und", "en", "de"][k % 4], None if k % 17 == 0 else "".join(kinds[rng.integers(0, len(kinds))] + gaps[rng.integers(0, len(gaps))] for _ in range(rng.integers(0, 60)))) for k in range(300)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_counts_and_scores(spark, rows, longest):
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(1)).repartition(5)
    every = counts(rows, longest)
    got = {(r["lang"], r["phrase"], r["size"]): r["n"] for r in phrase_counts(df, longest, 5).collect()}
    assert got == {k: n for k, n in every.items() if n >= 5 and k[2]}
    kept = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations(df, longest, 5).collect()}
    want = {}
    for (lang, phrase, d), a in every.items():
        if d < 2 or a < 5:
            continue
        words = phrase.split(" ")
        cuts = [(every[lang, " ".join(words[:k]), k], every[lang, " ".join(words[k:]), d - k]) for k in range(1, d)]
        score, _, (left, right) = min((1000000 * a * a // (x * y), k, (x, y)) for k, (x, y) in enumerate(cuts))
        inside = any(b >= 5 and 2 * b >= a for (g, longer, e), b in every.items() if g == lang and e > d and f" {phrase} " in f" {longer} ")
        if not inside:
            want[lang, phrase] = (a, left, right, every[lang, "", 0], score)
    assert kept == want and want


def test_large_numbers_and_ranks(spark):
    """Scores of counts whose products pass 64 bits, and ties by count and then by bytes."""
    common = spark.createDataFrame([(1, 3 * 10**14), (2, 2 * 10**14), (3, 10), (4, 10)], "id long, n long")
    long = spark.createDataFrame([([1, 2], 10**14), ([4, 3], 10), ([3, 4], 10)], "w array<long>, n long")
    got = {tuple(r["w"]): r["score"] for r in scored(common, long, 50).collect()}
    assert got == {(1, 2): 10**6 * 10**28 // (6 * 10**28), (3, 4): 10**6, (4, 3): 10**6}
    rows = [("en", "é Z", 10, 10, 10, 40, 10**6), ("en", "Z é", 10, 10, 10, 40, 10**6), ("en", "a b", 11, 11, 11, 40, 10**6), ("de", "c d", 9, 9, 9, 9, 2 * 10**6)]
    found = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in ranked(found, 2).collect()) == [("de", 1, "c d"), ("en", 1, "a b"), ("en", 2, "Z é")]


def test_odd_rows(odd_docs, no_docs):
    got = {r["phrase"]: r["a"] for r in collocations(odd_docs, least=4).collect()}
    assert got["lorem ipsum dolor"] == 8000
    assert collocations(no_docs).count() == phrase_counts(no_docs).count() == 0
    assert best_collocations(odd_docs.select("text", "lang").where("text is null")).count() == 0

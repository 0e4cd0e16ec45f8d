"""SimHash and embedding groups against all pairs."""

import itertools

import numpy as np
import pytest

from tesselon.llm import simhash, vectors
from tesselon.llm.shared import components


def by_hand(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def slow_fingerprint(text):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  ", "One", "One two THREE", "a b c d", "É a b\x0bc d e", "a a a a a a a a a", "x " * 40000])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text) == slow_fingerprint(text)


def test_every_pair_within_the_radius_meets():
    masks, rng = simhash.covering_masks(4), np.random.default_rng(1)
    assert len(masks) == 31
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("block", [4, 1024])
def test_groups_equal_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(8)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.linked(df, 4, block)).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [roots.get(s, s) for s in signed]
    want = by_hand(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    ids = sorted(text)
    fps = [slow_fingerprint(text[i]) for i in ids]
    want = by_hand(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert got == {i: (f, ids[w]) for i, f, w in zip(ids, fps, want)}


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(80)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = by_hand(300, pairs)
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {n: want[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", ["near", "dense", "chain"])
def test_vectors_equal_all_pairs(spark, parts, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 24))
    if parts == "dense":
        x = np.concatenate([base, base[:1] + 0.05 * rng.standard_normal((300, 24)), base[5:6].repeat(20, 0)])
        monkeypatch.setattr(vectors, "BLOCK", 64)
    elif parts == "chain":
        steps = np.cumsum(0.2 * rng.standard_normal((200, 24)), axis=0) + base[:1]
        x = np.concatenate([base, steps])
    else:
        x = np.concatenate([base, base + 0.15 * rng.standard_normal((60, 24)), base * 3])
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    want = by_hand(len(x), list(zip(*np.nonzero(np.triu(near)))))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}


@pytest.mark.parametrize(("kind", "n"), [("even", 10000), ("shared", 10000), ("crowded", 12000)])
def test_recall_where_windows_matter(spark, tmp_path, kind, n):
    """Lone pairs right at the threshold among evenly spread vectors, vectors of one direction, and a crowd of a third of all."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.standard_normal((n, 64)))
    if kind == "shared":
        x = unit(2 * unit(rng.standard_normal((1, 64))) + x)
    elif kind == "crowded":
        x[: n // 3] = np.sqrt(0.9) * unit(rng.standard_normal((1, 64))) + np.sqrt(0.1) * x[: n // 3]
    i = rng.choice(n // 3, 500, replace=False)
    aside = rng.standard_normal((500, 64))
    aside = unit(aside - (aside * x[i]).sum(1, keepdims=True) * x[i])
    x = np.concatenate([x, 0.951 * x[i] + np.sqrt(1 - 0.951**2) * aside]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    y = unit(x.astype(float))
    degree = (y @ y.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark.read.parquet(str(tmp_path / "v.parquet"))).collect()}
    assert degree.sum() >= 1000 and all(got[k] <= degree[k] for k in got)
    assert sum(got.values()) >= 0.99 * degree.sum()


def test_planned_passes_keep_the_miss():
    for rows in (10**3, 10**6, 10**9):
        for cosine in (0.95, 0.8, 0.5):
            near = (1 - np.arccos(cosine) / np.pi) ** vectors.leading(rows)
            assert (1 - near) ** vectors.passes_for(rows, cosine) <= 1.0001e-4
    assert vectors.centring(10**5, 0.95, 0.0)[1] == vectors.passes_for(10**5, 0.95)

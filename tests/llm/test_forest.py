"""The forest's neighbours against brute force: whole results where all leaves are visited, recall where they are not."""

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tesselon.llm.entries import QUERIES
from tesselon.llm.forest import Forest, nearest


def true_neighbours(vectors, asked, k):
    """``{query: [(score, id), ...]}`` of vectors ``[(id, components)]`` in double precision, by numbers of rows."""
    good = [(i, key, np.array(v, float)) for i, (key, v) in enumerate(vectors) if key is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, key, x in good:
        if asked(key):
            others = [(-float((x * y).sum()), other) for j, other, y in good if j != i and len(y) == len(x)]
            out.setdefault(key, []).append(sorted(others)[:k])
    return out


def recall(got, want, k):
    found = total = 0
    for key, (true,) in want.items():
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == key)
        assert [m[0] for m in mine] == list(range(1, len(true) + 1))
        found += len({m[1] for m in mine} & {t[1] for t in true})
        total += len(true)
    return found / total


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = QUERIES["op11_nearest_vectors"](spark, DATA).collect()
    by_id = dict(rows)
    for r in got:
        assert r["score"] == pytest.approx(np.dot(by_id[r["query_id"]], np.array(by_id[r["vec_id"]], float)), abs=1e-12)
    assert recall(got, true_neighbours(rows, lambda k: k % 20 == 0, 20), 20) >= 0.9


@pytest.mark.parametrize("kind", ["lengths", "crowds"])
def test_recall_of_uneven_vectors(spark, kind):
    """Vectors of very unlike lengths, where the nearest by inner product are the long ones, and a crowd of a third of all rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 24))
    if kind == "lengths":
        x *= rng.gamma(1.0, 1.0, (len(x), 1))
    else:
        x[:2000] = x[0] * 3 + 0.3 * rng.standard_normal((2000, 24))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = nearest(df, F.col("vec_id") % 40 == 0, k=10).collect()
    sims = x[::40] @ x.T
    sims[np.arange(len(sims)), np.arange(len(sims)) * 40] = -np.inf
    best = np.argsort(-sims, 1)[:, :10]
    mine = {}
    for r in got:
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(mine[40 * i] & set(b.tolist())) / 10 for i, b in enumerate(best)]) >= 0.9


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 5.0]), (3, None), (40, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (60, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [9.0, 0.0])]
    rows += [(9, [1.0, 0.0, 0.0]), (10, [-0.0, 3.0]), (80, [0.0, 1.0]), (80, [0.0, -1.0]), (100, [1.0, 2.0, 3.0]), (120, [7.0])] + [(200 + i, [0.5, 0.5]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("raw", F.lit(1)).withColumn("cls", F.lit(2)).withColumn("q", F.lit(3)).withColumn("score", F.lit("x"))
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = true_neighbours(rows, lambda k: k % 20 == 0, 3)
    assert sorted(got) == sorted(k for k, v in want.items() if any(v))
    for key, found in got.items():
        every = sorted((rank, i, s) for lists in want[key] for rank, (s, i) in enumerate(((-s, i) for s, i in lists), 1))
        assert sorted(found) == every
    assert got[100] == [(1, 9, 1.0)] and 120 not in got
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(df, F.lit(False)).count() == 0


def test_queue_goes_by_distance_over_all_trees():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 8))
    forest = Forest(x, float(np.sqrt((x * x).sum(1).max())), 16, 3, 5)
    sizes = np.bincount(forest.leaf_of(x).ravel(), minlength=48)
    assert sizes.min() > 0.5 * 600 / 16 and sizes.max() < 2 * 600 / 16
    order = forest.visits(x[:5], 48)
    assert all(sorted(v) == list(range(48)) for v in order)
    for q, seen in enumerate(order):
        wide = forest.widened(x[q : q + 1], query=True)[0]

        def away(leaf):
            t, node, far = leaf // 16, leaf % 16 + 15, 0.0
            while node:
                up, right = (node - 1) // 2, node % 2 == 0
                side = float(wide @ forest.turn[t, up] - forest.cut[t, up])
                far = far if (side > 0) == right else max(far, abs(side))
                node = up
            return far

        far = [away(leaf) for leaf in seen]
        assert far == pytest.approx(sorted(far))

"""Nearest neighbours by inner product: a forest of random-projection trees, searched through one queue for all trees.

Vectors get one more component, so that the largest inner product is the nearest vector: what their squared length lacks of
the largest one. Trees are cut at medians of a bounded sample along the line through two of its vectors, and every row
is then led to its leaf. A query goes down all trees at once: one queue holds the sides not taken yet, by how far they are, and the nearest is gone
down next, whichever tree it is in. How many leaves a query visits follows from queries whose true neighbours are looked
up in all rows, so that the share found there reaches a target.

Leaves are cells of a join: each task gets a block of a cell's rows and a block of the queries that visit it, and keeps
the best of each query.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.shared import bounded_sample, each_group, stored
from tesselon.llm.vectors import _matrix, by_size, stored_kind, usable

NEAREST, TREES, LEAF_ROWS, MOST_LEAVES = 20, 4, 512, 1024
#: The trees are fitted on at most SAMPLE vectors and SAMPLE_BYTES, the visits on PROBES queries that are to find FOUND of their neighbours.
SAMPLE, SAMPLE_BYTES, PROBES, FOUND = 16_384, 1 << 26, 128, 0.96
#: Lengths of vectors that get a forest of their own; vectors of other lengths are one leaf for each length.
LENGTHS = 8
CELL_ROWS, CELL_QUERIES, CHUNK = 8192, 8192, 1 << 20


class Forest:
    """Trees over vectors of one length; a leaf is ``tree * leaves + number``."""

    def __init__(self, sample: np.ndarray, most: float, leaves: int, trees: int, seed: int):
        self.most, self.leaves, self.trees = most, leaves, trees
        self.levels = leaves.bit_length() - 1
        rng = np.random.default_rng(seed)
        wide = self.widened(sample)
        # Nodes are numbered as in a heap: the children of k are 2 k + 1 and 2 k + 2.
        self.turn = np.zeros((trees, leaves - 1, wide.shape[1]))
        self.cut = np.zeros((trees, leaves - 1))
        for t in range(trees):
            inside = {0: np.arange(len(wide))}
            for node in range(leaves - 1):
                rows = inside.pop(node)
                line = rng.standard_normal(wide.shape[1])
                if len(rows) > 1:
                    a, b = wide[rng.choice(rows, 2, replace=False)]
                    line = a - b if (a != b).any() else line
                self.turn[t, node] = line / np.linalg.norm(line)
                side = wide[rows] @ self.turn[t, node]
                self.cut[t, node] = np.median(side) if len(rows) else 0.0
                right = side > self.cut[t, node]
                inside[2 * node + 1], inside[2 * node + 2] = rows[~right], rows[right]

    def widened(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows with the component that makes all of them equally long; queries get a zero, which leaves inner products as they are."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most**2 - (x * x).sum(1), 0))
        return np.column_stack([x, more])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        wide, found = self.widened(x), np.empty((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.levels):
                right = np.einsum("ij,ij->i", wide, self.turn[t, node]) > self.cut[t, node]
                node = 2 * node + 1 + right
            found[:, t] = node - (self.leaves - 1) + t * self.leaves
        return found

    def visits(self, x: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves that each query comes to, in their order."""
        wide, inner, out = self.widened(x, query=True), self.leaves - 1, []
        turn, cut = self.turn.reshape(-1, wide.shape[1]), self.cut.ravel()
        for since in range(0, len(x), 256):
            far = (wide[since : since + 256] @ turn.T - cut).reshape(-1, self.trees, inner)
            for sides in far.tolist():
                queue, found = [(0.0, t, 0) for t in range(self.trees)], []
                while queue and len(found) < most:
                    away, t, node = heapq.heappop(queue)
                    tree = sides[t]
                    while node < inner:
                        side = tree[node]
                        taken, left = (2 * node + 2, 2 * node + 1) if side > 0 else (2 * node + 1, 2 * node + 2)
                        heapq.heappush(queue, (max(away, abs(side)), t, left))
                        node = taken
                    found.append(node - inner + t * self.leaves)
                out.append(found)
        return out


def fitted(classes: DataFrame, kind: str, trees: int, seed: int) -> dict[int, Forest]:
    """Forests by size of vectors in bytes, of the LENGTHS commonest ones."""
    grouped = classes.groupBy(F.length("raw").alias("size")).agg(F.count("*").alias("n"), F.max(_squared(kind)("raw")).alias("most"))
    common = grouped.orderBy(F.desc("n"), "size").limit(LENGTHS).collect()
    forests = {}
    for row in common:
        leaves = min(MOST_LEAVES, 1 << max(1, math.ceil(math.log2(max(2, row["n"] / LEAF_ROWS)))))
        most = max(64, min(SAMPLE, SAMPLE_BYTES // row["size"]))
        sample = bounded_sample(classes.where(F.length("raw") == row["size"]).select("cls", "raw"), "cls", most).orderBy("cls").collect()
        forests[row["size"]] = Forest(_matrix([r["raw"] for r in sample], kind), math.sqrt(row["most"]), leaves, trees, seed)
    return forests


def _squared(kind: str):
    """Squared lengths of binary vectors."""

    @F.pandas_udf("double")
    def squared(raw):
        import pandas as pd

        return pd.Series([float((x * x).sum()) for x in (np.frombuffer(r, kind).astype(np.float64) for r in raw)], dtype="float64")

    return squared


def best_of(x: np.ndarray, rows: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of the largest inner product with each of ``x``, ties by ``first``: (query, row, score) in parallel arrays."""
    asked, hit, score = [], [], []
    per = max(1, CHUNK // max(1, len(rows)))
    for since in range(0, len(x), per):
        part = x[since : since + per]
        about = part @ rows.T
        if len(rows) > k:
            # Products by matrices may differ in their last bits; those near the k-th are kept until they are taken one by one.
            least = np.partition(about, len(rows) - k, axis=1)[:, len(rows) - k]
            q, r = np.nonzero(about >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        else:
            q, r = np.divmod(np.arange(about.size), len(rows))
        exact = np.einsum("ij,ij->i", part[q], rows[r])
        order = np.lexsort((first[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < k
        asked.append(q[kept] + since)
        hit.append(r[kept])
        score.append(exact[kept])
    return tuple(np.concatenate(a) for a in (asked, hit, score))


_FOUND = "q bigint, score double, first bigint, cls bigint"


def _told(q, score, first, cls) -> pa.RecordBatch:
    return pa.record_batch([pa.array(q, pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(cls, pa.int64())], names=["q", "score", "first", "cls"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best classes of each query, each once. Each task keeps that many before rows are dealt out by query."""
    return found.withColumn("place", F.expr("dense_rank() over (partition by q order by score desc, first, cls)")).where(F.col("place") <= k).dropDuplicates(["q", "cls"]).drop("place")


def visits_wanted(classes: DataFrame, queries: DataFrame, forests: dict[int, Forest], kind: str, k: int, found: float) -> dict[int, int]:
    """Leaves to visit for each length, so that PROBES queries, taken by a hash, find the share ``found`` of their ``k`` nearest classes."""
    probes = bounded_sample(queries.select("cls", "raw"), "cls", PROBES).collect()
    wanted = {}
    for size, forest in forests.items():
        own = [r for r in probes if len(r["raw"]) == size]
        every = forest.leaves * forest.trees
        if not own:
            wanted[size] = max(1, every // 2)
            continue
        ids, x = np.array([r["cls"] for r in own]), _matrix([r["raw"] for r in own], kind)

        def exact(batches, ids=ids, x=x, size=size):
            for batch in batches:
                raw = batch.column(1).to_pylist()
                at = np.array([i for i, r in enumerate(raw) if len(r) == size], np.int64)
                if len(at):
                    cls = batch.column(0).to_numpy()[at]
                    q, r, score = best_of(x, _matrix([raw[i] for i in at], kind), cls, k + 1)
                    yield _told(ids[q], score, cls[r], cls[r])

        true = _first(classes.select("cls", "raw").mapInArrow(exact, _FOUND), k + 1).where("q <> cls").join(classes.select("cls", "raw"), "cls").select("q", "raw").collect()
        leaves = forest.leaf_of(_matrix([r["raw"] for r in true], kind)) if true else np.zeros((0, forest.trees), np.int64)
        order = {q: {leaf: place for place, leaf in enumerate(v)} for q, v in zip(ids.tolist(), forest.visits(x, every))}
        # The visit on which each true neighbour is first met, in any of the trees.
        met = np.sort([min(order[r["q"]][leaf] for leaf in mine) for r, mine in zip(true, leaves.tolist())])
        wanted[size] = int(met[min(len(met) - 1, math.ceil(found * len(met)))]) + 1 if len(met) else 1
    return wanted


def placed(rows: DataFrame, forests: dict[int, Forest], kind: str, visits: dict[int, tuple[int, int]] | None) -> DataFrame:
    """``rows(cls, first, bound, raw)`` in the cells of their leaves: of all trees, or of the visits from and to the given ones for queries.

    A few neighbouring leaves are one cell, to which a query comes once, with the list of ``leaves`` it asks for.
    """
    # Forests are bounded by MOST_LEAVES, TREES and LENGTHS, whatever the number of rows.
    sent = rows.sparkSession.sparkContext.broadcast(forests)

    def cells(batches):
        forests = sent.value
        for batch in batches:
            raw = batch.column(3).to_pylist()
            for size, pick, x in by_size(raw, kind):
                pick, forest = np.array(pick), forests.get(size)
                if forest is None:
                    at, leaf = np.arange(len(pick)), np.zeros(len(pick), np.int64)
                    at, leaf = (at, leaf) if visits is None or visits[0][0] == 0 else (at[:0], leaf[:0])
                elif visits is None:
                    at, leaf = np.repeat(np.arange(len(pick)), forest.trees), forest.leaf_of(x).ravel()
                else:
                    seen = [v[visits[size][0] :] for v in forest.visits(x, visits[size][1])]
                    at, leaf = np.repeat(np.arange(len(pick)), [len(v) for v in seen]), np.concatenate([np.array(v, np.int64) for v in seen])
                order = np.lexsort((leaf, at))
                at, leaf = at[order], leaf[order]
                cell = leaf // (CELL_ROWS // LEAF_ROWS // 2)
                head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (cell[1:] != cell[:-1])]) if len(at) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(leaf)], pa.int32()), pa.array(leaf, pa.int64()))
                own = pick[at[head]]
                columns = [pa.array(np.full(len(head), size, np.int32)), pa.array(cell[head], pa.int64()), lists, *(batch.column(k).take(pa.array(own)) for k in range(4))]
                yield pa.record_batch(columns, names=["size", "cell", "leaves", "cls", "first", "bound", "raw"])

    shape = "size int, cell bigint, leaves array<bigint>, cls bigint, first bigint, bound double, raw binary"
    return stored(rows.select("cls", "first", "bound", "raw").mapInArrow(cells, shape), "cells")


def met(rows: DataFrame, asked: DataFrame, kind: str, k: int) -> DataFrame:
    """``(q, score, first, cls)``: of the cells where rows and queries of `placed` meet, the ``k`` best of each query that reach its bound."""
    # Cells that hold more rows or queries than a block are dealt out as pairs of blocks.
    count = lambda df, name, most: df.groupBy("size", "cell").agg(F.ceil(F.count("*") / F.lit(most)).alias(name))
    blocks = stored(count(rows, "row_blocks", CELL_ROWS).join(count(asked, "query_blocks", CELL_QUERIES), ["size", "cell"]), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    dealt = rows.join(blocks, ["size", "cell"]).withColumn("rb", own("row_blocks")).withColumn("qb", every("query_blocks")).withColumn("role", F.lit(0))
    dealt = dealt.unionByName(asked.join(blocks, ["size", "cell"]).withColumn("qb", own("query_blocks")).withColumn("rb", every("row_blocks")).withColumn("role", F.lit(1)))
    dealt = dealt.select(F.xxhash64("size", "cell", "rb", "qb").alias("g"), "size", "role", "leaves", "cls", "first", "bound", "raw")

    def meet(batches):
        for table in each_group(batches, "g"):
            for size in np.unique(table.column("size").to_numpy()):
                mine = table.filter(pa.compute.equal(table.column("size"), size)).combine_chunks()
                role, cls, first, bound = (mine.column(c).to_numpy() for c in ("role", "cls", "first", "bound"))
                lists, x = mine.column("leaves").combine_chunks(), _matrix(mine.column("raw").to_pylist(), kind)
                at, leaf = np.repeat(np.arange(len(role)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                order = np.lexsort((role[at], leaf))
                at, leaf = at[order], leaf[order]
                edge = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
                parts = []
                for b, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    mid = b + int(np.searchsorted(role[at[b:e]], 1))
                    if b < mid < e:
                        here, asking = at[b:mid], at[mid:e]
                        q, r, score = best_of(x[asking], x[here], first[here], k)
                        fine = score >= bound[asking[q]]
                        parts.append((asking[q[fine]], score[fine], here[r[fine]]))
                if parts:
                    q, score, r = (np.concatenate(p) for p in zip(*parts))
                    order = np.lexsort((cls[r], first[r], -score, q))
                    q, score, r = q[order], score[order], r[order]
                    once = np.r_[True, (q[1:] != q[:-1]) | (r[1:] != r[:-1])] if len(q) else np.zeros(0, bool)
                    q, score, r = q[once], score[once], r[once]
                    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                    yield _told(cls[q[kept]], score[kept], first[r[kept]], cls[r[kept]])

    return dealt.repartition("g").sortWithinPartitions("g", "role").mapInArrow(meet, _FOUND)


def searched(classes: DataFrame, queries: DataFrame, forests: dict[int, Forest], wanted: dict[int, int], kind: str, k: int) -> DataFrame:
    """``(q, score, first, cls)``: the ``k`` best classes that each query meets in the leaves it visits.

    The first leaves of the queue, a quarter of them, give a bound: what comes later has to reach the ``k``-th best found there.
    """
    rows = placed(classes.withColumn("bound", F.lit(0.0)), forests, kind, None)
    early = {size: (0, max(1, -(-n // 4))) for size, n in wanted.items()} | {0: (0, 0)}
    late = {size: (early[size][1], n) for size, n in wanted.items()} | {0: (1, 1)}
    found = met(rows, placed(queries.withColumn("bound", F.lit(float("-inf"))), forests, kind, early), kind, k)
    first = stored(_first(found, k), "early")
    bounds = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("bound"))
    rest = queries.join(bounds, queries["cls"] == bounds["q"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    return _first(first.union(met(rows, placed(rest, forests, kind, late), kind, k)), k)


def nearest(vectors: DataFrame, asked: Column, k: int = NEAREST, trees: int = TREES, found: float = FOUND, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors(vec_id, embedding, ...)`` of the largest inner product with each
    row whose ``vec_id`` meets the condition ``asked``.

    Every row is a candidate but the query's own. Products are taken in double of the vectors as they come; ties go to the smaller id.
    Equal vectors are one class with its smallest ids, of which ``k + 1`` are enough for any query, so that copies of one
    vector cost no more than one.

    Vectors that are null, empty, zero or hold null or non-finite components and rows without an id take no part, as queries or as
    candidates. Vectors meet those of their own length only. Rows that repeat an id are rows of their own: each asks, and the other
    one is found. With fewer candidates than ``k`` all are told; an empty table gives an empty result.
    """
    kind = stored_kind(vectors)
    rows = stored(usable(vectors).where("raw is not null and vec_id is not null"), "vectors")
    few = rows.withColumn("place", F.expr("row_number() over (partition by raw order by vec_id)")).where(F.col("place") <= k + 1)
    grouped = few.groupBy("raw").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("first"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("cls"), "first", "ids", "raw"), "classes")
    own = stored(rows.where(asked).join(classes.select("raw", "cls"), "raw").select(F.col("vec_id").alias("query_id"), "cls"), "asked")
    queries = stored(classes.join(own.select("cls").distinct(), "cls", "left_semi"), "queries")
    forests = fitted(classes, kind, trees, seed)
    wanted = visits_wanted(classes, queries, forests, kind, k, found)
    hits = searched(classes.select("cls", "first", "raw"), queries.select("cls", "first", "raw"), forests, wanted, kind, k + 1)
    # Classes back to rows: k + 1 of them, since the query's own row may be among them.
    placed = hits.join(classes.select("cls", "ids"), "cls").select("q", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"), F.col("cls").alias("cls"), F.col("score").alias("score")))).alias("hit"))
    lists = stored(placed.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, k + 1).alias("hits")), "hits")
    met = own.join(lists.withColumnRenamed("q", "cls"), "cls")
    mine = F.array_position(F.transform("hits", lambda h: (h["vec_id"] == F.col("query_id")) & (h["cls"] == F.col("cls"))), True)
    others = F.slice(F.when(mine > 0, F.filter("hits", lambda h, i: i + 1 != mine)).otherwise(F.col("hits")), 1, k)
    told = met.select("query_id", F.posexplode(others).alias("place", "hit"))
    return told.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))

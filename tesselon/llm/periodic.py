"""Runs of periodically repeated words, found by longest common extensions on suffix trees.

Ukkonen trees of the words and of their reversal answer how far two places agree to the right and to the left: the depth of
two leaves' lowest common ancestor, a minimum over a Euler tour. Every run has a Lyndon root, which is the longest Lyndon word
from its place on in the usual or in the reversed order of words; so two candidates a place, extended both ways, find all runs.

Trees are built of the stretches only that can hold a run; `repetitive` says which, and loses none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words that are looked at together, and words of short stretches that share a tree. Longer texts and stretches stay whole.
TOGETHER, TREE_WORDS = 400_000, 20_000


def ukkonen(codes: list[int], letters: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Suffix tree of ``codes``, whose last one, 0, stands nowhere else: edges by ``node * letters + first code``, and where
    the text of the edge above each node begins and ends."""
    n = len(codes)
    edges: dict[int, int] = {}
    first, last, link = [0], [0], [0]
    node, edge, length, pending = 0, 0, 0, 0
    for i, code in enumerate(codes):
        pending += 1
        made = 0
        while pending:
            if not length:
                edge = i
            key = node * letters + codes[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                begin = first[child]
                size = last[child] - begin
                if length >= size:
                    edge += size
                    length -= size
                    node = child
                    continue
                if codes[begin + length] == code:
                    length += 1
                    if made:
                        link[made] = node
                    break
                between = len(first)
                edges[key] = between
                first += (begin, i)
                last += (begin + length, n)
                link += (0, 0)
                first[child] = begin + length
                edges[between * letters + code] = between + 1
                edges[between * letters + codes[begin + length]] = child
                if made:
                    link[made] = between
                made = between
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return edges, first, last


class Extensions:
    """Longest common extensions to the right, in constant time each, and the order of suffixes."""

    def __init__(self, codes: np.ndarray):
        """``codes`` from 1 on; an end mark is added, which comes before all others."""
        self.n = n = len(codes)
        letters = int(codes.max()) + 1
        edges, first, last = ukkonen([*codes.tolist(), 0], letters)
        keys, below = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        edges.clear()
        order = np.argsort(keys)
        above, self.begin = keys[order] // letters, keys[order] % letters
        self.below = below[order]
        self.size = np.array(last) - np.array(first)
        nodes = len(first)
        self.from_, self.to = np.searchsorted(above, np.arange(nodes)), np.searchsorted(above, np.arange(nodes), side="right")
        suffixes, turns = self.tour(False)
        self.rank = np.empty(n + 1, np.int64)
        self.rank[suffixes] = np.arange(n + 1)
        # The tour's lowest points between neighbouring leaves; levels[k][i] is the least of 2 ** k of them from i on.
        self.levels = [turns]
        while 2 << (len(self.levels) - 1) <= len(turns):
            before, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(before[:-half], before[half:]))

    def tour(self, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of a walk round the tree, and for each leaf the depth at which the walk turned to it.

        With ``reverse`` codes are ordered from the largest to the smallest, behind the end mark.
        """
        size, below, begin = self.size.tolist(), self.below.tolist(), self.begin.tolist()
        spans, ends = self.from_.tolist(), self.to.tolist()
        whole, found, turns = self.n + 1, [], []
        todo = [(0, 0, 0)]
        while todo:
            node, depth, turn = todo.pop()
            b, e = spans[node], ends[node]
            if b == e:
                found.append(whole - depth)
                turns.append(turn)
                continue
            kids = below[b:e]
            if reverse:
                kids = kids[:1] + kids[:0:-1] if begin[b] == 0 else kids[::-1]
            for kid in kids[:0:-1]:
                todo.append((kid, depth + size[kid], depth))
            todo.append((kids[0], depth + size[kids[0]], turn))
        return np.array(found), np.array(turns)

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from ``a`` and from ``b`` on agree; ``a`` and ``b`` differ."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k))])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place on ends: at the next smaller suffix."""
    ranks, n = rank.tolist(), len(rank) - 1
    ends, stack = [n] * n, []
    for i in range(n):
        mine = ranks[i]
        while stack and ranks[stack[-1]] > mine:
            ends[stack.pop()] = i
        stack.append(i)
    return np.array(ends, np.int64)


def runs_of(codes: np.ndarray, times: int = 2, words: int = 2) -> np.ndarray:
    """All runs of ``codes`` (from 1 on) as rows ``start, length, period``, of at least ``times`` periods and ``words`` codes."""
    n = len(codes)
    if n < max(times, words):
        return np.zeros((0, 3), np.int64)
    right = Extensions(codes)
    backwards, _ = right.tour(True)
    other = np.empty(n + 1, np.int64)
    other[backwards] = np.arange(n + 1)
    roots = [np.arange(n) * np.int64(n + 1) + lyndon_ends(rank) for rank in (right.rank, other)]
    at, end = np.divmod(np.unique(np.concatenate(roots)), n + 1)
    fits = (end - at) * times <= n
    at, end = at[fits], end[fits]
    stop = end.copy()
    inner = np.flatnonzero(end < n)
    stop[inner] += right.lce(at[inner], end[inner])
    del right
    left = Extensions(codes[::-1])
    start = at.copy()
    inner = np.flatnonzero(at > 0)
    start[inner] -= left.lce(n - at[inner], n - end[inner])
    long = stop - start >= np.maximum(times * (end - at), words)
    found = np.stack([start, stop - start, end - at], axis=1)[long]
    found = found[np.lexsort(found.T[::-1])]
    return found[np.r_[True, (found[1:] != found[:-1]).any(axis=1)][: len(found)]]


def repetitive(codes: np.ndarray, doc: np.ndarray, times: int = LEAST_TIMES, words: int = LEAST_WORDS) -> np.ndarray:
    """Which places can lie in a run of at least ``times`` periods and ``words`` words.

    In a run of period q every word behind the first q stands at most q places behind its last occurrence, and there are
    (times - 1) * q of them at least. So for each power of two, runs whose period is at most it and more than its half lie in a long enough
    stretch of such words and the places of one period before it. ``doc`` rises with the documents, which runs don't cross.
    """
    n = len(codes)
    order = np.argsort(doc * (np.int64(codes.max()) + 1) + codes, kind="stable") if n else np.zeros(0, np.int64)
    same = (codes[order[1:]] == codes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    behind = np.full(n, n + 1, np.int64)
    behind[order[1:][same]] = (order[1:] - order[:-1])[same]
    longest = int(np.bincount(doc).max(initial=0)) if n else 0
    mark = np.zeros(n + 1, np.int32)
    reach = 1
    while True:
        least = max(words - reach, (times - 1) * (reach // 2 + 1))
        if times * (reach // 2 + 1) > longest:
            break
        near = np.flatnonzero(np.diff(np.r_[False, behind <= reach, False].astype(np.int8)))
        b, e = near[::2], near[1::2]
        long = e - b >= least
        np.add.at(mark, np.maximum(b[long] - reach, 0), 1)
        np.add.at(mark, e[long], -1)
        reach *= 2
    return np.cumsum(mark[:n]) > 0


def document_runs(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of many documents: their number and rows ``start, length, period``, start in ``codes``."""
    kept = repetitive(codes, doc)
    cut = np.flatnonzero(kept & np.r_[True, ~kept[:-1] | (doc[1:] != doc[:-1])]) if len(kept) else np.zeros(0, np.int64)
    stop = np.flatnonzero(kept & np.r_[~kept[1:] | (doc[1:] != doc[:-1]), True]) + 1 if len(kept) else cut
    long = stop - cut >= LEAST_WORDS
    cut, stop = cut[long], stop[long]
    found, k = [np.zeros((0, 3), np.int64)], 0
    while k < len(cut):
        upto = max(k + 1, int(np.searchsorted(np.cumsum(stop[k:] - cut[k:]), TREE_WORDS, side="right")) + k)
        # Stretches of one tree are kept apart by codes that stand once.
        spots = np.concatenate([np.r_[np.arange(b, e), -1] for b, e in zip(cut[k:upto], stop[k:upto])])
        _, inside = np.unique(codes[spots], return_inverse=True)
        alone = np.flatnonzero(spots < 0)
        inside = inside + 1
        inside[alone] = inside.max() + 1 + np.arange(len(alone))
        runs = runs_of(inside, LEAST_TIMES, LEAST_WORDS)
        runs[:, 0] = spots[runs[:, 0]]
        found.append(runs)
        k = upto
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return doc[runs[:, 0]], runs


def periodic(docs: DataFrame) -> DataFrame:
    """``(doc_id, runs, collapsed)`` per row of ``docs(doc_id, text, ...)``.

    ``runs`` are ``(start, length, period)`` by word number, all maximal stretches of the smallest period q and at least
    max(6, 4 q) words, by start and then period. ``collapsed`` is the text without the words that a run holds behind its first
    period, with one space between words.

    Null and empty texts have no runs and an empty collapsed text. Repeated rows and null ids are handled row by row; other
    columns are left out; an empty table gives an empty result. A text is looked at whole, however long.
    """
    kind = docs.schema["doc_id"].dataType

    def told(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = [w for t in texts for w in t]
        codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        begin = np.cumsum(sizes) - sizes
        of, runs = document_runs(codes, doc)
        dropped = np.zeros(len(flat) + 1, np.int64)
        np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
        np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
        dropped = np.cumsum(dropped[:-1]) > 0
        touched = set(of.tolist())
        left = [b" ".join([w for w, d in zip(t, dropped[b : b + len(t)].tolist()) if not d] if k in touched else t) for k, (t, b) in enumerate(zip(texts, begin.tolist()))]
        places = pa.StructArray.from_arrays([pa.array(c) for c in (runs[:, 0] - begin[of], runs[:, 1], runs[:, 2])], names=["start", "length", "period"])
        offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(offsets), places), pa.array(left, pa.binary())], names=["doc_id", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            texts, n, since = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append((text.as_py() or b"").split())  # bytes are split at the six ASCII blanks
                n += len(texts[-1])
                if n >= TOGETHER:
                    yield told(batch.column(0).slice(since, len(texts)), texts)
                    texts, n, since = [], 0, k + 1
            if texts:
                yield told(batch.column(0).slice(since), texts)

    shape = f"doc_id {kind.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, shape)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of ``docs``: with h the crc32 of the decimal id and g = h div 10, words from g mod n on of every document whose h
    is divisible by ten repeat with a period of 1 + (n - g mod n) div (3 + g mod 8); texts of the others stay. A null id counts as an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = zlib.crc32(b"" if key is None else str(key).encode())
                if text and h % 10 == 0 and (words := text.split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    root = words[a : a + p]
                    text = b" ".join(words[:a] + (root * ((n - a) // p + 1))[: n - a])
                out.append(text)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "text"])

    made = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, text binary")
    return made.withColumn("text", F.col("text").cast("string"))


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent and digests of the result of `periodic`."""
    # Exponents are compared as products of whole numbers: a / b > c / d as a * d > c * b.
    wide = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    better = lambda best, x: wide(x["length"], best["period"]) > wide(best["length"], x["period"])
    # Runs come by start and period, so that the first of equal ones is the one wanted.
    best = F.aggregate("runs", F.element_at("runs", 1), lambda best, x: F.when(better(best, x), x).otherwise(best))
    said = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    # Of no runs, the text of none, without a line's end.
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(said, "\n"), F.lit("\n"))).otherwise("")
    top = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return top.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

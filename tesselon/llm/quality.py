"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors for hashed features: its words, its word pairs (a word said twice in a row
is one feature of its own) and the character n-grams of length 3 to 5 inside words, word ends included. A softmax layer on top gives the score. Training is numpy stochastic
gradient descent on the cross entropy over a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselon.llm.shared import bounded_sample, forget, stored

BUCKETS, DIM, EPOCHS, SAMPLE, MOST_FEATURES = 1 << 17, 8, 6, 4000, 1 << 24
#: Steps for the vectors, of which a document moves each by its small share only, and for the softmax layer.
RATES = (400.0, 0.1)
CHUNK = 1 << 19
PRIME, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
STEP = np.uint64(0x5851F42D4C957F2D)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of STEP and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", STEP), ("down", BACK)):
            _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, CHUNK), base, np.uint64)], dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def hashed_features(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all ``texts`` and, beside each, the index of its text. Digits are all alike, ASCII blanks part words."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    x = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.r_[np.int32(0), np.repeat(np.arange(len(texts), dtype=np.int32), lengths)]
    x = np.where((x >= 9) & (x <= 13), np.uint32(32), np.where((x >= 49) & (x <= 57), np.uint32(48), x))
    blank = x == 32
    shift = np.uint32(32 - (buckets - 1).bit_length())
    ids, docs = [], []

    def add(h: np.ndarray, kind: int, who: np.ndarray) -> None:
        h = (h + np.uint32(kind)) * MIX
        h ^= h >> np.uint32(15)
        ids.append(((h * MIX) >> shift).astype(np.int32))
        docs.append(who)

    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    if len(start):
        up, down = _power(len(x) + 1)
        total = np.r_[np.uint64(0), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64)]
        word = (total[end] - total[start]) * down[start]
        word = ((word ^ (word >> np.uint64(29))) * STEP >> np.uint64(32)).astype(np.uint32)
        who = owner[start]
        add(word, 1, who)
        same = who[1:] == who[:-1]
        # A word said twice is one feature, whatever the word: averages of vectors that differ by word cannot learn it from examples.
        pair = np.where(word[1:] == word[:-1], np.uint32(7), word[:-1] * PRIME + word[1:])
        add(pair[same], 2, who[1:][same])
    h = x.copy()
    inner = np.ones(len(x), bool)
    for n in range(2, 6):
        if len(x) < n:
            break
        h = h[:-1] * PRIME + x[n - 1 :]
        if n > 2:
            inner = inner[: len(x) - n + 1] & ~blank[n - 2 : len(x) - 1]
            at = np.flatnonzero(inner[: len(h)])
            add(h[at], n, owner[at + 1])
    return (np.concatenate(ids), np.concatenate(docs)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def in_chunks(texts: list) -> Iterator[list[str]]:
    """Whole texts in runs of about CHUNK characters; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > CHUNK:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def shares(texts: list, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct feature buckets and the share of its features that each holds."""
    rows = []
    for run in in_chunks(texts):
        ids, docs = hashed_features(run, buckets)
        order = np.argsort(docs, kind="stable")
        for part in np.split(ids[order], np.searchsorted(docs[order], np.arange(1, len(run)))):
            found, times = np.unique(part, return_counts=True)
            rows.append((found.astype(np.int32), (times / max(1, len(part))).astype(np.float32)))
    return rows


def gradients(share: np.ndarray, rows: np.ndarray, out: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the cross entropy of one document: by its features' vectors ``rows``, by the softmax weights and by the bias."""
    mean = share @ rows
    logit = out @ mean + bias
    p = np.exp(logit - logit.max())
    p /= p.sum()
    p[label] -= 1
    return share[:, None] * (p @ out), p[:, None] * mean, p


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rates: tuple[float, float] = RATES, seed: int = 5) -> np.ndarray:
    """Fit vectors and softmax to ``shares``; returns what scoring needs: per bucket the difference of the two logits, then the bias."""
    rng, y = np.random.default_rng(seed), np.asarray(labels, int)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = rng.uniform(-1 / dim, 1 / dim, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    total, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            fade = np.float32(1 - done / total)
            done += 1
            by_rows, by_out, by_bias = gradients(share, vectors[ids], out, bias, y[i])
            vectors[ids] -= fade * np.float32(rates[0]) * by_rows
            out -= fade * np.float32(rates[1]) * by_out
            bias -= fade * np.float32(rates[1]) * by_bias
    return np.r_[vectors @ (out[1] - out[0]), bias[1] - bias[0]].astype(np.float32)


def score_texts(texts: list, model: np.ndarray) -> np.ndarray:
    """Probability of label 1 per text; a text without words gets what the bias alone says."""
    found = []
    for run in in_chunks(texts):
        ids, docs = hashed_features(run, len(model) - 1)
        many = np.bincount(docs, minlength=len(run))
        found.append(np.bincount(docs, weights=model[ids], minlength=len(run)) / np.maximum(many, 1))
    logit = (np.concatenate(found) if found else np.zeros(0)) + float(model[-1])
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def held_out(doc_id: Column) -> Column:
    """Rows that the classifier never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> np.ndarray:
    """Train on at most ``sample`` labelled documents, taken by a hash of their id, in one task.

    That task gets no texts but the features of whole texts, counted where the texts are, and at most ``most_features`` and those
    of one document more: what is beyond is not learned from. ``labels(doc_id, quality)``: rows without a quality are
    left out, the larger quality counts where an id repeats, and the larger text where a document's id does.
    Without any labelled document, or with one label only, every score follows the share of label 1 (one half if none).
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = stored(known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")), "labelled")
    chosen = bounded_sample(known, "doc_id", sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        forget()
        for batch in batches:
            found = shares(batch.column(2).to_pylist())
            columns = [pa.array([x.tobytes() for x in part], pa.binary()) for part in zip(*found)] if found else [pa.array([], pa.binary())] * 2
            yield pa.record_batch([*batch.columns[:2], *columns, pa.array([len(ids) for ids, _ in found], pa.int64())], names=["doc_id", "quality", "ids", "share", "n"])

    def fit(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table["doc_id"]).to_pylist()
        ids, share, label = table["ids"], table["share"], table["quality"].to_pylist()
        # Views of the table's own buffers: sorted or listed, the features would stand in memory three times.
        rows = [(np.frombuffer(ids[i].as_buffer(), np.int32), np.frombuffer(share[i].as_buffer(), np.float32)) for i in order]
        return pa.table({"model": pa.array([train(rows, [label[i] for i in order]).tobytes()], pa.binary())})

    counted = stored(texts.mapInArrow(count, f"doc_id {kind}, quality int, ids binary, share binary, n bigint"), "features")
    before = F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("n")
    few = stored(counted.select("doc_id", before.alias("before"), "n"), "order").where(F.col("before") < most_features).select("doc_id")
    gathered = counted.join(F.broadcast(few), "doc_id").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "model binary")
    row = stored(gathered, "quality").first()
    return np.frombuffer(row["model"], np.float32) if row else np.zeros(BUCKETS + 1, np.float32)


def quality_score(spark, model: np.ndarray):
    """A column function: the score of a text column under ``model``."""
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), shipped.value))

    return score


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text, ...)``.

    Whole texts are scored; null counts as empty. Only ``text`` enters the score. Extra columns are ignored, repeated
    rows get equal scores, an empty table gives an empty result.
    """
    score = quality_score(docs.sparkSession, fit_quality(docs, labels, sample))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

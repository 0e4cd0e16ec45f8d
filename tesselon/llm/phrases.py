"""Phrase collocations, counted by a multikey three-way quicksort of suffix pointers.

A pointer stands for the words from one place of a piece on. The quicksort parts pointers by one word at a time into smaller, equal
and greater ones and goes one word deeper into the equal ones; the sizes of equal partitions are the counts of phrases. It goes down to
the longest phrase and no deeper.

Texts are cut into stretches of words. Words are counted over all stretches first, since what stands behind a word that is
too rare is abandoned without a look at it: such words end pieces as marks do. The quicksort then runs twice: over each stretch, which adds
up what repeats there, and over the phrases that come together in one bucket, dealt out by all of their words. Only there
the counts of phrases are whole, so only there partitions are abandoned for being too small. A phrase comes to its bucket once from each
stretch at most, however common it is.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.llm.shared import each_group, stored

LEAST, WORDS, SHARE, TOP, NO_LANG = 10, 3, 50, 2000, "und"
#: Bytes of text of one stretch (a longer text is one stretch for itself), and for which there is one bucket of words and of phrases.
STRETCH_BYTES, WORD_BYTES, PHRASE_BYTES = 2_000_000, 24_000_000, 4_000_000
END = -1
_BREAK = b"\xff"  # never a byte of UTF-8 text
#: A-Z to a-z, marks and line ends that part pieces to _BREAK, tabs to spaces.
_PLAIN = bytes(_BREAK[0] if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def three_way(flat: np.ndarray, at: np.ndarray, weight: np.ndarray, deepest: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal partitions of the pointers ``at`` into ``flat`` as (one pointer, depth, weight): all phrases of 1 to ``deepest`` keys, an END included if the phrase has one.

    All partitions of one round are parted at once, each around a key of its own. Partitions that weigh less than ``least`` are
    abandoned, with all that they hold. What comes after an END is not looked at.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, weight = at.astype(np.int32 if len(flat) < 2**31 else np.int64), weight.astype(np.int64)
    begin, depth = np.zeros(min(1, len(at)), np.int64), np.zeros(min(1, len(at)), np.int32)  # of each partition
    while len(begin):
        size = np.diff(np.r_[begin, len(at)])
        # A partition of one pointer holds one phrase of each length.
        if least <= 1 and (size == 1).any():
            lone = np.flatnonzero(size == 1)
            ptr, deep, own = at[begin[lone]], depth[lone], weight[begin[lone]]
            while len(ptr):
                found.append((ptr, deep + 1, own))
                more = (flat[ptr + deep] != END) & (deep + 1 < deepest)
                ptr, deep, own = ptr[more], deep[more] + 1, own[more]
            rest = np.repeat(size > 1, size)
            at, weight, depth, size = at[rest], weight[rest], depth[size > 1], size[size > 1]
            begin = np.cumsum(size) - size
            if not len(begin):
                break
        own_depth = np.repeat(depth, size)
        key = flat[at + own_depth]
        a, b, c = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        less, more = key < pivot, key > pivot
        # Stable places: smaller ones first, then equal ones, then greater ones.
        n_less, n_more = np.add.reduceat(less, begin, dtype=np.int64), np.add.reduceat(more, begin, dtype=np.int64)
        edges = np.stack([begin, begin + n_less, begin + size - n_more], axis=1)
        same = ~(less | more)
        order = np.empty(len(at), np.int64)
        for part, counts, starts in ((less, n_less, edges[:, 0]), (same, size - n_less - n_more, edges[:, 1]), (more, n_more, edges[:, 2])):
            rows = np.flatnonzero(part)
            before = np.cumsum(counts) - counts
            order[np.repeat(starts - before, counts) + np.arange(len(rows))] = rows
        at, weight = at[order], weight[order]
        sizes = np.stack([n_less, size - n_less - n_more, n_more], axis=1).ravel()
        begins, deeper = edges.ravel(), np.stack([depth, depth + 1, depth], axis=1).ravel()
        equal = np.tile([False, True, False], len(begin))
        there = sizes > 0
        begins, deeper, equal, sizes = begins[there], deeper[there], equal[there], sizes[there]
        heavy = np.add.reduceat(weight, begins)
        kept = heavy >= least
        told = kept & equal
        found.append((at[begins[told]], deeper[told], heavy[told]))
        over = equal & ((deeper >= deepest) | (flat[at[begins] + deeper - 1] == END))
        kept &= ~over
        rows = np.repeat(kept, sizes)
        at, weight, depth, sizes = at[rows], weight[rows], deeper[kept].astype(np.int32), sizes[kept]
        begin = np.cumsum(sizes) - sizes
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _shrunk(x: np.ndarray) -> bytes:
    """Whole numbers packed: lowest bytes first, then the higher ones, which are mostly zeros."""
    x = x.astype(np.int32 if not len(x) or -(1 << 31) <= x.min() and x.max() < 1 << 31 else np.int64)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return struct.pack("<Bq", x.itemsize, len(x)) + pa.compress(planes, codec="zstd", asbytes=True)


def _grown(data: bytes) -> np.ndarray:
    size, n = struct.unpack_from("<Bq", data)
    if not n:
        return np.zeros(0, np.int32)
    planes = pa.decompress(data[9:], size * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(np.int32 if size == 4 else np.int64).ravel()


_CUT = {"stretch": pa.int64(), "flat": pa.binary(), "bucket": pa.int32(), "lang": pa.string(), "words": pa.list_(pa.binary()), "local": pa.binary(), "n": pa.binary()}


def _rows(kinds: dict[str, pa.DataType], size: int, **columns) -> pa.RecordBatch:
    """Rows of the columns that are given; the others are null."""
    made = [pa.nulls(size, kind) if columns.get(c) is None else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind) for c, kind in kinds.items()]
    return pa.record_batch(made, names=list(kinds))


def _stretch(number: int, lang: list[str], texts: list[bytes | None], buckets: int):
    """One row with the stretch's words as numbers, and rows with the words themselves and their counts by bucket and language."""
    langs = pa.array(lang, pa.string()).dictionary_encode()
    tokens: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = (text or b"").translate(_PLAIN).replace(_BREAK, b" \xff ").split()  # only spaces are left to split at
        found.append(_BREAK)
        sizes[k] = len(found)
        tokens += found
    coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
    del tokens
    vocabulary, plain = coded.dictionary, coded.indices.to_numpy()
    stop, n_langs = pa.compute.index(vocabulary, pa.scalar(_BREAK, pa.large_binary())).as_py(), len(langs.dictionary)
    # Words of unlike languages are unlike, so that a phrase's first word also tells its language.
    both = np.where(plain == stop, END, plain.astype(np.int64) * n_langs + np.repeat(langs.indices.to_numpy(), sizes))
    times = np.bincount(both[both != END], minlength=1)
    used = np.flatnonzero(times)
    number_of = np.full(len(times) + 1, END, np.int32)
    # The commonest words get the smallest numbers, which pack best.
    used = used[np.argsort(-times[used], kind="stable")]
    number_of[used] = np.arange(len(used))
    yield _rows(_CUT, 1, stretch=[number], flat=[_shrunk(number_of[both])])  # END is the last one's number
    bucket_of = np.array([zlib.crc32(w) for w in vocabulary.to_pylist()], np.int64) % buckets
    group = bucket_of[used // n_langs] * n_langs + used % n_langs
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    for b, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        local = order[b:e]
        words = vocabulary.take(pa.array(used[local] // n_langs)).cast(pa.binary())
        own, into = int(used[local[0]] % n_langs), int(group[local[0]] // n_langs)
        lists = pa.ListArray.from_arrays(pa.array([0, e - b], pa.int32()), words)
        yield _rows(_CUT, 1, stretch=[number], bucket=[into], lang=[langs.dictionary[own].as_py()], words=lists, local=[_shrunk(local)], n=[_shrunk(times[used[local]])])


def stretches(docs: DataFrame, buckets: int) -> DataFrame:
    """The texts of ``docs(lang, text)`` as stretches: rows ``(stretch, flat)`` with numbers of words, and rows
    ``(stretch, bucket, lang, words, local, n)`` that say which words have which numbers."""

    def cut(batches):
        lang, texts, n, number = [], [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lang.append(own)
                texts.append(text.as_py())
                n += len(texts[-1] or b"")
                if n >= STRETCH_BYTES:
                    yield from _stretch(number, lang, texts, buckets)
                    lang, texts, n, number = [], [], 0, number + 1
        if texts:
            yield from _stretch(number, lang, texts, buckets)

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(cut, "stretch bigint, flat binary, bucket int, lang string, words array<binary>, local binary, n binary"), "stretches")


_NAMED = {"stretch": pa.int64(), "local": pa.binary(), "ids": pa.binary(), "lang": pa.string(), "word": pa.binary(), "id": pa.int64(), "n": pa.int64()}


def common_words(cut: DataFrame, least: int, buckets: int) -> DataFrame:
    """Words of `stretches` that stand ``least`` times: rows ``(lang, word, id, n)``, rows ``(stretch, local, ids)`` that tell each
    stretch the ids of its words, and rows ``(lang, n)`` that add up to all words of a language."""

    def merged(batches):
        for table in each_group(batches, "bucket"):
            lang = np.array(table.column("lang").to_pylist(), str)
            words, locals_ = table.column("words").combine_chunks(), [_grown(x) for x in table.column("local").to_pylist()]
            sizes = np.array([len(x) for x in locals_])
            coded, edge = words.flatten().dictionary_encode(), np.r_[0, np.cumsum(sizes)]
            n = np.concatenate([_grown(x) for x in table.column("n").to_pylist()])
            langs, own = np.unique(lang, return_inverse=True)
            both = coded.indices.to_numpy().astype(np.int64) * len(langs) + np.repeat(own, sizes)
            times = np.zeros(int(both.max()) + 1, np.int64)
            np.add.at(times, both, n)
            # Ids are unique, as a word stands in one bucket only. The commonest words get the smallest ones, which pack best.
            kept = np.flatnonzero(times >= least)
            kept = kept[np.argsort(-times[kept], kind="stable")]
            id_of = np.full(len(times), END, np.int64)
            id_of[kept] = np.arange(len(kept)) * buckets + table.column("bucket")[0].as_py()
            for b in range(0, len(kept), 10_000):
                mine = kept[b : b + 10_000]
                yield _rows(_NAMED, len(mine), lang=langs[mine % len(langs)].tolist(), word=coded.dictionary.take(pa.array(mine // len(langs))), id=id_of[mine], n=times[mine])
            yield _rows(_NAMED, len(langs), lang=langs.tolist(), n=[int(times[k :: len(langs)].sum()) for k in range(len(langs))])
            for k, number in enumerate(table.column("stretch").to_pylist()):
                ids = id_of[both[edge[k] : edge[k + 1]]]
                common = ids != END
                yield _rows(_NAMED, 1, stretch=[number], local=[_shrunk(locals_[k][common])], ids=[_shrunk(ids[common])])

    dealt = cut.where("flat is null").select("bucket", "stretch", "lang", "words", "local", "n").repartition("bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(merged, "stretch bigint, local binary, ids binary, lang string, word binary, id bigint, n bigint"), "words")


def _packed(ids: np.ndarray, n: np.ndarray, bucket: np.ndarray):
    """Rows of bucket, phrases and counts, one for each bucket: Spark moves a few large rows instead of one for each phrase.

    ``ids`` has a column for each phrase, END where it is shorter. First words are in order and kept as differences, which pack well.
    """
    order = np.lexsort((*ids[::-1], bucket))
    ids, n, bucket = ids[:, order], n[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(n) else np.zeros(1, np.int64)
    for b, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        mine = ids[:, b:e].copy()
        mine[0, 1:] = np.diff(mine[0])
        columns = ([int(bucket[b])], [_shrunk(mine.ravel())], [_shrunk(n[b:e])])
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "ids", "n"])


def _unpacked(ids: bytes, n: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    found = _grown(ids).reshape(words, -1)
    found[0] = np.cumsum(found[0])
    return found, _grown(n)


def long_phrases(cut: DataFrame, named: DataFrame, words: int, least: int, buckets: int) -> DataFrame:
    """``(w, n)``: the phrases of 2 to ``words`` words, as ids, that stand ``least`` times, from `stretches` and `common_words`."""

    def counted(batches):
        for table in each_group(batches, "stretch"):
            (flat,) = (_grown(x) for x in table.column("flat").drop_null().to_pylist())
            local, ids = (np.concatenate([np.zeros(0, np.int32), *(_grown(x) for x in table.column(c).drop_null().to_pylist())]) for c in ("local", "ids"))
            if len(ids):
                yield from parted(flat, local, ids)

    def parted(flat, local, ids):
        """The phrases of one stretch, packed by bucket. Rare words end pieces, as they have no id."""
        most = max(int(flat.max(initial=0)), int(local.max(initial=0)))
        id_of = np.full(most + 2, END, np.int32 if ids.max() < 1 << 31 else np.int64)
        id_of[local] = ids
        flat = np.concatenate([id_of[flat], np.full(words, END, id_of.dtype)])
        places = np.flatnonzero(flat != END)
        at, deep, n = three_way(flat, places, np.ones(len(places), np.int64), words)
        whole = (deep > 1) & (flat[at + deep - 1] != END)
        at, deep, n = at[whole], deep[whole], n[whole]
        phrases = np.stack([np.where(deep > k, flat[at + k], END) for k in range(words)])
        yield from _packed(phrases, n, _bucket(phrases, buckets))

    def merged(batches):
        for table in each_group(batches, "bucket"):
            parts = [_unpacked(*r, words) for r in zip(*(table.column(c).to_pylist() for c in ("ids", "n")))]
            small = np.result_type(*(p for p, _ in parts))
            flat = np.full((sum(p.shape[1] for p, _ in parts), words + 1), END, small)
            np.concatenate([p.T for p, _ in parts], out=flat[:, :words], casting="same_kind")
            weight = np.concatenate([w for _, w in parts])
            del parts
            flat = flat.ravel()
            at, deep, n = three_way(flat, np.arange(0, len(flat), words + 1), weight, words + 1, least)
            whole = flat[at + deep - 1] == END  # a phrase is counted where its end is a key of the partition as well
            at, deep, n = at[whole].astype(np.int64), deep[whole] - 1, n[whole]
            ends = np.r_[0, np.cumsum(deep)]
            spots = np.repeat(at - ends[:-1], deep) + np.arange(ends[-1])
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[spots], pa.int64())), pa.array(n)], names=["w", "n"])

    whole = cut.where("flat is not null").select("stretch", "flat", F.lit(None).cast("binary").alias("local"), F.lit(None).cast("binary").alias("ids"))
    told = named.where("stretch is not null").select("stretch", F.lit(None).cast("binary").alias("flat"), "local", "ids")
    packed = whole.union(told).repartition("stretch").sortWithinPartitions("stretch").mapInArrow(counted, "bucket int, ids binary, n binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, "w array<bigint>, n bigint")


def _bucket(phrases: np.ndarray, buckets: int) -> np.ndarray:
    """Which bucket each column of ``phrases`` belongs to, by all of its words."""
    mixed = np.full(phrases.shape[1], 0x9E3779B97F4A7C15, np.uint64)
    for row in phrases:
        mixed = (mixed ^ row.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def counted_phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words ``(lang, word, id, n)`` and phrases ``(w, n)`` of 2 to ``words`` ids that stand ``least`` times, and all words of each language ``(lang, total)``."""
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(1, size // WORD_BYTES)
    cut = stretches(docs, buckets)
    named = common_words(cut, least, buckets)
    long = stored(long_phrases(cut, named, words, least, max(1, size // PHRASE_BYTES)), "phrases")
    common = named.where("id is not null").select("lang", F.col("word").cast("string").alias("word"), "id", "n")
    return common, long, named.where("id is null and lang is not null").groupBy("lang").agg(F.sum("n").alias("total"))


def _spelled(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ids ``w`` by their language and text: ``(lang, phrase, ...)``."""
    others = [c for c in rows.columns if c != "w"]
    spread = rows.select("w", F.posexplode("w").alias("pos", "id"), *others).join(words.select("id", "lang", "word"), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return spread.groupBy("w").agg(F.first("lang").alias("lang"), text.alias("phrase"), *(F.first(c).alias(c) for c in others)).drop("w")


def phrase_counts(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """``(lang, phrase, size, n)``: how often each phrase of 1 to ``words`` words stands in a language, if ``least`` times or more.

    Null languages are one, NO_LANG. Texts are looked at whole.
    """
    common, long, _ = counted_phrases(docs, words, least)
    ones = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    return ones.unionByName(_spelled(long.withColumn("size", F.size("w")), common))


def scored(common: DataFrame, long: DataFrame, share: int) -> DataFrame:
    """``(w, a, l, r, score)`` of the phrases ``long(w, n)`` of words ``common(id, n)`` that no longer one holds too often."""
    sizes = long.withColumn("size", F.size("w"))
    # Every cut, each with the counts of its two parts.
    cuts = sizes.select("w", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("w", "a", "k", F.slice("w", 1, F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    every = common.select(F.array("id").alias("w"), "n").union(long.select("w", "n"))
    part = lambda name, n: every.select(F.col("w").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("head", "l"), "head").join(part("tail", "r"), "tail")
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.groupBy("w").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The largest count of a longer phrase around each.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda d: F.transform(F.sequence(F.lit(1), F.col("size") - d + 1), lambda s: F.slice("w", s, d))))
    around = sizes.where("size >= 3").select(F.explode(inner).alias("w"), "n").groupBy("w").agg(F.max("n").alias("longer"))
    wide = lambda c: c.cast("decimal(19,0)")
    outside: Column = F.lit(100).cast("decimal(3,0)") * wide(F.col("longer")) < F.lit(share).cast("decimal(3,0)") * wide(F.col("a"))
    kept = lowest.join(around, "w", "left").where(F.coalesce(outside, F.lit(True)))
    return kept.select("w", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of all phrases of 2 to ``words`` words of ``docs(lang, text, ...)`` that stand ``least`` times.

    A phrase of count a is cut into two parts of counts l and r where floor(1000000 a a / (l r)) is least, at the first of equal
    cuts; that is its score. Phrases inside a longer one that has ``share`` hundredths of their count are left out. Arithmetic is exact
    up to counts of 1e15 of a phrase and 1e19 of a word.

    Null and empty texts hold no phrases; repeated rows count each; null languages are one, NO_LANG; other columns are not
    looked at; an empty table gives an empty result.
    """
    common, long, totals = counted_phrases(docs, words, least)
    return _spelled(scored(common, long, share), common).join(totals, "lang").select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language of `collocations` with their ``rank``.

    Parts of the phrases are ranked first, so that a language's task gets ``top`` rows from each of them at most.
    """
    placed = lambda df, *by: df.withColumn("rank", F.expr(f"row_number() over (partition by {', '.join(by)} order by score desc, a desc, phrase)")).where(F.col("rank") <= top)
    first = placed(found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256))), "lang", "part")
    return placed(first.drop("rank", "part"), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def best_collocations(docs: DataFrame, top: int = TOP, words: int = WORDS, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """The ``top`` collocations of each language by score, then count, then the bytes of the phrase: ``(lang, rank, phrase, a, l, r, n, score)``.

    Edges as `collocations`.
    """
    return ranked(collocations(docs, words, least, share), top)

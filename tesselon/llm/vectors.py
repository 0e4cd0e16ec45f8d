"""Embedding near-duplicates by sorted projection passes.

A pass orders all vectors by the concatenated signs of random projections. Two vectors of angle ``x`` agree on the first
``lead`` signs with probability (1 - x / pi) ** lead, whatever else there is. Those that do either stand within the window, or in a
run of equal leading signs that is longer than it; such runs are compared in full, in blocks. So what a pair may be missed with
follows from its angle and the number of passes alone, and not from how crowded the vectors are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tesselon.llm.shared import components, local_forest, stored, whole_groups

BITS, WINDOW, MISS, BLOCK, PER_PART, CENTRED = 64, 32, 1e-4, 1024, 4096, 16


def leading(rows: int, window: int = WINDOW) -> int:
    """Signs on which about ``window`` evenly spread rows agree."""
    return min(48, max(1, math.ceil(math.log2(max(rows, 2) / window))))


def passes_for(rows: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at ``threshold`` has missed the leading signs in all of them with probability ``miss``."""
    near = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** leading(rows, window)
    return max(2, math.ceil(math.log(miss) / math.log1p(-min(max(near, 1e-9), 0.999))))


def centring(rows: int, threshold: float, shared: float, window: int = WINDOW) -> tuple[float, int]:
    """How much of the mean to take off before the signs, and how many passes that asks for.

    ``shared`` is the squared length of the mean of all unit vectors, that is the cosine of two of them on average. Taking
    the mean off makes runs shorter, but widens the angle of a pair at the threshold as well; what costs fewer comparisons is taken.
    """
    best = None
    for part in (0.0, 0.25, 0.5, 0.75, 1.0):
        off = (part * part - 2 * part) * shared
        turned = lambda cosine: (cosine + off) / max(1 + off, 1e-9)
        if part and turned(threshold) < 0.1:
            continue
        passes = passes_for(rows, turned(threshold), window)
        crowd = rows * (1 - math.acos(max(-1.0, min(1.0, turned(shared)))) / math.pi) ** leading(rows, window)
        cost = passes * (window + crowd)
        if best is None or cost < best[0] * 0.999:
            best = (cost, part, passes)
    return best[1], best[2]


def _matrix(rows: list[bytes], kind: str) -> np.ndarray:
    """Binary vectors of one length, stored as ``kind``, as a matrix of doubles."""
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stored_kind(vectors: DataFrame) -> str:
    """How components are kept: as they come if single, else double. Cosines are taken in double either way."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """Adds ``raw``: the components in one binary, null for vectors that can link with nothing."""
    stored_as = stored_kind(vectors)

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                fine = x is not None and len(x) and v.values.null_count == 0 and np.isfinite(x).all() and x.any()
                out.append((x + 0.0).astype(stored_as).tobytes() if fine else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, raw binary")


def means(classes: DataFrame, stored_as: str) -> dict[int, tuple[int, np.ndarray]]:
    """Number and mean of the unit vectors of ``classes(cls, raw)`` by size in bytes, of the CENTRED commonest sizes; other sizes have none."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in by_size(batch.column(0).to_pylist(), stored_as):
                held[size] = held.get(size, 0) + np.r_[len(x), _unit(x).sum(0)]
        at = [(size, k, float(v)) for size, sums in held.items() for k, v in enumerate(sums)]
        columns = list(zip(*at)) if at else ([], [], [])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], names=["size", "k", "s"])

    sums = stored(classes.select("raw").mapInArrow(run, "size int, k int, s double").groupBy("size", "k").agg(F.sum("s").alias("s")), "sums")
    common = [r["size"] for r in sums.where("k = 0").orderBy(F.desc("s"), "size").limit(CENTRED).collect()]
    found: dict[int, list] = {}
    for r in sums.where(F.col("size").isin(common)).orderBy("size", "k").collect():
        found.setdefault(r["size"], []).append(r["s"])
    return {size: (int(v[0]), np.array(v[1:]) / v[0]) for size, v in found.items()}


def by_size(raw: list[bytes], stored_as: str):
    """Size, places and matrix of the vectors of each size."""
    for size in sorted({len(r) for r in raw}):
        pick = [i for i, r in enumerate(raw) if len(r) == size]
        yield size, pick, _matrix([raw[i] for i in pick], stored_as)


def signs(x: np.ndarray, off: np.ndarray | None, size: int, number: int, seed: int) -> np.ndarray:
    """The concatenated signs of BITS random projections of the rows of ``x``, as numbers in their order."""
    turn = np.random.default_rng([seed, number, size]).standard_normal((x.shape[1], BITS))
    kept = np.packbits((_unit(x) if off is None else _unit(x) - off) @ turn > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
    return (kept ^ np.uint64(1 << 63)).view(np.int64)


def window_links(classes: DataFrame, threshold: float, passes: int, parts: int, window: int = WINDOW, stored_as: str = "<f8", off: dict[int, np.ndarray] | None = None, seed: int = 7) -> DataFrame:
    """Verified links ``(a, b)`` between rows of ``classes(cls, raw)`` found by the sorted passes.

    Each pass orders all vectors by their signs (ties by class) and compares every vector with the ``window`` next ones. The order
    is a range partitioning, so it is as even as its sample; the rows next to a partition's ends are handed on and
    compared across the boundary. Links leave each partition as a spanning forest.
    """
    off = off or {}

    def spread(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for size, pick, x in by_size(raw, stored_as):
                ids = batch.column(0).take(pa.array(pick))
                for p in range(passes):
                    columns = [pa.array(np.full(len(pick), p, np.int32)), pa.array(np.full(len(pick), size, np.int32)), pa.array(signs(x, off.get(size), size, p, seed)), ids, pa.array([raw[i] for i in pick], pa.binary())]
                    yield pa.record_batch(columns, names=["pass", "size", "key", "cls", "raw"])

    def compared(run, raw, cls):
        """Forest links of one stretch of the order: rows of one ``run`` within the window of each other."""
        near = [[], []]
        for _, pick, x in by_size(raw, stored_as):
            x, pick = _unit(x), np.array(pick)
            for ahead in range(1, min(window, len(pick) - 1) + 1):
                hit = np.flatnonzero((np.einsum("ij,ij->i", x[:-ahead], x[ahead:]) >= threshold) & (run[pick[:-ahead]] == run[pick[ahead:]]))
                near[0].append(pick[hit])
                near[1].append(pick[hit + ahead])
        if not near[0]:
            return cls[:0], cls[:0]
        label = local_forest(len(cls), np.concatenate(near[0]), np.concatenate(near[1]))
        tied = np.flatnonzero(label != np.arange(len(cls)))
        return cls[tied], cls[label[tied]]

    def scan(batches):
        head, last = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks()
            if not table.num_rows:
                continue
            if head is None or head.num_rows < window:  # the head of the partition, for the boundary before it
                head = table.slice(0, window) if head is None else pa.concat_tables([head, table.slice(0, window - head.num_rows)])
            if last is not None:
                table = pa.concat_tables([last, table]).combine_chunks()
            a, b = compared(table.column("pass").to_numpy(), table.column("raw").to_pylist(), table.column("cls").to_numpy())
            yield _links(a, b)
            last = table.slice(max(0, table.num_rows - window))
        if last is not None:
            part = last.column("part").to_numpy()[:1]
            yield from _edge(head.drop_columns(["part"]), part - 1, 1)
            yield from _edge(last.drop_columns(["part"]), part, 0)

    def across(batches):
        for table in whole_groups(batches, "part"):
            part, side = table.column("part").to_numpy(), table.column("side").to_numpy()
            cls, runs, raw = table.column("a").to_numpy(), table.column("pass").to_numpy(), table.column("raw").to_pylist()
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                if side[at].min() != side[at].max():
                    yield _links(*compared(runs[at], [raw[i] for i in at], cls[at]))

    order = ["pass", "size", "key", "cls"]
    dealt = (
        classes.select("cls", "raw")
        .mapInArrow(spread, "pass int, size int, key bigint, cls bigint, raw binary")
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    shape = "a bigint, b bigint, part int, side int, pass int, key bigint, raw binary"
    found = stored(dealt.mapInArrow(scan, shape), "passes")
    ends = found.where("raw is not null").repartition("part").sortWithinPartitions("part", "side", "pass", "key", "a")
    return found.where("raw is null").select("a", "b").union(ends.mapInArrow(across, shape).select("a", "b"))


def crowded_links(classes: DataFrame, threshold: float, passes: int, lead: int, window: int = WINDOW, block: int = BLOCK, stored_as: str = "<f8", off: dict[int, np.ndarray] | None = None, seed: int = 7) -> DataFrame | None:
    """Links ``(a, b)`` inside the runs of equal ``lead`` leading signs that are longer than the window reaches; None if there is no such run.

    All pairs of such a run are verified, in pairs of blocks that are dealt out over tasks; out of each comes a spanning forest.
    """
    off = off or {}

    def run_of(x, size, p):
        return (signs(x, off.get(size), size, p, seed) >> np.int64(BITS - lead)) * np.int64(8192) + np.int64(p)

    def prefixes(batches, counted: bool):
        for batch in batches:
            for size, pick, x in by_size(batch.column(1).to_pylist(), stored_as):
                ids = batch.column(0).take(pa.array(pick))
                for p in range(passes):
                    run = run_of(x, size, p)
                    if counted:
                        run, n = np.unique(run, return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(run), size, np.int32)), pa.array(run), pa.array(n)], names=["size", "run", "m"])
                    else:
                        yield pa.record_batch([pa.array(np.full(len(run), size, np.int32)), pa.array(run), ids], names=["size", "run", "cls"])

    rows = classes.select("cls", "raw")
    runs = rows.mapInArrow(lambda b: prefixes(b, True), "size int, run bigint, m bigint").groupBy("size", "run").agg(F.sum("m").alias("n")).where(F.col("n") > window + 1)
    runs = stored(runs.select("size", "run", F.xxhash64("size", "run").alias("root"), "n"), "runs")
    if runs.first() is None:
        return None
    inside = rows.mapInArrow(lambda b: prefixes(b, False), "size int, run bigint, cls bigint").join(runs, ["size", "run"]).select("cls", "root")
    members = stored(inside, "crowded").join(classes.select("cls", "raw"), "cls").withColumn("copies", F.lit(0).cast("bigint"))
    return in_blocks(members, runs, threshold, 64, block, stored_as, True)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    void = lambda kind: pa.nulls(n, kind)
    return pa.record_batch(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), void(pa.int32()), void(pa.int32()), void(pa.int32()), void(pa.int64()), void(pa.binary())],
        names=["a", "b", "part", "side", "pass", "key", "raw"],
    )


def _edge(rows: pa.Table, part: np.ndarray, side: int):
    n = rows.num_rows
    made = pa.table(
        {"a": rows["cls"], "b": rows["cls"], "part": pa.array(np.full(n, part[0], np.int32)), "side": pa.array(np.full(n, side, np.int32)), "pass": rows["pass"], "key": rows["key"], "raw": rows["raw"]}
    )
    yield from made.combine_chunks().to_batches()


def class_degrees(members: DataFrame, sizes: DataFrame, threshold: float, buckets: int, block: int = BLOCK, stored_as: str = "<f8") -> DataFrame:
    """``(cls, linked)``: for each row of ``members(cls, copies, root, raw)``, with ``sizes(root, n)``, the copies of other classes of its
    root within the threshold."""
    return in_blocks(members, sizes, threshold, buckets, block, stored_as, False).groupBy("cls").agg(F.sum("linked").alias("linked"))


def in_blocks(members: DataFrame, sizes: DataFrame, threshold: float, buckets: int, block: int, stored_as: str, forest: bool) -> DataFrame:
    """All pairs inside each root verified, in pairs of blocks of at most ``block`` classes each.

    A task holds two blocks and emits one count per class, ``(cls, linked)``, or a spanning ``forest`` of links ``(a, b)``, never all pairs.
    """
    blocks = F.ceil(F.col("n") / F.lit(block))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # Components of one block share a group with others, told apart by root; larger ones have a group for each pair of blocks.
    together = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.xxhash64("root", low, high))
    dealt = (
        members.join(sizes.select("root", "n"), "root")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select(together.alias("g"), "root", F.when(low == high, 2).when(F.col("own") == low, 0).otherwise(1).alias("role"), "cls", "copies", "raw")
    )

    def count(batches):
        for table in whole_groups(batches, "g"):
            g, root, role = (table.column(c).to_numpy() for c in ("g", "root", "role"))
            cls, copies, raw = table.column("cls").to_numpy(), table.column("copies").to_numpy(), table.column("raw").to_pylist()
            cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (root[1:] != root[:-1]), True])
            total, ties = np.zeros(len(cls), np.int64), ([cls[:0]], [cls[:0]])
            for s, e in zip(cut[:-1], cut[1:]):
                sizes = np.array([len(r) for r in raw[s:e]])
                for size in np.unique(sizes):
                    at = s + np.flatnonzero(sizes == size)
                    x = _unit(_matrix([raw[i] for i in at], stored_as))
                    near = np.zeros((len(at), len(at)), bool)
                    near[:] = x @ x.T >= threshold
                    np.fill_diagonal(near, False)
                    kind = role[at]
                    if (kind != 2).any():
                        near &= kind[:, None] != kind[None, :]
                    if forest:
                        label = local_forest(len(at), *np.nonzero(near))
                        tied = np.flatnonzero(label != np.arange(len(at)))
                        ties[0].append(cls[at[tied]])
                        ties[1].append(cls[at[label[tied]]])
                    else:
                        total[at] = near @ copies[at]
            if forest:
                yield pa.record_batch([pa.array(np.concatenate(t), pa.int64()) for t in ties], names=["a", "b"])
            else:
                yield pa.record_batch([pa.array(cls), pa.array(total)], names=["cls", "linked"])

    shape = "a bigint, b bigint" if forest else "cls bigint, linked bigint"
    return dealt.repartition("g").sortWithinPartitions("g", "root").mapInArrow(count, shape)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding, ...)``.

    Equal vectors are first drawn together into classes; the passes link classes, components are the union over all
    passes, and inside each component every pair of classes is verified, so ``n_links`` counts all links of a component
    and not only those that fell into a window. ``passes`` follows from the number of classes and the direction that they
    share unless given.

    Null, empty, zero and non-finite vectors link with nothing: no links, their own id, kept. Vectors of unlike length
    never link. Rows that repeat a ``vec_id`` count as vectors of their own; a null ``vec_id`` gets the smallest id of its
    group. An empty table gives an empty result.
    """
    rows, stored_as = stored(usable(vectors), "vectors"), stored_kind(vectors)
    spark = rows.sparkSession
    grouped = rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # Numbers are fixed once the table is written, whatever runs again later.
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("cls"), "first", "copies", "raw"), "classes")
    n = classes.count()
    middle = means(classes, stored_as)
    shared = sum(k * float(m @ m) for k, m in middle.values()) / max(1, sum(k for k, _ in middle.values()))
    part, wanted = centring(n, threshold, shared, window)
    passes, off = passes or wanted, {size: part * m for size, (_, m) in middle.items()}
    parts = max(1, min(4096, n * passes // PER_PART))
    links = window_links(classes, threshold, passes, parts, window, stored_as, off)
    crowded = crowded_links(classes, threshold, passes, leading(n, window), window, BLOCK, stored_as, off)
    links = links if crowded is None else links.union(crowded)
    roots = stored(components(links).withColumnRenamed("node", "cls"), "roots")
    members = classes.join(roots, "cls")
    # Written before it is joined, so that the members of a large component can be split over tasks.
    sizes = stored(members.groupBy("root").agg(F.count("*").alias("n"), F.min("first").alias("least")), "sizes")
    degrees = class_degrees(members, sizes, threshold, max(8, n // PER_PART), BLOCK, stored_as)
    told = (
        classes.join(roots, "cls", "left")
        .join(degrees, "cls", "left")
        .join(sizes.select("root", "least"), "root", "left")
        .select("raw", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    )
    joined = rows.join(told, "raw", "left")
    own = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))

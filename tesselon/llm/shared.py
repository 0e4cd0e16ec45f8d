"""Pieces that several operators of this subpackage use: tables in the shared folder and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 60

#: What operators keep in a Python worker from task to task. Workers are reused, so it outlives the query that made it.
KEPT: list[dict] = []


def forget() -> None:
    """Let go of what earlier queries keep in this Python worker; those that need it again make it again."""
    if any(KEPT):
        for found in KEPT:
            found.clear()
        gc.collect()  # or most of the memory stays with the process


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``, or one of our own where all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-tesselon-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tesselon/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first one made from it by underscores that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``rows``, whose ``key`` is unique, by a hash of the key; all rows where those are no more.

    A table that is much larger is thinned by the hash first, so that about ``most`` rows meet in one task, whatever
    the number of partitions.
    """
    n = rows.count()
    if n <= most:
        return rows
    order = F.xxhash64(key)
    share = 1.05 * most / n + 4 * (most**0.5 + 4) / n
    thin = rows if share >= 1 else rows.where(F.pmod(order, F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return thin.orderBy(F.pmod(order, F.lit(1 << 40)), key).limit(most)


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a[i]``-``b[i]``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def whole_groups(batches, key: str):
    """Re-cut Arrow batches that arrive sorted by ``key`` so that no group crosses a cut. Holds one group and a batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def each_group(batches, key: str):
    """One table for each group of Arrow batches that arrive sorted by ``key``."""
    for table in whole_groups(batches, key):
        keys = table.column(key).to_numpy()
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for b, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield table.slice(b, e - b).combine_chunks()


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: one row ``(node, root)`` per linked node, root the smallest node reachable.

    Alternating large-star and small-star rounds over edges pointing from larger to smaller nodes. A round costs two
    joins on the number of links. Smallest neighbours come from partial aggregation and are written before they are
    joined, so both sides of a join have shuffles of their own and AQE can split the rows of a hub.
    Every round is written to the shared folder. Self links and repeated links are harmless; an empty table gives an
    empty result.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark[0] == 0 or mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "links")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    raise RuntimeError("components did not settle")

"""Running computations in the order of one key's rows, without a task per key: rows meet in short stretches of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselon.sources.files import scratch

STRETCH = 8192


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores until ``df`` has no column of it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def hours(df: DataFrame, at: str) -> Column:
    """The hour of a time as a number that grows with it; times that are null come first, as they do in a sort."""
    origin = F.lit("1970-01-01 00:00:00").cast(df.schema[at].dataType)
    return F.coalesce(F.floor(F.timestamp_diff("SECOND", origin, F.col(at)) / 3600), F.lit(-(1 << 40)))


def running(rows: DataFrame, by: str, bucket: Column, order: list, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the running sum of ``value`` over the rows of ``by`` in the order of ``bucket``, then ``order``.

    Sums per bucket come from partial aggregation; what lies before a bucket is added to the sum inside it. So a
    key that holds most rows is spread over its buckets.
    """
    b, key, before, total = (free(rows, n) for n in ("bucket", "key", "before", "total"))
    cut = rows.withColumn(b, bucket)
    sums = cut.groupBy(F.col(by).alias(key), F.col(b).alias(b + "_")).agg(F.sum(value).alias(total))
    earlier = W.partitionBy(key).orderBy(b + "_").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(key, b + "_", F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    joined = cut.join(sums, cut[by].eqNullSafe(F.col(key)) & (F.col(b) == F.col(b + "_")))
    inside = W.partitionBy(by, b).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn(out, F.col(before) + F.sum(value).over(inside)).drop(b, b + "_", key, before)


def ranked(rows: DataFrame, by: str, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: each row's place, from 1, among the rows of ``by`` in the full ``order``; rows without ``by`` are one group.

    Rows are dealt out by ranges of ``by`` and ``order``, cut at sampled rows, so that a key with most rows is spread whatever its values
    look like. Places inside a range are its row numbers; what earlier ranges hold of a key is added. The dealt rows are written, as ranges
    must not change between counting and numbering.
    """
    spark, place = rows.sparkSession, free(rows, "place")
    path = scratch(spark, "ranges")
    # Numbers of this kind hold the range above 33 bits and the row in it below.
    dealt = rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn(place, F.monotonically_increasing_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    part, key, first, before = (free(rows, n) for n in ("part", "key", "first", "before"))
    counts = dealt.groupBy(F.col(by).alias(key), F.shiftright(place, 33).alias(part)).agg(F.min(place).alias(first), F.count("*").alias("n"))
    earlier = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(key, part, first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    joined = dealt.join(counts, dealt[by].eqNullSafe(F.col(key)) & (F.shiftright(place, 33) == F.col(part)))
    return joined.withColumn(out, F.col(place) - F.col(first) + F.col(before) + 1).drop(place, key, part, first, before)


def over_last(rows: DataFrame, by: str, bucket: Column, order: list, n: int, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the aggregate ``value`` over a row and the ``n - 1`` rows before it in the order of its ``by``.

    Rows are numbered by ``running`` and dealt out in stretches of STRETCH; the last rows of a stretch are handed to the next.
    """
    place, part = free(rows, "place"), free(rows, "part")
    size = max(STRETCH, n)
    numbered = running(rows, by, bucket, order, F.lit(1), place)
    own = F.floor((F.col(place) - 1) / size)
    late = F.pmod(F.col(place) - 1, F.lit(size)) > size - n
    dealt = numbered.withColumn(part, F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = W.partitionBy(by, part).orderBy(place).rowsBetween(1 - n, 0)
    return dealt.withColumn(out, value.over(frame)).where(F.col(part) == own).drop(place, part)


def carried(rows: DataFrame, by: str, bucket: Column, order: Column, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null, at or before each row of ``by`` in the order of ``bucket``, then ``order``.

    ``bucket`` must not fall along ``order``. The last value of each bucket comes from partial aggregation and is handed on to the
    later ones, so that a key with most rows is spread over its buckets.
    """
    b, key, v, tail, before = (free(rows, n) for n in ("bucket", "key", "carried", "tail", "before"))
    cut = rows.withColumn(b, bucket).withColumn(v, value)
    tails = cut.groupBy(F.col(by).alias(key), F.col(b).alias(b + "_")).agg(F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(tail))
    earlier = W.partitionBy(key).orderBy(b + "_").rowsBetween(W.unboundedPreceding, -1)
    tails = tails.select(key, b + "_", F.last(tail, ignorenulls=True).over(earlier).alias(before))
    joined = cut.join(tails, cut[by].eqNullSafe(F.col(key)) & (F.col(b) == F.col(b + "_")))
    inside = W.partitionBy(by, b).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn(out, F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(before))).drop(b, b + "_", key, v, before)

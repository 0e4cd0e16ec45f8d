"""Node telemetry: latencies, status, liveness, load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselon.operators.ordered import free, hours, over_last, running

KEEP, GROUPS = 200, 20


ORDER = ["ts", "event_id"]


def latency_avg(log: DataFrame, n: int = KEEP) -> DataFrame:
    """Mean of a node's last ``n`` latencies at each event, errors included."""
    listed = over_last(log, "node_id", hours(log, "ts"), ORDER, n, F.avg("latency_ms"), "avg_latency_ms")
    return listed.withColumn("avg_latency_ms", F.round("avg_latency_ms", 9))


def exclusive_p95(values: Column) -> Column:
    """The 19th of 20 exclusive quantiles of a sorted array: linear between neighbours, the largest below 20 values, 0 for none."""
    n = F.size(values)
    place = F.lit(19) * (n + 1)
    j, rest = F.floor(place / 20).cast("int"), place % 20
    between = (F.element_at(values, j) * (F.lit(20) - rest) + F.element_at(values, j + 1) * rest) / F.lit(20.0)
    return F.when(n == 0, 0.0).when(n < GROUPS, F.element_at(values, -1)).otherwise(between)


def latency_p95(log: DataFrame, n: int = KEEP) -> DataFrame:
    """The exclusive 95th percentile of a node's last ``n`` latencies at each event."""
    seen = free(log, "seen")
    listed = over_last(log, "node_id", hours(log, "ts"), ORDER, n, F.collect_list("latency_ms"), seen)
    listed = listed.withColumn(seen, F.sort_array(seen))
    return listed.withColumn("p95_latency_ms", F.round(exclusive_p95(F.col(seen)), 6)).drop(seen)


def status_basic(busy: Column, total: Column) -> tuple[Column, Column]:
    held = F.least(F.greatest(busy, F.lit(0)), total)
    return held, F.when(held > 0, "BUSY").otherwise("IDLE")


def status_full(active: Column, steal_age_s: Column, busy: Column, queued: Column) -> Column:
    return F.when(~active, "ERROR").when(steal_age_s <= 5, "STEALING").when((busy > 0) | (queued > 0), "BUSY").otherwise("IDLE")


def busy_running(beats: DataFrame) -> DataFrame:
    """Adds ``busy``: the running sum of a node's ``busy_delta``."""
    return running(beats, "node_id", hours(beats, "ts"), ORDER, F.col("busy_delta"), "busy")


def node_snapshot(beats: DataFrame, high_water: int, max_queue: int) -> DataFrame:
    """Latest metrics per node with counters: everything in one aggregation."""
    last = F.max_by(F.struct("queue_size", "workers_busy", "workers_total", "cpu_percent", "accepting"), F.struct("ts", "event_id"))
    s = beats.groupBy("node_id").agg(last.alias("m"), F.count("*").alias("beats"), F.count_if("stole").alias("steals"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    capacity = F.lit(min(high_water, max_queue))
    return s.select(
        "node_id", "m.*", "beats", "steals", F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")).alias("uptime_s"), capacity.alias("capacity"),
        F.greatest(capacity - F.col("m.queue_size"), F.lit(0)).alias("slots_free"),
    )


def readiness(active: Column, accepting: Column, queued: Column, high_water: int, free_bytes: Column, min_free: int) -> Column:
    return F.when(active & accepting & (queued < high_water) & (free_bytes > min_free), "READY").otherwise("NOT_READY")


def registrations(beats: DataFrame) -> DataFrame:
    """Adds ``result``: a node's first beat registers it, later ones update. The first is found by aggregation, one row per node."""
    key, first = free(beats, "key"), free(beats, "first")
    firsts = beats.groupBy(F.col("node_id").alias(key)).agg(F.min(F.struct(*ORDER)).alias(first))
    joined = beats.join(firsts, beats["node_id"].eqNullSafe(F.col(key)))
    return joined.withColumn("result", F.when(F.struct(*ORDER) == F.col(first), "REGISTERED").otherwise("UPDATED")).drop(key, first)


def dead_spans(beats: DataFrame, interval_s: float, misses: int = 3, as_of: Column | None = None) -> DataFrame:
    """``(node_id, dead_from, dead_until)``: gaps in which ``misses`` beats in a row are missing, that is longer ones than as many intervals.

    A node that beats no more is dead from its last beat on, with a null end, if that is longer ago at ``as_of`` (without one: the
    last beat of any node). The next beat is looked up inside the hour; the last one of an hour takes the first of the node's next hour
    with beats. Beats without a time say nothing.
    """
    cut = beats.where("ts is not null").select("node_id", *ORDER).withColumn("hour", hours(beats, "ts"))
    now = cut.agg(F.max("ts").alias("now")) if as_of is None else cut.sparkSession.range(1).select(as_of.alias("now"))
    heads = cut.groupBy(F.col("node_id").alias("key"), F.col("hour").alias("at")).agg(F.min("ts").alias("head"))
    heads = heads.select("key", "at", F.lead("head").over(W.partitionBy("key").orderBy("at")).alias("after"))
    joined = cut.join(heads, cut["node_id"].eqNullSafe(F.col("key")) & (F.col("hour") == F.col("at")))
    nxt = F.coalesce(F.lead("ts").over(W.partitionBy("node_id", "hour").orderBy(*ORDER)), "after")
    gaps = joined.select("node_id", F.col("ts").alias("dead_from"), nxt.alias("dead_until")).join(F.broadcast(now))
    silent = F.timestamp_diff("MICROSECOND", F.col("dead_from"), F.coalesce("dead_until", "now"))
    return gaps.where(silent > int(interval_s * misses * 1e6)).drop("now")


def requeue_rows(tasks: DataFrame, spans: DataFrame, as_of: Column, assigned: str = "ts", finished: str = "finished_at") -> DataFrame:
    """Tasks that a node had open while it was dead, handed to it before or meanwhile: ``tasks`` with the span's ends, a row for each such span.

    A task is open from ``assigned`` until ``finished``, without an end for good; a span without an end lasts. Both are cut into days and
    meet by node and day, where the later of their beginnings lies, so that a node's whole history never meets itself.
    Nothing after ``as_of`` is looked at.
    """
    day = lambda c: F.date_trunc("day", c.cast("timestamp"))

    def by_day(df: DataFrame, since: str, until: str) -> DataFrame:
        last = F.least(F.coalesce(F.col(until), as_of), as_of)
        return df.where(F.col(since) <= as_of).withColumn("day", F.explode(F.sequence(day(F.col(since)), F.greatest(day(last), day(F.col(since))), F.expr("interval 1 day"))))

    keyed = by_day(tasks, assigned, finished).join(by_day(spans, "dead_from", "dead_until"), ["node_id", "day"])
    meet = (F.col(finished).isNull() | (F.col(finished) > F.col("dead_from"))) & (F.col("dead_until").isNull() | (F.col(assigned) < F.col("dead_until")))
    return keyed.where(meet & (F.col("day") == day(F.greatest(assigned, "dead_from")))).drop("day")


def queue_status(beats: DataFrame, as_of: Column, capacity: int) -> DataFrame:
    """One row: the central queue and each node's, as last heard at ``as_of``."""
    last = F.max_by(F.struct("queue_size", "queue_capacity", "workers_busy"), F.struct("ts", "event_id"))
    nodes = beats.where(F.col("ts") <= as_of).groupBy("node_id").agg(last.alias("q"))
    listed = F.array_sort(F.collect_list(F.struct("node_id", "q.queue_size", "q.queue_capacity", "q.workers_busy")))
    return nodes.agg(F.coalesce(F.sum("q.queue_size"), F.lit(0)).alias("central_size"), F.lit(capacity).alias("central_capacity"), listed.alias("nodes"))


def imbalance_pairs(snapshot: DataFrame, capacity: int) -> DataFrame:
    """``(idle_node, busy_node, share)``: for each idle node the fullest other one, and how much it may take.

    The fullest and the second fullest node suffice for all idle ones, so nothing is paired with everything: the two are found
    by aggregation and joined as one row.
    """
    loaded = snapshot.where(F.col("queue_size") > 1)
    two = loaded.orderBy(F.desc("queue_size"), "node_id").limit(2).agg(F.array_sort(F.collect_list(F.struct((-F.col("queue_size")).alias("q"), "node_id"))).alias("top"))
    idle = snapshot.where((F.col("workers_busy") == 0) & (F.col("queue_size") <= 1))
    pick = F.get(F.filter("top", lambda t: t["node_id"] != F.col("idle_node")), F.lit(0))
    paired = idle.select(F.col("node_id").alias("idle_node"), F.col("queue_size").alias("own")).join(F.broadcast(two)).withColumn("pick", pick)
    allowed = -F.col("pick.q") > max(capacity // 2, 1)
    share = F.least(F.greatest(F.lit(capacity) - F.col("own"), F.lit(1)), F.greatest(-F.col("pick.q") - capacity // 2, F.lit(0)))
    return paired.where("pick is not null").select("idle_node", F.col("pick.node_id").alias("busy_node"), F.when(allowed, share).otherwise(0).alias("share"))

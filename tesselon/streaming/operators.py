"""Structured Streaming operators. Each takes a streaming DataFrame; ``drained`` runs one over what is there now."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tesselon.operators.requests import normalize_filters, reject_bad_filters, validate_requests
from tesselon.sources.files import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table of ``folder``, one file or a folder of files, as a stream of its files, a bounded number of them per batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # A pattern, since a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run ``stream`` to the end of what is available and return all that it gave, with ``batch_id``.

    Batches are written by their number, so a batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        (each or (lambda b, n: None))(batch, number)
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(schema).parquet(f"{path}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key: a table kept by upserts."""
    columns = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select(*keys, "r.*")


def stream_latest_node(beats: DataFrame) -> DataFrame:
    """Latest metrics per node; run in update mode and read by ``latest``."""
    last = F.max_by(F.struct("queue_size", "workers_busy", "cpu_percent"), F.struct("ts", "event_id"))
    return beats.groupBy("node_id").agg(last.alias("m"), F.count("*").alias("beats")).select("node_id", "m.*", "beats")


class KeptTasks(StatefulProcessor):
    """State per bucket of keys: for each key the task that runs and when it completed, null while it is in flight. A timer, set for the
    first key of the bucket to expire, takes the keys away whose time to live, counted from completion, lies behind the watermark."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", "key array<string>, task array<bigint>, done array<bigint>, wake bigint")

    def held(self) -> tuple[dict, int | None]:
        """``(task, done)`` by key, and when the timer is set for."""
        if not self.state.exists():
            return {}, None
        keys, tasks, done, wake = self.state.get()
        return dict(zip(keys, zip(tasks, done))), wake

    def keep(self, held: dict, wake: int | None) -> None:
        """Write ``held``; ``wake`` is when the timer is set for."""
        first = min((done for _, done in held.values() if done is not None), default=None)
        due = None if first is None else self.expiry(first)
        if due != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if due is not None:
                self.handle.registerTimer(due)
        if held:
            self.state.update((list(held), [task for task, _ in held.values()], [done for _, done in held.values()], due))
        else:
            self.state.clear()

    def expiry(self, done: int) -> int:
        return (done + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        held, wake = self.held()
        batch = pd.concat(list(rows)).sort_values(["at", "completes", "task_id"])
        keys = batch["idempotency_key"].astype(object)
        tasks, reuses = [], []
        for name, at, completes, own in zip(keys.where(keys.notna(), None).tolist(), batch["at"].tolist(), batch["completes"].tolist(), batch["task_id"].tolist()):
            task, done = held.get(name, (None, None))
            if completes:
                if own == task and done is None:
                    held[name] = task, at
            elif task is None or (done is not None and at > done + self.ttl):
                held[name] = own, None
                tasks.append(own)
                reuses.append(None)
            else:
                tasks.append(own)
                reuses.append(task)
        self.keep(held, wake)
        yield pd.DataFrame({"task_id": pd.array(tasks, "Int64"), "reuses": pd.array(reuses, "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, wake = self.held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        live = {name: (task, done) for name, (task, done) in held.items() if done is None or self.expiry(done) > now}
        # The timer at hand is gone by itself.
        self.keep(live, None if wake == expiredTimerInfo.getExpiryTimeInMs() else wake)
        return iter(())

    def close(self) -> None:
        pass


def task_events(tasks: DataFrame) -> DataFrame:
    """Tasks ``(task_id, idempotency_key, created_at, finished_at)`` as what happens to them: ``(idempotency_key, task_id, ts, completes)``,
    their arrival and, if they finished, their completion."""
    event = lambda at, done: F.struct(F.col(at).cast("timestamp").alias("ts"), F.lit(done).alias("completes"))
    return tasks.select("idempotency_key", "task_id", F.inline(F.array(event("created_at", False), event("finished_at", True)))).where("ts is not null")


def stream_dedupe(events: DataFrame, ttl_days: int, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """``(task_id, reuses)`` for each task as it arrives: the task whose result it reuses, null if it runs itself.

    As `dedupe_ttl`: the time to live runs from the completion of the task that ran, one in flight never expires. A batch counts in time
    order; what is more than ``late`` behind the newest event is dropped, what comes late within it is decided when it comes. Keys, told
    apart by their text, are dealt into ``buckets`` by a hash, so that Python and the state store are called for each bucket of a batch and not for
    each key; a bucket's events of one batch, four narrow columns, and its live keys are in one task, and what a stream was started with stays its number.
    Needs the RocksDB state store; keys may be null and are one key then.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    name = F.col("idempotency_key").cast("string")
    bucket = F.pmod(F.xxhash64(name), F.lit(buckets)).alias("bucket")
    keyed = events.withWatermark("ts", late).select(bucket, name.alias("idempotency_key"), "task_id", "ts", F.unix_micros("ts").alias("at"), "completes")
    kept = KeptTasks(ttl_days * 86_400_000_000)
    return keyed.groupBy("bucket").transformWithStateInPandas(kept, outputStructType="task_id bigint, reuses bigint", outputMode="append", timeMode="EventTime")


def stream_heartbeat_sessions(beats: DataFrame, gap: str) -> DataFrame:
    """Liveness periods ``(node_id, alive_from, alive_until, beats)``: a gap without beats ends one. Run in complete mode."""
    s = beats.withWatermark("ts", gap).groupBy("node_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("beats"))
    return s.select("node_id", F.col("s.start").alias("alive_from"), F.col("s.end").alias("alive_until"), "beats")


def progress_upsert(log: DataFrame) -> DataFrame:
    """Latest progress per task, in a table that every batch is merged into.

    A batch is reduced to its newest row per task and merged with the table as the batch before left it; the merged table is a version
    under the batch's number, so a batch that is run again after a failure starts from the same table and replaces its own version.
    """
    spark, path = log.sparkSession, scratch(log.sparkSession, "progress")
    columns = ["state", "attempt", "ts", "event_id"]
    kept = log.select("task_id", *columns)
    newest = lambda rows: rows.groupBy("task_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("r")).select("task_id", "r.*")
    schema, last = kept.schema, [-1]

    def merge(batch: DataFrame, number: int) -> None:
        rows = newest(batch)
        if number > 0:
            rows = newest(spark.read.schema(schema).parquet(f"{path}/table/version={number - 1}").select(*schema.names).union(rows))
        rows.write.mode("overwrite").parquet(f"{path}/table/version={number}")
        last[0] = number

    kept.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], schema).select("task_id", "state", "attempt")
    return spark.read.schema(schema).parquet(f"{path}/table/version={last[0]}").select("task_id", "state", "attempt")


class MovingAverage(StatefulProcessor):
    """Moving average per signature; state is the average and the number of observations. Rows of a batch count in time order."""

    def __init__(self, alpha: float = 0.35):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "ema double, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        ema, n = self.state.get() if self.state.exists() else (0.0, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for v in batch["latency_ms"]:
            ema = (1.0 - self.alpha) * ema + self.alpha * v if ema > 0 else float(v)
        n += len(batch)
        self.state.update((ema, n))
        yield pd.DataFrame({"signature": [key[0]], "ema_ms": [ema], "n": [n]})

    def close(self) -> None:
        pass


def stream_ema(log: DataFrame, alpha: float = 0.35) -> DataFrame:
    """``(signature, ema_ms, n)`` after each batch; run in update mode under the RocksDB state store."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kept = log.select("signature", "ts", "event_id", "latency_ms")
    return kept.groupBy("signature").transformWithStateInPandas(MovingAverage(alpha), outputStructType="signature string, ema_ms double, n bigint", outputMode="update", timeMode="none")


def stream_normalize(requests: DataFrame) -> DataFrame:
    """Requests with ``reason``: null for those to process, else why they go to quarantine. Stateless."""
    judged = reject_bad_filters(normalize_filters(requests)).withColumnRenamed("reason", "bad_filter")
    return validate_requests(judged).withColumn("reason", F.coalesce("reason", "bad_filter"))


def two_sinks(accepted: str, quarantine: str) -> Callable[[DataFrame, int], None]:
    """For ``drained``: write both kinds of a batch to their own tables, by batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("reason is null").write.mode("overwrite").parquet(f"{accepted}/batch_id={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{quarantine}/batch_id={number}")
        batch.unpersist()

    return write

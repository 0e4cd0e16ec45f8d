"""The log of tasks and results: dedupe, catalog lookups, state histories, retries, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselon.operators.ordered import carried
from tesselon.sources.files import scratch

TERMINAL = ("succeeded", "failed", "cancelled", "rejected")


#: Tasks of one key that are folded as one array; keys with more are followed by links.
FOLDED = 4096
_LAST = (1 << 63) - 1


def dedupe_ttl(tasks: DataFrame, ttl_days: int, folded: int = FOLDED) -> DataFrame:
    """``(task_id, reuses)``: the task whose result each one reuses, null for tasks that run themselves.

    A task reuses the last one of its key that ran, unless that one finished more than the time to live before;
    one in flight never expires. The anchor is the *kept* task, so this is a fold in order and not a lag. A key of up to ``folded`` tasks
    is folded as one array, three narrow fields per task; `dedupe_linked` takes the others. Tasks are ordered by time and id,
    those without a time first; tasks without a key are one key.
    """
    narrow = tasks.select("idempotency_key", "created_at", "task_id", "finished_at")
    large = narrow.groupBy("idempotency_key").agg(F.count("*").alias("n")).where(F.col("n") > folded).select(F.col("idempotency_key").alias("key"))
    if large.first() is None:
        return dedupe_folded(narrow, ttl_days)
    # Few by number, as each has more than ``folded`` tasks; written, so that their sizes are known where they are joined.
    path = scratch(tasks.sparkSession, "keys")
    large.write.parquet(path)
    large = tasks.sparkSession.read.schema(large.schema).parquet(path)
    same = narrow["idempotency_key"].eqNullSafe(large["key"])
    return dedupe_folded(narrow.join(large, same, "left_anti"), ttl_days).union(dedupe_linked(narrow.join(large, same, "left_semi"), ttl_days))


def dedupe_linked(tasks: DataFrame, ttl_days: int) -> DataFrame:
    """As `dedupe_ttl`, with no more than an hour of a key in one task.

    Each task has a link to the first one past its time to live. Those that run are the ones on the way from a key's first task along the
    links; links are doubled each round, so that a way of n tasks takes log2(n) rounds. Each round is written.
    """
    spark, micros = tasks.sparkSession, lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))

    def kept(df: DataFrame, tag: str) -> DataFrame:
        path = scratch(spark, tag)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    place = W.partitionBy("idempotency_key", "created_at", "task_id").orderBy(F.col("finished_at").asc_nulls_first())
    node = F.struct(F.coalesce(micros("created_at"), F.lit(-(1 << 62))).alias("at"), F.col("task_id").cast("bigint").alias("id"), F.row_number().over(place).cast("bigint").alias("copy"))
    rows = kept(tasks.select("idempotency_key", node.alias("node"), (micros("finished_at") + ttl_days * 86_400_000_000).alias("until"), "task_id"), "nodes")
    # Rows and searches in one falling order: the last row before a search is the first one past it.
    at, own = F.col("node.at"), F.struct("node.at", "node.id", "node.copy")
    past = F.when(F.col("until") >= at, F.struct(F.col("until").alias("at"), F.lit(_LAST).alias("id"), F.lit(_LAST).alias("copy"))).otherwise(own)
    both = rows.select("idempotency_key", own.alias("pos"), F.lit(0).alias("asks"), "node").union(rows.where("until is not null").select("idempotency_key", past.alias("pos"), F.lit(1).alias("asks"), "node"))
    falling = F.struct(-F.col("pos.at"), -F.col("pos.id"), -F.col("pos.copy"), -F.col("asks"))
    links = carried(both, "idempotency_key", -F.floor(F.col("pos.at") / 3_600_000_000), falling, F.when(F.col("asks") == 0, F.col("node")), "next")
    links = kept(links.where("asks = 1 and next is not null").select("idempotency_key", "node", "next"), "links")
    runs = kept(rows.groupBy("idempotency_key").agg(F.min("node").alias("node")), "runs")
    while True:
        far = links.select(F.col("idempotency_key").alias("k"), F.col("node").alias("via"), F.col("next").alias("to"))
        joined = lambda df, c: df.join(far, df["idempotency_key"].eqNullSafe(F.col("k")) & (df[c] == F.col("via")))
        more = kept(joined(runs, "node").select("idempotency_key", F.col("to").alias("node")), "more")
        if more.first() is None:
            break
        runs = kept(runs.union(more), "runs")
        links = kept(joined(links, "next").select("idempotency_key", "node", F.col("to").alias("next")), "links")
    marked = rows.join(runs.select(F.col("idempotency_key").alias("k"), F.col("node").alias("run")), rows["idempotency_key"].eqNullSafe(F.col("k")) & (rows["node"] == F.col("run")), "left").drop("k")
    told = carried(marked, "idempotency_key", F.floor(at / 3_600_000_000), own, F.col("run"), "anchor")
    return told.select("task_id", F.when(F.col("run").isNull(), F.col("anchor.id")).alias("reuses"))


def dedupe_folded(tasks: DataFrame, ttl_days: int) -> DataFrame:
    """As `dedupe_ttl`, each key's history as one array."""
    seen = F.array_sort(F.collect_list(F.struct("created_at", "task_id", "finished_at")))
    keyed = tasks.groupBy("idempotency_key").agg(seen.alias("seen"))
    item = "struct<task_id:bigint,reuses:bigint>"
    kind = "struct<kept:bigint,until:timestamp_ntz,out:array<" + item + ">>"
    start = F.struct(F.lit(None).cast("bigint").alias("kept"), F.lit(None).cast("timestamp_ntz").alias("until"), F.array().cast(f"array<{item}>").alias("out")).cast(kind)

    def step(acc, t):
        again = acc["kept"].isNotNull() & (acc["until"].isNull() | (t["created_at"] <= acc["until"]))
        fresh_until = t["finished_at"] + F.make_dt_interval(F.lit(ttl_days))
        one = F.array(F.struct(t["task_id"].alias("task_id"), F.when(again, acc["kept"]).alias("reuses")))
        return F.struct(
            F.when(again, acc["kept"]).otherwise(t["task_id"]).alias("kept"), F.when(again, acc["until"]).otherwise(fresh_until).alias("until"), F.concat(acc["out"], one).alias("out")
        ).cast(kind)

    return keyed.select(F.inline(F.aggregate("seen", start, step, lambda acc: acc["out"])))


def dedupe_active(incoming: DataFrame, active: DataFrame) -> DataFrame:
    """Tasks that are not in flight, each once: the first by time and event."""
    fresh = incoming.join(active.select("task_id"), "task_id", "left_anti")
    return fresh.groupBy("task_id").agg(F.min(F.struct("ts", "event_id")).alias("first")).select("task_id", "first.event_id")


def pending_tasks(pending: DataFrame, completed: DataFrame) -> DataFrame:
    return pending.join(completed.select("idempotency_key"), "idempotency_key", "left_anti")


def restore_completed(results: DataFrame, as_of: Column, ttl_days: int) -> DataFrame:
    return results.where(F.col("finished_at").between(as_of - F.make_dt_interval(F.lit(ttl_days)), as_of))


def unacked_events(progress: DataFrame, results: DataFrame, acks: DataFrame) -> DataFrame:
    """Spooled rows of both kinds without an acknowledgement."""
    spool = progress.withColumn("kind", F.lit("progress")).unionByName(results.withColumn("kind", F.lit("result")), allowMissingColumns=True)
    return spool.join(acks.select("event_id"), "event_id", "left_anti")


def terminal_results(results: DataFrame) -> DataFrame:
    """Results in a terminal state, newest first, those without an end last."""
    return results.where(F.col("status").isin(*TERMINAL)).orderBy(F.desc_nulls_last("finished_at"), "task_id")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def find_by_source_name(results: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, task_id)``: for each distinct name (trimmed, whatever its case) the newest result that has it as its source
    or as its output file."""
    wanted = names.select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    keys = [results.select(F.lower(F.trim(c)).alias("name"), "task_id", "finished_at") for c in (F.col("source_file_name"), basename(F.col("output_path")))]
    hits = keys[0].union(keys[1]).join(wanted, "name")
    newest = F.max_by("task_id", F.struct(F.coalesce("finished_at", F.lit("0001-01-01").cast("timestamp_ntz")), "task_id"))
    return hits.groupBy("name").agg(newest.alias("task_id"))


def success_paths(results: DataFrame) -> DataFrame:
    return results.where((F.col("status") == "succeeded") & F.col("output_path").isNotNull()).select("task_id", "output_path")


def latest_state(log: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("state", "attempt", "latency_ms"), F.struct("ts", "event_id"))
    return log.groupBy("task_id").agg(last.alias("s"), F.count("*").alias("events")).select("task_id", "s.state", "s.attempt", "s.latency_ms", "events")


def _ms(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", earlier, later)


def state_timeline(log: DataFrame) -> DataFrame:
    """Per task the first time of each state, the wait from queued to running and the run to the first end."""
    first = lambda *states: F.min(F.when(F.col("state").isin(*states), F.col("ts")))
    t = log.groupBy("task_id").agg(first("queued").alias("queued_at"), first("admitted").alias("admitted_at"), first("running").alias("running_at"), first("succeeded", "failed").alias("ended_at"))
    return t.withColumn("queue_wait_ms", _ms(F.col("running_at"), F.col("queued_at"))).withColumn("run_time_ms", _ms(F.col("ended_at"), F.col("running_at")))


def classify_failures(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("outcome", F.when(F.col("attempt") < F.col("max_retries"), "retry_scheduled").otherwise("failed"))


def retry_schedule(attempt: Column, base_ms: int = 500, max_ms: int = 15000) -> tuple[Column, Column, Column]:
    """Delay before the ``attempt``-th retry, and the bounds that a jitter of up to a fifth gives it."""
    delay = F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(float(max_ms)))
    return delay, delay, delay * 1.2


def deadline_misses(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("finished_at") > F.col("deadline"))


def outcome_counters(log: DataFrame) -> DataFrame:
    each = [F.count_if(F.col("state") == s).alias(s) for s in ("queued", "admitted", "running", "succeeded", "failed")]
    return log.groupBy("node_id").agg(*each, F.count_if((F.col("state") == "failed") & (F.col("attempt") > 0)).alias("retried"))


def log_events(log: DataFrame) -> DataFrame:
    return log.where("level <> 'DEBUG'").groupBy("node_id", "level", F.col("attempt").alias("step")).agg(F.count("*").alias("messages"))


def to_wire_result(tasks: DataFrame) -> DataFrame:
    millis = lambda c: F.coalesce(F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c)), F.lit(0))
    node = F.col("node_id").cast("string")
    spent = F.coalesce(_ms(F.col("finished_at"), F.col("created_at")), F.lit(0))
    return tasks.select(
        "task_id", (F.col("status") == "succeeded").alias("success"), F.concat(node, F.lit("-worker")).alias("worker_id"),
        millis("created_at").alias("start_ts"), millis("finished_at").alias("finish_ts"), spent.alias("processing_ms"),
    )


def statistics_map(metrics: DataFrame, live: DataFrame) -> DataFrame:
    """``(node_id, stats)``: ``metrics(node_id, name, value)`` as a map, overlaid by the gauges of ``live(node_id, name, value)``.
    A name that repeats keeps its largest value."""
    ranked = metrics.withColumn("rank", F.lit(0)).unionByName(live.withColumn("rank", F.lit(1)))
    one = ranked.groupBy("node_id", "name").agg(F.max_by("value", F.struct("rank", "value")).alias("value"))
    return one.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("stats"))


def two_tier(completed: DataFrame, legacy: DataFrame) -> DataFrame:
    """One record per ``idempotency_key`` from two tiers; the legacy tier wins where both have the key, the last line inside a tier."""
    both = completed.withColumn("tier", F.lit(0)).unionByName(legacy.withColumn("tier", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "idempotency_key"]
    best = both.groupBy("idempotency_key").agg(F.max_by(F.struct(*columns), F.struct("tier", "line")).alias("r"))
    return best.select("idempotency_key", "r.*")

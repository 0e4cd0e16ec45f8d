"""Registered queries over task logs and node telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.operators import tasklog as t
from tesselon.operators import telemetry as e
from tesselon.operators.requests import params_text
from tesselon.plans.requests import AS_OF, TTL_DAYS, as_of
from tesselon.sources import views
from tesselon.sources.views import sql

MIB = 1024 * 1024
BEAT_S = 60.0
#: Node 7 falls silent for good on this day, so that spans without an end are there.
SILENT, E9_AS_OF = "2024-01-20", "2024-02-01"
GAPS = f"""SELECT node_id, ts AS dead_from, n AS dead_until FROM (
      SELECT *, lead(ts) OVER (PARTITION BY node_id ORDER BY ts, event_id) AS n, max(ts) OVER () AS now FROM heartbeats WHERE node_id <> 7 OR ts < TIMESTAMP '{SILENT}')
      WHERE epoch_us(coalesce(n, now)) - epoch_us(ts) > {int(BEAT_S * 60 * 3 * 1e6)}"""


def results(spark, sf) -> DataFrame:
    """Result rows: a task's source and output files."""
    q = views.requests(spark, sf).select(F.col("request_id").alias("task_id"), F.col("file_name").alias("source_file_name"))
    path = F.when(F.col("status") == "succeeded", F.concat(F.lit("/out/"), F.col("task_id").cast("string"), F.lit(".png")))
    return views.tasks(spark, sf).join(q, "task_id").withColumn("output_path", path)


def l1(spark, sf):
    return t.dedupe_ttl(views.tasks(spark, sf), TTL_DAYS).select("task_id", F.coalesce("reuses", "task_id").alias("result_of"))


def l2(spark, sf):
    return t.dedupe_active(views.task_log(spark, sf).where("state = 'queued'"), views.tasks(spark, sf).where("status = 'running'"))


def l3(spark, sf):
    tasks = views.tasks(spark, sf)
    return t.pending_tasks(tasks.where("status = 'queued'"), tasks.where("status = 'succeeded' and finished_at < timestamp_ntz'1997-01-01'")).select("task_id", "idempotency_key")


def l4(spark, sf):
    return t.restore_completed(views.tasks(spark, sf), as_of(), 365).select("task_id", "idempotency_key")


def l5(spark, sf):
    log = views.task_log(spark, sf)
    progress = log.where("state in ('queued', 'admitted', 'running')").select("event_id", "task_id", "state")
    ended = log.where("state in ('succeeded', 'failed')").select("event_id", "task_id", "latency_ms")
    return t.unacked_events(progress, ended, log.where("attempt = 0")).select("event_id", "task_id", "state", "latency_ms", "kind")


def l6(spark, sf):
    return t.terminal_results(views.tasks(spark, sf)).select("task_id", "status", "finished_at")


def l7(spark, sf):
    names = views.table(spark, sf, "customer").select(F.concat(F.lit(" IMG_"), F.col("c_custkey").cast("string"), F.lit(".png ")).alias("name"))
    more = views.table(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".PNG")).alias("name"))
    return t.find_by_source_name(results(spark, sf), names.union(more))


def l8(spark, sf):
    return t.success_paths(results(spark, sf))


def l9(spark, sf):
    return t.latest_state(views.task_log(spark, sf))


def l10(spark, sf):
    return t.state_timeline(views.task_log(spark, sf))


def l11(spark, sf):
    return t.classify_failures(views.tasks(spark, sf)).select("task_id", "outcome")


def l12(spark, sf):
    delay, low, high = t.retry_schedule(F.col("attempt") + F.col("priority"))
    return views.tasks(spark, sf).select("task_id", delay.alias("delay_ms"), low.alias("least_ms"), F.round(high, 6).alias("most_ms"))


def l13(spark, sf):
    return t.deadline_misses(views.tasks(spark, sf)).select("task_id", "node_id")


def l14(spark, sf):
    return t.outcome_counters(views.task_log(spark, sf))


def l15(spark, sf):
    return t.log_events(views.task_log(spark, sf))


def l16(spark, sf):
    return t.to_wire_result(views.tasks(spark, sf))


def l17(spark, sf):
    log, beats = views.task_log(spark, sf), views.heartbeats(spark, sf)
    metrics = log.groupBy("node_id", F.col("state").alias("name")).agg(F.count("*").cast("double").alias("value"))
    live = beats.groupBy("node_id").agg(F.max("queue_size").cast("double").alias("value")).select("node_id", F.lit("queued").alias("name"), "value")
    stats = t.statistics_map(metrics, live)
    return stats.select("node_id", params_text(F.transform_values("stats", lambda k, v: v.cast("bigint").cast("string"))).alias("stats"))


def k5(spark, sf):
    """Task records through their JSON form and back: bytes as base64, times as ISO texts, defaults for what is missing."""
    from tesselon.sources.records import parse_task_records, task_records

    records = parse_task_records(task_records(views.requests(spark, sf).join(views.tasks(spark, sf).select(F.col("task_id").alias("request_id"), "priority", "created_at"), "request_id")))
    return records.select("task_id", "filename", "priority", "max_retries", "enqueued_at", F.sha2("payload", 256).alias("payload_sha256"))


def k6(spark, sf):
    tasks = views.tasks(spark, sf)
    record = lambda df: df.select("idempotency_key", "task_id", "status", F.col("task_id").alias("line"))
    return t.two_tier(record(tasks.where("status = 'succeeded'")), record(tasks.where("status = 'running'"))).select("idempotency_key", "task_id", "status", "tier")


def e1(spark, sf):
    return e.latency_avg(views.task_log(spark, sf)).select("event_id", "node_id", "avg_latency_ms")


def e2(spark, sf):
    return e.latency_p95(views.task_log(spark, sf)).select("event_id", "node_id", "p95_latency_ms")


def e3(spark, sf):
    held, status = e.status_basic(F.col("workers_busy") + F.col("busy_delta"), F.col("workers_total"))
    return views.heartbeats(spark, sf).select("event_id", held.alias("busy"), status.alias("status"))


def e4(spark, sf):
    return views.heartbeats(spark, sf).select("event_id", e.status_full(F.col("accepting"), F.when(F.col("stole"), 1).otherwise(60), F.col("workers_busy"), F.col("queue_size")).alias("status"))


def e5(spark, sf):
    return e.busy_running(views.heartbeats(spark, sf)).select("event_id", "node_id", "busy")


def e6(spark, sf):
    return e.node_snapshot(views.heartbeats(spark, sf), 5, 6)


def e7(spark, sf):
    free = F.col("queue_size") * 100 * MIB
    return views.heartbeats(spark, sf).select("event_id", e.readiness(F.lit(True), F.col("accepting"), F.col("queue_size"), 5, free, 256 * MIB).alias("readiness"))


def e8(spark, sf):
    return e.registrations(views.heartbeats(spark, sf)).select("event_id", "node_id", "result")


def _spans(spark, sf):
    heard = (F.col("node_id") != 7) | (F.col("ts") < F.lit(SILENT).cast("timestamp_ntz"))
    return e.dead_spans(views.heartbeats(spark, sf).where(heard), BEAT_S * 60)


def e9(spark, sf):
    """Tasks from events: assigned seven minutes after, most of them finished some minutes later."""
    at, number = F.col("ts"), F.col("event_id")
    minutes = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))
    events = views.table(spark, sf, "events")
    done = F.when(number % 11 != 0, at + minutes(F.lit(7) + number % 300))
    log = events.select((number + 1).alias("task_id"), ((F.col("user_id") + 3) % 8).alias("node_id"), (at + minutes(F.lit(7))).alias("ts"), done.alias("finished_at"))
    return e.requeue_rows(log, _spans(spark, sf), F.lit(E9_AS_OF).cast("timestamp_ntz")).select("node_id", "task_id", "dead_from", "dead_until")


def e9_gaps(spark, sf):
    return _spans(spark, sf)


def e10(spark, sf):
    q = e.queue_status(views.heartbeats(spark, sf), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 100)
    text = F.transform("nodes", lambda n: F.concat_ws(":", n["node_id"].cast("string"), n["queue_size"].cast("string"), n["queue_capacity"].cast("string"), n["workers_busy"].cast("string")))
    return q.select("central_size", "central_capacity", F.array_join(text, ",").alias("nodes"))


def _load(spark, sf) -> DataFrame:
    """Queue lengths by half of the nodes' users, so that idle and loaded nodes occur."""
    b = views.table(spark, sf, "events").groupBy((F.col("user_id") % 64).alias("node_id")).agg(F.count_if(F.col("event_type") == "signup").alias("a"), F.count_if(F.col("event_type") == "error").alias("b"))
    return b.select("node_id", (F.col("a") % 7).alias("queue_size"), (F.col("b") % 3).alias("workers_busy"))


def e11(spark, sf):
    return e.imbalance_pairs(_load(spark, sf), 6)


RESULTS = """, results AS (SELECT t.*, q.file_name AS source_file_name, CASE WHEN t.status = 'succeeded' THEN concat('/out/', CAST(t.task_id AS STRING), '.png') END AS output_path FROM tasks t JOIN requests q ON q.request_id = t.task_id)"""
LAST = "arg_max({0}, (ts, event_id))"
_ALL = [
    ("k5_scan_task_log", k5, "requests tasks", """ SELECT CAST(request_id AS STRING) AS task_id, file_name AS filename, CAST(CASE WHEN request_id % 5 = 0 THEN 5 ELSE t.priority END AS INT) AS priority, 3 AS max_retries, t.created_at AS enqueued_at, sha256(file_name || CAST(q.size_bytes AS STRING)) AS payload_sha256
      FROM requests q JOIN tasks t ON t.task_id = q.request_id"""),
    ("k6_scan_results_two_tier", k6, "tasks", """ SELECT idempotency_key, task_id, status, tier FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY tier DESC, task_id DESC) AS n
      FROM (SELECT *, CASE status WHEN 'running' THEN 1 ELSE 0 END AS tier FROM tasks WHERE status IN ('running', 'succeeded'))) WHERE n = 1"""),
    ("l1_dedupe_ttl", l1, "tasks", f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, task_id) AS n FROM tasks),
      fold AS (
        SELECT idempotency_key, n, task_id, task_id AS kept, finished_at + INTERVAL '{TTL_DAYS}' DAY AS until, CAST(NULL AS BIGINT) AS reuses FROM ranked WHERE n = 1
        UNION ALL
        SELECT r.idempotency_key, r.n, r.task_id, CASE WHEN f.until IS NULL OR r.created_at <= f.until THEN f.kept ELSE r.task_id END, CASE WHEN f.until IS NULL OR r.created_at <= f.until THEN f.until ELSE r.finished_at + INTERVAL '{TTL_DAYS}' DAY END,
          CASE WHEN f.until IS NULL OR r.created_at <= f.until THEN f.kept END FROM fold f JOIN ranked r ON r.idempotency_key = f.idempotency_key AND r.n = f.n + 1
      ) SELECT task_id, coalesce(reuses, task_id) AS result_of FROM fold"""),
    ("l2_dedupe_active", l2, "task_log tasks", " SELECT task_id, arg_min(event_id, (ts, event_id)) AS event_id FROM task_log WHERE state = 'queued' AND task_id NOT IN (SELECT task_id FROM tasks WHERE status = 'running') GROUP BY task_id"),
    ("l3_pending_tasks", l3, "tasks", " SELECT task_id, idempotency_key FROM tasks t WHERE status = 'queued' AND NOT EXISTS (SELECT 1 FROM tasks d WHERE d.idempotency_key = t.idempotency_key AND d.status = 'succeeded' AND d.finished_at < TIMESTAMP '1997-01-01')"),
    ("l4_restore_completed", l4, "tasks", f" SELECT task_id, idempotency_key FROM tasks WHERE finished_at <= TIMESTAMP '{AS_OF}' AND finished_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY"),
    ("l5_unacked_events", l5, "task_log", " SELECT event_id, task_id, CASE WHEN state IN ('queued', 'admitted', 'running') THEN state END AS state, CASE WHEN state IN ('succeeded', 'failed') THEN latency_ms END AS latency_ms, CASE WHEN state IN ('succeeded', 'failed') THEN 'result' ELSE 'progress' END AS kind FROM task_log WHERE attempt <> 0"),
    ("l6_terminal_results", l6, "tasks", " SELECT task_id, status, finished_at FROM tasks WHERE status IN ('succeeded', 'failed', 'cancelled', 'rejected') ORDER BY finished_at DESC NULLS LAST, task_id"),
    ("l7_find_by_source_name", l7, "requests tasks", RESULTS + """, wanted AS (SELECT DISTINCT lower(trim(n)) AS name FROM (SELECT concat(' IMG_', c_custkey, '.png ') AS n FROM customer UNION ALL SELECT concat(c_custkey, '.PNG') FROM customer)),
      hits AS (SELECT lower(trim(source_file_name)) AS name, task_id, finished_at FROM results UNION ALL SELECT lower(parse_filename(output_path)), task_id, finished_at FROM results)
      SELECT name, task_id FROM (SELECT name, task_id, row_number() OVER (PARTITION BY name ORDER BY finished_at DESC NULLS LAST, task_id DESC) AS n FROM hits JOIN wanted USING (name)) WHERE n = 1"""),
    ("l8_success_paths", l8, "requests tasks", RESULTS + " SELECT task_id, output_path FROM results WHERE status = 'succeeded'"),
    ("l9_latest_state", l9, "task_log", f" SELECT task_id, {LAST.format('state')} AS state, {LAST.format('attempt')} AS attempt, {LAST.format('latency_ms')} AS latency_ms, count(*) AS events FROM task_log GROUP BY task_id"),
    ("l10_state_timeline", l10, "task_log", """ SELECT *, trunc(date_sub('microsecond', queued_at, running_at) / 1000.0e0)::BIGINT AS queue_wait_ms, trunc(date_sub('microsecond', running_at, ended_at) / 1000.0e0)::BIGINT AS run_time_ms FROM (
      SELECT task_id, min(ts) FILTER (state = 'queued') AS queued_at, min(ts) FILTER (state = 'admitted') AS admitted_at, min(ts) FILTER (state = 'running') AS running_at, min(ts) FILTER (state IN ('succeeded', 'failed')) AS ended_at FROM task_log GROUP BY task_id)"""),
    ("l11_classify_failures", l11, "tasks", " SELECT task_id, CASE WHEN attempt < max_retries THEN 'retry_scheduled' ELSE 'failed' END AS outcome FROM tasks"),
    ("l12_retry_schedule", l12, "tasks", " SELECT task_id, d AS delay_ms, d AS least_ms, round(d * 1.2e0, 6) AS most_ms FROM (SELECT task_id, least(500.0e0 * pow(2.0e0, greatest(attempt + priority, 1) - 1), 15000.0e0) AS d FROM tasks)"),
    ("l13_deadline_misses", l13, "tasks", " SELECT task_id, node_id FROM tasks WHERE finished_at > deadline"),
    ("l14_outcome_counters", l14, "task_log", " SELECT node_id, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("queued", "admitted", "running", "succeeded", "failed")) + ", count(*) FILTER (state = 'failed' AND attempt > 0) AS retried FROM task_log GROUP BY node_id"),
    ("l15_log_events", l15, "task_log", " SELECT node_id, level, attempt AS step, count(*) AS messages FROM task_log WHERE level <> 'DEBUG' GROUP BY ALL"),
    ("l16_to_wire_result", l16, "tasks", " SELECT task_id, status = 'succeeded' AS success, concat(CAST(node_id AS STRING), '-worker') AS worker_id, epoch_ms(created_at) AS start_ts, coalesce(epoch_ms(finished_at), 0) AS finish_ts, coalesce(date_sub('millisecond', created_at, finished_at), 0) AS processing_ms FROM tasks"),
    ("l17_statistics_map", l17, "task_log heartbeats", """, m AS (SELECT node_id, state AS name, count(*) AS v FROM task_log WHERE state <> 'queued' GROUP BY ALL UNION ALL SELECT node_id, 'queued', max(queue_size) FROM heartbeats GROUP BY ALL)
      SELECT node_id, string_agg(concat(name, '=', CAST(v AS BIGINT)), ';' ORDER BY name) AS stats FROM m GROUP BY node_id"""),
    ("e1_latency_avg_200", e1, "task_log", " SELECT event_id, node_id, round(avg(latency_ms) OVER (PARTITION BY node_id ORDER BY ts, event_id ROWS 199 PRECEDING), 9) AS avg_latency_ms FROM task_log"),
    ("e2_latency_p95_200", e2, "task_log", """, listed AS (SELECT event_id, node_id, list_sort(list(latency_ms) OVER (PARTITION BY node_id ORDER BY ts, event_id ROWS 199 PRECEDING)) AS a FROM task_log)
      SELECT event_id, node_id, round(CASE WHEN len(a) < 20 THEN a[len(a)] ELSE (a[19 * (len(a) + 1) // 20] * (20 - 19 * (len(a) + 1) % 20) + a[19 * (len(a) + 1) // 20 + 1] * (19 * (len(a) + 1) % 20)) / 20.0e0 END, 6) AS p95_latency_ms FROM listed"""),
    ("e3_status_basic", e3, "heartbeats", " SELECT event_id, busy, CASE WHEN busy > 0 THEN 'BUSY' ELSE 'IDLE' END AS status FROM (SELECT event_id, least(greatest(workers_busy + busy_delta, 0), workers_total) AS busy FROM heartbeats)"),
    ("e4_status_full", e4, "heartbeats", " SELECT event_id, CASE WHEN NOT accepting THEN 'ERROR' WHEN stole THEN 'STEALING' WHEN workers_busy > 0 OR queue_size > 0 THEN 'BUSY' ELSE 'IDLE' END AS status FROM heartbeats"),
    ("e5_busy_running", e5, "heartbeats", " SELECT event_id, node_id, CAST(sum(busy_delta) OVER (PARTITION BY node_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS busy FROM heartbeats"),
    ("e6_node_snapshot", e6, "heartbeats", " SELECT node_id, " + ", ".join(f"{LAST.format(c)} AS {c}" for c in ("queue_size", "workers_busy", "workers_total", "cpu_percent", "accepting")) + f", count(*) AS beats, count(*) FILTER (stole) AS steals, date_sub('second', min(ts), max(ts)) AS uptime_s, 5 AS capacity, greatest(5 - {LAST.format('queue_size')}, 0) AS slots_free FROM heartbeats GROUP BY node_id"),
    ("e7_readiness", e7, "heartbeats", " SELECT event_id, CASE WHEN accepting AND queue_size < 5 AND queue_size * 104857600 > 268435456 THEN 'READY' ELSE 'NOT_READY' END AS readiness FROM heartbeats"),
    ("e8_registrations", e8, "heartbeats", " SELECT event_id, node_id, CASE WHEN lag(event_id) OVER (PARTITION BY node_id ORDER BY ts, event_id) IS NULL THEN 'REGISTERED' ELSE 'UPDATED' END AS result FROM heartbeats"),
    ("e9_heartbeat_gaps", e9_gaps, "heartbeats", f" SELECT node_id, dead_from, dead_until FROM ({GAPS})"),
    ("e9_requeue_rows", e9, "heartbeats", f""", gaps AS ({GAPS})
      SELECT g.node_id, x.event_id + 1 AS task_id, g.dead_from, g.dead_until FROM gaps g JOIN (SELECT *, ts + INTERVAL 7 MINUTE AS at, CASE WHEN event_id % 11 <> 0 THEN ts + to_minutes(7 + event_id % 300) END AS done FROM events) x
        ON (x.user_id + 3) % 8 = g.node_id AND (x.done IS NULL OR x.done > g.dead_from) AND (g.dead_until IS NULL OR x.at < g.dead_until) AND x.at <= TIMESTAMP '{E9_AS_OF}' AND g.dead_from <= TIMESTAMP '{E9_AS_OF}'"""),
    ("e10_queue_status", e10, "heartbeats", """, n AS (SELECT node_id, arg_max(queue_size, (ts, event_id)) AS q, arg_max(workers_busy, (ts, event_id)) AS w FROM heartbeats WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY node_id)
      SELECT CAST(coalesce(sum(q), 0) AS BIGINT) AS central_size, 100 AS central_capacity, coalesce(string_agg(concat(node_id, ':', q, ':6:', w), ',' ORDER BY node_id), '') AS nodes FROM n"""),
    ("e11_imbalance_pairs", e11, "heartbeats", """, load AS (SELECT user_id % 64 AS node_id, count(*) FILTER (event_type = 'signup') % 7 AS queue_size, count(*) FILTER (event_type = 'error') % 3 AS workers_busy FROM events GROUP BY 1)
      SELECT idle_node, busy_node, CASE WHEN bq > 3 THEN least(greatest(6 - own, 1), greatest(bq - 3, 0)) ELSE 0 END AS share FROM (
        SELECT i.node_id AS idle_node, i.queue_size AS own, b.node_id AS busy_node, b.queue_size AS bq, row_number() OVER (PARTITION BY i.node_id ORDER BY b.queue_size DESC, b.node_id) AS n
        FROM load i JOIN load b ON b.node_id <> i.node_id AND b.queue_size > 1 WHERE i.workers_busy = 0 AND i.queue_size <= 1) WHERE n = 1"""),
]
QUERIES = {name: run for name, run, _, _ in _ALL}
ORACLE_SQL = {name: sql(tables, body) for name, _, tables, body in _ALL}

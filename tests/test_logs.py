"""Dedupe, telemetry and streams against plain Python."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tesselon.operators import tasklog as t
from tesselon.operators import telemetry as e
from tesselon.plans import streams
from tesselon.sources import records, views
from tesselon.streaming import operators as s

DATA = "/root/testdata/sf0.001"
DAY = dt.timedelta(days=1)


def test_dedupe_follows_the_kept_task(spark):
    d0 = dt.datetime(2024, 1, 1)
    rows = [(1, "k", d0, d0 + DAY), (2, "k", d0 + 20 * DAY, d0 + 21 * DAY), (3, "k", d0 + 40 * DAY, None), (4, "k", d0 + 400 * DAY, None), (5, "j", d0, None)]
    df = spark.createDataFrame(rows, "task_id long, idempotency_key string, created_at timestamp_ntz, finished_at timestamp_ntz")
    assert {r["task_id"]: r["reuses"] for r in t.dedupe_ttl(df, 30).collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None}


def test_legacy_tier_wins(spark):
    a = spark.createDataFrame([("k", 1, 1), ("j", 2, 1)], "idempotency_key string, task_id int, line int")
    b = spark.createDataFrame([("k", 3, 1), ("k", 4, 2)], "idempotency_key string, task_id int, line int")
    assert {r["idempotency_key"]: (r["task_id"], r["tier"]) for r in t.two_tier(a, b).collect()} == {"k": (4, 1), "j": (2, 0)}


def test_records_round_trip_and_defaults(spark):
    lines = spark.createDataFrame([('{"task_id":"t","payload":"YWI=","enqueued_at":"2024-01-02T03:04:05.000006+00:00"}',), ("no json",)], "value string")
    r = records.parse_task_records(lines).collect()
    assert len(r) == 1 and bytes(r[0]["payload"]) == b"ab" and r[0]["priority"] == 5 and r[0]["enqueued_at"] == dt.datetime(2024, 1, 2, 3, 4, 5, 6)


def test_statistics_overlay(spark):
    m = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "node_id int, name string, value double")
    live = spark.createDataFrame([(1, "b", 9.0)], "node_id int, name string, value double")
    assert t.statistics_map(m, live).first()["stats"] == {"a": 1.0, "b": 9.0}


@pytest.mark.parametrize("n", [0, 1, 19, 20, 57, 200])
def test_exclusive_quantile(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    got = spark.createDataFrame([(sorted(values),)], "v array<double>").select(e.exclusive_p95(F.col("v")).alias("p")).first()["p"]
    want = 0.0 if not n else max(values) if n < 20 else statistics.quantiles(values, n=20)[18]
    assert abs(got - want) < 1e-9


def test_retry_delays(spark):
    delay, _, high = t.retry_schedule(F.col("n"))
    df = spark.createDataFrame([(1,), (3,), (9,)], "n int").select(delay.alias("d"), high.alias("h"))
    assert [tuple(r) for r in df.collect()] == [(500.0, 600.0), (2000.0, 2400.0), (15000.0, 18000.0)]


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """The event table in time order, cut into five files."""
    folder = tmp_path_factory.mktemp("replay")
    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts", "event_id")
    at = [r["ts"] for r in events.select("ts").collect()]
    cuts = [at[len(at) * k // 5] for k in range(5)] + [None]
    for k in range(5):
        part = events.where(F.col("ts") >= F.lit(cuts[k]))
        part = part if cuts[k + 1] is None else part.where(F.col("ts") < F.lit(cuts[k + 1]))
        part.coalesce(1).write.parquet(f"{folder}/{k}")
    return str(folder)


def stream(spark, replay, view):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(replay)
    kept, views.table = views.table, lambda *a: source
    try:
        return view(spark, DATA)
    finally:
        views.table = kept


def test_latest_node_over_batches_equals_batch(spark, replay):
    rows = s.drained(s.stream_latest_node(stream(spark, replay, views.heartbeats)), "update")
    assert rows.select("batch_id").distinct().count() == 5
    want = s.stream_latest_node(views.heartbeats(spark, DATA))
    assert sorted(map(tuple, s.latest(rows, ["node_id"]).collect())) == sorted(map(tuple, want.collect()))


def test_stream_dedupe_over_batches_equals_batch(spark, tmp_path):
    """A replay of tasks in six batches by event time decides what the batch form decides; state goes once all has expired."""
    rng = random.Random(8)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(k, rng.choice(["hot", "hot", "a", "b", None]), at(k), at(k + rng.choice([0, 1, 30, 100]))) for k in range(600)]
    df = spark.createDataFrame(rows, "task_id long, idempotency_key string, created_at timestamp_ntz, finished_at timestamp_ntz")
    events = s.task_events(df)
    assert events.count() == 1200
    cuts = [0, 100, 200, 300, 400, 500, 10**6]
    for k in range(6):
        hour = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp"), F.col("ts"))
        events.where((hour >= cuts[k]) & (hour < cuts[k + 1])).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    # An event of another key much later moves the watermark past all times to live.
    spark.createDataFrame([("z", 9999, at(10**5), False)], events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/6")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}")
    run = s.stream_dedupe(source, 2).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    got = spark.read.schema("task_id bigint, reuses bigint, batch_id bigint").parquet(out)
    assert got.select("batch_id").distinct().count() >= 7
    told = {r["task_id"]: r["reuses"] for r in got.collect()}
    assert told.pop(9999) is None
    want = {r["task_id"]: r["reuses"] for r in t.dedupe_ttl(df, 2).collect()}
    assert told == want
    assert 10 < sum(v is None for v in want.values()) < 590
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert held[-1] < max(held)


def test_stream_dedupe_holds_many_keys_in_few_rows_of_state(spark, tmp_path):
    """5,000 keys in two files of a folder: no more rows of state than buckets, and what the batch form decides."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(k, f"k{k % 5000}", at(k % 97), at(k % 97 + k % 60)) for k in range(12000)]
    df = spark.createDataFrame(rows, "task_id long, idempotency_key string, created_at timestamp_ntz, finished_at timestamp_ntz")
    df.repartition(2).write.parquet(f"{tmp_path}/tasks.parquet")
    out = f"{tmp_path}/out"
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}")
    source = s.task_events(s.stream_table(spark, str(tmp_path), "tasks"))
    run = s.stream_dedupe(source, 1).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 1024
    got = spark.read.schema("task_id bigint, reuses bigint, batch_id bigint").parquet(out).drop("batch_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, t.dedupe_ttl(df, 1).collect()))


def test_moving_average_over_batches_equals_batch(spark, replay):
    from tesselon.operators.costing import ema_service_ms

    rows = s.latest(s.drained(s.stream_ema(stream(spark, replay, views.task_log)), "update"), ["signature"])
    got = {r["signature"]: (round(r["ema_ms"], 6), r["n"]) for r in rows.collect()}
    assert got == {r["signature"]: (r["ema_ms"], r["n"]) for r in ema_service_ms(views.task_log(spark, DATA)).collect()}


def test_progress_over_batches_equals_batch(spark, replay):
    got = {tuple(r) for r in s.progress_upsert(stream(spark, replay, views.task_log)).collect()}
    assert got == {(r["task_id"], r["state"], r["attempt"]) for r in t.latest_state(views.task_log(spark, DATA)).collect()}


def test_stretches_give_what_whole_windows_give(spark, monkeypatch):
    """A hot key, ties, nulls among times, and stretches far shorter than the key's rows."""
    import random

    from pyspark.sql import Window as W

    from tesselon.operators import ordered

    monkeypatch.setattr(ordered, "STRETCH", 16)
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), None if i % 40 == 0 else 3600.0 * rng.randrange(30) + rng.randrange(9), rng.randrange(100)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id int, node_id int, s double, v int").withColumn("ts", F.timestamp_seconds("s")).withColumn("bucket", F.lit(1)).drop("s")
    order = ["ts", "event_id"]
    frame = W.partitionBy("node_id").orderBy(*order)
    got = ordered.running(df, "node_id", ordered.hours(df, "ts"), order, F.col("v"), "sum")
    assert got.exceptAll(df.withColumn("sum", F.sum("v").over(frame.rowsBetween(W.unboundedPreceding, 0)))).count() == 0 and got.count() == 900
    got = ordered.over_last(df, "node_id", ordered.hours(df, "ts"), order, 7, F.max("v"), "most")
    assert got.exceptAll(df.withColumn("most", F.max("v").over(frame.rowsBetween(-6, 0)))).count() == 0 and got.count() == 900


def test_slow_averages_keep_their_past(spark):
    from tesselon.operators.costing import ema_service_ms

    log = spark.range(3000).selectExpr("'s' as signature", "timestamp_seconds(id) as ts", "id as event_id", "cast(1 + id % 7 as double) as latency_ms")
    ema = 0.0
    for i in range(3000):
        v = 1.0 + i % 7
        ema = 0.999 * ema + 0.001 * v if ema > 0 else v
    assert abs(ema_service_ms(log, 0.001).first()["ema_ms"] - ema) < 1e-6


def test_open_tasks_and_silent_nodes(spark):
    """A node that is silent for good, one that misses exactly two beats, one that misses three; tasks from before, inside, after."""
    from tesselon.operators.telemetry import dead_spans, requeue_rows

    at = lambda m: f"2024-03-01 {m // 60:02d}:{m % 60:02d}:00"
    beats = [(1, m) for m in range(6)] + [(2, m) for m in (0, 1, 2, 5, 6, 90)] + [(3, m) for m in (*range(0, 91), 600)] + [(4, None)]
    df = spark.createDataFrame([(k, n, at(m) if m is not None else None) for k, (n, m) in enumerate(beats)], "event_id long, node_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    text = lambda c: F.date_format(F.col(c).cast("timestamp"), "HH:mm").alias(c)
    spans = dead_spans(df, 60, 3)
    got = {tuple(r) for r in spans.select("node_id", text("dead_from"), text("dead_until")).collect()}
    assert got == {(1, "00:05", None), (2, "00:06", "01:30"), (2, "01:30", None), (3, "01:30", "10:00")}
    tasks = [(1, 1, 0, 3), (2, 1, 0, None), (3, 1, 50, 60), (4, 1, 0, 5), (5, 2, 1, 7), (6, 2, 95, None), (7, 3, 89, 90), (8, 3, 500, 700), (9, 3, 601, None), (10, 5, 0, None), (11, None, 0, None)]
    log = spark.createDataFrame([(t, n, at(a), at(f) if f is not None else None) for t, n, a, f in tasks], "task_id int, node_id int, ts string, finished_at string")
    log = log.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))
    met = requeue_rows(log, spans, F.lit("2024-03-02").cast("timestamp_ntz")).select("task_id", text("dead_from")).collect()
    assert sorted(tuple(r) for r in met) == [(2, "00:05"), (3, "00:05"), (5, "00:06"), (6, "01:30"), (8, "01:30")]
    assert dead_spans(df.limit(0), 60, 3).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_linked_dedupe_equals_fold(spark, seed):
    """A key with half of all rows, ties, repeated rows, tasks in flight, no key, and ends before beginnings."""
    from tesselon.operators.tasklog import dedupe_folded, dedupe_linked, dedupe_ttl

    rng = random.Random(seed)
    rows = []
    for k in range(400):
        day, took = rng.randrange(60), rng.choice([0, 0, 1, 3, -2])
        rows.append((rng.choice(["hot", "a", "b", None]) if k % 2 else "hot", day * 24 + rng.randrange(0, 24, 6), k // (1 + seed), None if rng.random() < 0.01 * seed else took))
    df = spark.createDataFrame(rows, "idempotency_key string, hour int, task_id long, took int")
    hour = lambda c: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), c)
    df = df.withColumn("created_at", hour(F.col("hour"))).withColumn("finished_at", hour(F.col("hour") + F.col("took") * 24)).drop("hour", "took").distinct()
    for ttl in (0, 2, 5):
        told = lambda out: sorted((r["task_id"], -1 if r["reuses"] is None else r["reuses"]) for r in out.collect())
        want = told(dedupe_folded(df, ttl))
        assert told(dedupe_linked(df, ttl)) == want
        assert told(dedupe_ttl(df, ttl, folded=100)) == want
    assert dedupe_linked(df.limit(0), 2).count() == 0


def test_requests_without_sides_are_refused(spark):
    from tesselon.operators.requests import validate_requests

    rows = [(1, 10, None, 5), (2, 10, 5, None), (3, 10, 5, 5), (4, 10, 0, 5), (5, None, None, None)]
    df = spark.createDataFrame(rows, "request_id int, size_bytes long, width int, height int").withColumn("filters", F.array().cast("array<string>"))
    assert [r["reason"] for r in validate_requests(df).orderBy("request_id").collect()] == ["invalid image", "invalid image", None, "dimensions not positive", "empty payload"]


def test_ranks_of_one_score(spark):
    """A node with nearly all tasks, all of one score, is spread over ranges; nulls come last; tasks without a node are a group."""
    from tesselon.operators.ordered import ranked

    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), 0.5 if k % 9 else rng.choice([0.1, 0.9, None]), rng.choice([None, 3, 4]), k) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "node_id int, score double, place int, task_id long").repartition(6)
    order = [F.desc_nulls_last("score"), F.asc_nulls_last("place"), F.col("task_id")]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0, r[3]))
    place = {}
    for r in want:
        place[r[3]] = place.setdefault(("n", r[0]), 0) + 1
        place["n", r[0]] = place[r[3]]
    got = ranked(df, "node_id", order, "rank")
    assert got.columns == [*df.columns, "rank"]
    assert {r["task_id"]: r["rank"] for r in got.collect()} == {k: v for k, v in place.items() if not isinstance(k, tuple)}
    assert ranked(df.limit(0), "node_id", order, "rank").count() == 0


def test_image_files_are_in_one_folder(spark):
    """A folder for each image was listed by a task of its own."""
    names = {r["path"] for r in _scanned(spark)}
    assert len(names) == 250 and len({n.rsplit("/", 1)[0] for n in names}) == 1


def _scanned(spark):
    found, scan = [], streams.files.scan_images
    with pytest.MonkeyPatch.context() as m:
        m.setattr(streams.files, "scan_images", lambda sp, path: found.append(path) or scan(sp, path))
        streams.k1(spark, DATA)
    return scan(spark, found[0]).select("path").collect()

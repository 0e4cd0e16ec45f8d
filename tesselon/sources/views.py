"""Tables that the registered queries derive from the stored ones: images, requests, tasks, logs, heartbeats, uploads."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: How stored tables are read by this thread, if not as they stand: a stream of their files, for one.
READER: ContextVar = ContextVar("reader", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = READER.get()
    return reader(spark, sf_dir, name) if reader else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 images, one per embedding; gain and offset vary with the id, every third image is gray."""
    e = table(spark, sf_dir, "embeddings")
    gain, offset = F.lit(40) + F.lit(30) * (F.col("vec_id") % 8), F.lit(20) * (F.col("vec_id") % 6)
    level = lambda v: F.least(F.greatest(F.floor((v.cast("double") + F.lit(0.55)) * gain + offset), F.lit(0)), F.lit(255)).cast("int")
    rows = e.select(F.col("vec_id").alias("image_id"), F.transform("embedding", level).alias("a"))
    each = rows.select("image_id", "a", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    at = lambda shift: F.get("a", ((F.col("p") + F.lit(shift) * (F.col("image_id") % 3)) % 64).cast("int"))
    return each.select("image_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.get("a", "p").alias("r"), at(21).alias("g"), at(42).alias("b"))


def px_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images side by side, 16x8."""
    p = px(spark, sf_dir)
    return p.select(F.floor(F.col("image_id") / 2).alias("image_id"), "y", (F.col("x") + 8 * (F.col("image_id") % 2)).cast("int").alias("x"), "r", "g", "b")


# Filter entries and suffixes of the derived requests.
FILTERS = (
    "grayscale", " Gray ;resize:64x48", "resize:640", "crop:1,2,30,40", "crop:1,2,3", "rotate:90;flip:both", "rotate:12,TRUE;format:JPG", "blur;sharpen:1.3",
    "brightness-contrast:1.2,0.8;contrast:1.4", "watermark:Demo|12|12|white;;convert:webp", "swirl:3", "ocr;inference",
)
SUFFIXES = (".PNG", ".jpg", ".webp", "", ".tif")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows with good, aliased, blank and bad filters, and sizes that cross every limit."""
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % k).cast("int"))
    batch = F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_orderkey") / 60)).otherwise(1000000 + F.floor(F.col("o_orderkey") / 15))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        batch.alias("batch_id"),
        F.concat(F.lit("img_"), F.col("o_custkey").cast("string"), pick(SUFFIXES, 5)).alias("file_name"),
        F.split(pick(FILTERS, 12), ";").alias("filters"),
        F.floor(F.col("o_totalprice") * 100).alias("size_bytes"),
        ((F.col("o_orderkey") * 37) % 13000).cast("int").alias("width"),
        ((F.col("o_custkey") * 91) % 12500).cast("int").alias("height"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlog rows."""
    key = F.col("o_orderkey")
    days = lambda n: F.col("o_orderdate") + F.make_dt_interval(n.cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    return table(spark, sf_dir, "orders").select(
        key.alias("task_id"),
        (key % 8).alias("node_id"),
        F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("idempotency_key"),
        (11 - 2 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 4 != 0, days(key % 50)).alias("deadline"),
        (key % 4).cast("int").alias("attempt"),
        (key % 3).cast("int").alias("max_retries"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", days(F.col("o_custkey") % 40)).alias("finished_at"),
        F.floor(F.col("o_totalprice") * 100).alias("size_bytes"),
        (100 + (key * 37) % 5000).cast("int").alias("width"),
        (80 + (F.col("o_custkey") * 91) % 4000).cast("int").alias("height"),
    )


def _number():
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State history of tasks, append-only."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "queued").when(kind == "click", "admitted").when(kind == "signup", "running").when(kind == "purchase", "succeeded").otherwise("failed")
    level = F.when(kind == "view", "DEBUG").when(kind == "error", "ERROR").when(kind == "signup", "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("task_id"), (F.col("user_id") % 8).alias("node_id"), state.alias("state"), level.alias("level"),
        F.col("value").alias("latency_ms"), (_number() % 4).alias("attempt"), F.concat(F.lit("sig"), (_number() % 10).cast("string")).alias("signature"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node telemetry."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("user_id") % 8).alias("node_id"), (_number() % 7).alias("queue_size"), F.lit(6).alias("queue_capacity"),
        (_number() % 5).alias("workers_busy"), F.lit(4).alias("workers_total"), F.least("value", F.lit(100.0)).alias("cpu_percent"),
        (kind != "error").alias("accepting"), (kind == "signup").alias("stole"), F.when(kind == "view", -1).when(kind == "click", 1).otherwise(0).alias("busy_delta"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of uploads."""
    name = F.when(F.col("turn") % 2 == 0, F.concat("role", F.col("turn").cast("string"), F.lit(".png"))).otherwise("")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), name.alias("file_name"))


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a model as JSON texts."""
    said = F.concat(
        F.lit('{"label":"'), "lang", F.lit('","labels":["'), "lang", F.lit('","'), "source", F.lit('"],"score":'), (F.col("doc_id") % 100).cast("string"), F.lit(',"metadata":{"engine":"m1"}}')
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), said.alias("classification_result"))


# The same tables as DuckDB common table expressions.
SQL = {
    "px": """px AS (
SELECT image_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x,
       a[p + 1] AS r, a[(p + 21 * (image_id % 3)) % 64 + 1] AS g, a[(p + 42 * (image_id % 3)) % 64 + 1] AS b
FROM (SELECT vec_id AS image_id, list_transform(embedding, lambda e: CAST(least(greatest(
        floor((CAST(e AS DOUBLE) + CAST(0.55 AS DOUBLE)) * (40 + 30 * (vec_id % 8)) + 20 * (vec_id % 6)), 0), 255) AS INT)) AS a FROM embeddings) s
CROSS JOIN (SELECT unnest(range(64)) AS p) t)""",
    "px_wide": """px_wide AS (
SELECT CAST(floor(image_id / 2.0) AS BIGINT) AS image_id, y, CAST(x + 8 * (image_id % 2) AS INT) AS x, r, g, b FROM px)""",
    "requests": """requests AS (
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_orderkey / 60.0) AS BIGINT)
            ELSE 1000000 + CAST(floor(o_orderkey / 15.0) AS BIGINT) END AS batch_id,
       concat('img_', CAST(o_custkey AS STRING), CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg'
              WHEN 2 THEN '.webp' WHEN 3 THEN '' ELSE '.tif' END) AS file_name,
       string_split(CASE CAST(o_orderkey % 12 AS INT)
         WHEN 0 THEN 'grayscale' WHEN 1 THEN ' Gray ;resize:64x48' WHEN 2 THEN 'resize:640' WHEN 3 THEN 'crop:1,2,30,40'
         WHEN 4 THEN 'crop:1,2,3' WHEN 5 THEN 'rotate:90;flip:both' WHEN 6 THEN 'rotate:12,TRUE;format:JPG'
         WHEN 7 THEN 'blur;sharpen:1.3' WHEN 8 THEN 'brightness-contrast:1.2,0.8;contrast:1.4'
         WHEN 9 THEN 'watermark:Demo|12|12|white;;convert:webp' WHEN 10 THEN 'swirl:3' ELSE 'ocr;inference' END, ';') AS filters,
       CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes,
       CAST((o_orderkey * 37) % 13000 AS INT) AS width, CAST((o_custkey * 91) % 12500 AS INT) AS height
FROM orders)""",
    "tasks": """tasks AS (
SELECT o_orderkey AS task_id, o_orderkey % 8 AS node_id, concat('k', CAST(o_custkey AS STRING)) AS idempotency_key,
       11 - 2 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 50 AS INT) END AS deadline,
       CAST(o_orderkey % 4 AS INT) AS attempt, CAST(o_orderkey % 3 AS INT) AS max_retries,
       CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY * CAST(o_custkey % 40 AS INT) END AS finished_at,
       CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes,
       CAST(100 + (o_orderkey * 37) % 5000 AS INT) AS width, CAST(80 + (o_custkey * 91) % 4000 AS INT) AS height
FROM orders)""",
    "task_log": """task_log AS (
SELECT event_id, ts, user_id AS task_id, user_id % 8 AS node_id,
       CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'admitted' WHEN 'signup' THEN 'running'
            WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS state,
       CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
       value AS latency_ms, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 4 AS attempt,
       concat('sig', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 AS STRING)) AS signature
FROM events)""",
    "heartbeats": """heartbeats AS (
SELECT event_id, ts, user_id % 8 AS node_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 7 AS queue_size, 6 AS queue_capacity,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 5 AS workers_busy, 4 AS workers_total, least(value, CAST(100 AS DOUBLE)) AS cpu_percent,
       event_type <> 'error' AS accepting, event_type = 'signup' AS stole,
       CASE event_type WHEN 'view' THEN -1 WHEN 'click' THEN 1 ELSE 0 END AS busy_delta
FROM events)""",
    "uploads": """uploads AS (
SELECT conv_id AS upload_id, turn AS seq, text AS chunk, CASE WHEN turn % 2 = 0 THEN concat(role, CAST(turn AS STRING), '.png') ELSE '' END AS file_name
FROM conversations)""",
    "model_output": """model_output AS (
SELECT doc_id AS task_id, concat('{"label":"', lang, '","labels":["', lang, '","', source, '"],"score":', CAST(doc_id % 100 AS STRING),
       ',"metadata":{"engine":"m1"}}') AS classification_result FROM documents)""",
}


def sql(names: str, body: str) -> str:
    """``body`` over the derived tables in ``names``; ``body`` may begin with further common table expressions and a comma."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names.split()) + body

"""Task, result and progress records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "task_id string, filename string, payload string, priority int, max_retries int, enqueued_at string"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def task_records(requests: DataFrame) -> DataFrame:
    """``(value)``: one JSON text per request; bytes in base64, times as ISO in UTC. Default values are left out."""
    return requests.select(
        F.to_json(
            F.struct(
                F.col("request_id").cast("string").alias("task_id"), F.col("file_name").alias("filename"),
                F.base64(F.concat("file_name", F.col("size_bytes").cast("string")).cast("binary")).alias("payload"),
                F.when(F.col("request_id") % 5 != 0, F.col("priority")).alias("priority"), F.date_format(F.col("created_at").cast("timestamp"), ISO).alias("enqueued_at"),
            )
        ).alias("value")
    )


def parse_task_records(lines: DataFrame) -> DataFrame:
    """Records of ``lines(value)`` under a fixed schema; what is missing takes its default, lines that are no JSON are dropped."""
    r = lines.select(F.from_json("value", TASK).alias("r")).select("r.*").where("task_id is not null")
    return r.select(
        "task_id", "filename", F.unbase64("payload").alias("payload"), F.coalesce("priority", F.lit(5)).alias("priority"), F.coalesce("max_retries", F.lit(3)).alias("max_retries"),
        F.to_timestamp_ntz("enqueued_at", F.lit(ISO)).alias("enqueued_at"),
    )


def read_task_log(spark: SparkSession, path: str) -> DataFrame:
    """Task records of a folder of JSON lines."""
    return parse_task_records(spark.read.text(path))

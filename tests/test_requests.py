"""Filter specs, limits, costs and order: exact values and orderings."""

import hashlib

from pyspark.sql import functions as F

from tesselon.operators import costing as c
from tesselon.operators import requests as r


def steps(spark, *filters):
    df = spark.createDataFrame([(1, list(filters))], "request_id int, filters array<string>")
    return r.reject_bad_filters(r.filter_args(r.normalize_filters(df))).first()


def test_specs(spark):
    got = steps(spark, "grayscale", "resize:200x140", "watermark:Demo|12||red", "  ", "ROTATE: 15 , False", "format:WEBP")
    assert got["reason"] is None and got["output_format"] == "webp"
    assert [s["op"] for s in got["steps"]] == ["grayscale", "resize", "watermark_text", "rotate", "format_conversion"]
    assert got["steps"][1]["params"] == {"width": "200", "height": "140"}
    assert got["steps"][2]["params"]["y"] == "16" and got["steps"][2]["params"]["fill"] == "red"
    assert got["steps"][3]["params"] == {"angle": "15", "expand": "false"}


def test_first_problem_is_told(spark):
    assert steps(spark, "blur", "crop:1,2", "swirl")["reason"] == "wrong arguments: crop"
    assert steps(spark, "resize:x20")["reason"] == "wrong arguments: resize"
    assert steps(spark, "swirl:3")["reason"] == "unsupported filter: swirl"


def test_first_limit_wins(spark):
    rows = [(1, 0, 0, 0), (2, 26 * 2**20, 13000, 1), (3, 5, 0, 4), (4, 5, 13000, 13000), (5, 5, 9, 12001), (6, 5, 8000, 8000), (7, 5, 10, 10)]
    df = spark.createDataFrame(rows, "request_id int, size_bytes long, width int, height int").withColumn("filters", F.array(F.lit("blur")))
    got = {x["request_id"]: x["reason"] for x in r.validate_requests(df).collect()}
    assert got == {1: "empty payload", 2: "payload too large", 3: "dimensions not positive", 4: "width over limit", 5: "height over limit", 6: "pixels over limit", 7: None}
    many = df.where("request_id = 7").withColumn("filters", F.array(*[F.lit("blur")] * 13))
    assert r.validate_requests(many).first()["reason"] == "too many filters"


def test_fingerprint_is_the_digest_of_its_parts(spark):
    df = spark.createDataFrame([("a.png", ["x", "y:1"], bytearray(b"data"))], "n string, f array<string>, d binary")
    want = hashlib.sha256(b"a.png\0x\0y:1\0" + hashlib.sha256(b"data").digest()).hexdigest()
    assert df.select(r.fingerprint(F.col("n"), F.col("f"), F.col("d")).alias("k")).first()["k"] == want


def test_uploads(spark):
    rows = [(1, 2, "b", ""), (1, 1, "a", "x.png"), (2, 1, "", ""), (3, 1, "abcdef", "y"), (1, 3, None, None)]
    df = spark.createDataFrame(rows, "upload_id int, seq int, chunk string, file_name string")
    got = {x["upload_id"]: x for x in r.assemble_uploads(df, 5).collect()}
    assert got[1]["payload"] == "ab" and got[1]["file_name"] == "x.png" and got[1]["reason"] is None
    assert got[2]["reason"] == "empty upload" and got[2]["file_name"] == "upload-2.png"
    assert got[3]["reason"] == "payload too large" and got[3]["payload"] is None


def test_metadata_later_wins(spark):
    df = spark.range(1).select(r.clean_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("node_id"), F.lit("n")), F.create_map(F.lit("a"), F.lit("2"))).alias("m"))
    assert df.first()["m"] == {"a": "2"}


def weight(spark, op, fmt="png", **params):
    df = spark.createDataFrame([(op, params, 1200, 900, fmt)], "op string, params map<string,string>, width int, height int, output_format string")
    return c.transform_weight(df).first()["weight"]


def test_weights(spark):
    assert weight(spark, "rotate", angle="180", expand="true") < weight(spark, "rotate", angle="15", expand="true")
    assert weight(spark, "rotate", angle="0") == 0.05
    assert weight(spark, "resize", width="300", height="200") < weight(spark, "resize", width="2400", height="1800")
    assert weight(spark, "flip", direction="horizontal") < weight(spark, "ocr")
    assert abs(weight(spark, "format_conversion", "webp") - 0.375) < 1e-12
    assert weight(spark, "other") == 1.0


def test_hints(spark):
    df = spark.createDataFrame([("watermark", "ico"), ("inference", "bmp"), ("none", "none")], "n string, f string")
    name, fmt = c.queue_cost_hints(F.col("n"), F.col("f"))
    assert [tuple(x) for x in df.select(name, fmt).collect()] == [(1.1, 0.36), (3.8, 0.255), (None, None)]


def test_order_of_the_backlog(spark):
    rows = [(1, 2, None), (2, 9, None), (3, 5, 2), (4, 5, 30)]
    df = spark.createDataFrame(rows, "task_id long, priority int, left int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    df = df.withColumn("deadline", F.when(F.col("left").isNotNull(), F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("left").cast("decimal(18,6)"))))
    for name, v in (("service_ms", 100.0), ("attempt", 0), ("max_retries", 1), ("size_bytes", 0), ("node_id", 0)):
        df = df.withColumn(name, F.lit(v))
    ranked = c.rank_backlog(c.score_tasks(df, F.col("created_at"), 30.0, 60.0))
    order = [x["task_id"] for x in ranked.orderBy("rank").collect()]
    assert order.index(2) < order.index(1) and order.index(3) < order.index(4)

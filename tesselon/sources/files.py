"""Files as tables: images, raw bytes, header probes, rasters, partitioned results and their read-back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions.pixels import PX


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, under the cluster's ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tesselon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tesselon/{tag}-{uuid.uuid4().hex}"


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, height, width, channels, data, valid)`` of image files; unreadable ones are flagged, not dropped."""
    read = spark.read.format("image").option("dropInvalid", False).load(path)
    return read.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data").withColumnRenamed("origin", "path").withColumn("valid", F.col("height") > 0)


def scan_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, name, suffix, length, content)`` of files under a path or URI."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.substring_index("path", "/", -1)
    return reader.load(path).select("path", name.alias("name"), F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1)).alias("suffix"), "length", "content")


def _number(data: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, n)), 16, 10).cast("bigint")


def probe_header(data: Column) -> Column:
    """``struct(format, width, height)`` by magic bytes, without decoding; sizes for PNG, GIF and BMP, otherwise null."""
    head = F.hex(F.substring(data, 1, 12))
    is_png, is_gif, is_bmp = head.startswith("89504E470D0A1A0A"), head.startswith("474946383"), head.startswith("424D")
    kind = (
        F.when(is_png, "png").when(is_gif, "gif").when(head.startswith("FFD8FF"), "jpeg").when(is_bmp, "bmp")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head.startswith("00000100"), "ico")
    )
    little = lambda at: _number(data, at, 1) + _number(data, at + 1, 1) * 256
    width = F.when(is_png, _number(data, 17, 4)).when(is_gif, little(7)).when(is_bmp, little(19))
    height = F.when(is_png, _number(data, 21, 4)).when(is_gif, little(9)).when(is_bmp, little(23))
    return F.struct(kind.alias("format"), width.alias("width"), height.alias("height"))


def to_pixels(rasters: DataFrame) -> DataFrame:
    """``rasters(image_id, width, height, data)`` with three bytes per pixel, blue first, as a pixel table."""
    each = rasters.select("image_id", "width", F.hex("data").alias("h"), F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p"))
    byte = lambda k: F.conv(F.substring("h", F.col("p") * 6 + 1 + 2 * k, F.lit(2)), 16, 10).cast("int")
    return each.select("image_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).alias("x"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def from_pixels(px: DataFrame) -> DataFrame:
    """``(image_id, width, height, data)``: a raster is one row, so an image has to fit one task here."""
    byte = lambda c: F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0")
    cell = F.struct("y", "x", F.concat(byte("b"), byte("g"), byte("r")).alias("h"))
    rows = px.select(*PX).groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("cells", lambda c: c["h"]), "")).alias("data"))


def write_results(results: DataFrame, path: str) -> None:
    """Results by output format, the latest per task: a second write of a task replaces the first when read by ``read_results``."""
    newest = results.groupBy("task_id", "output_format").agg(F.max_by(F.struct(*[c for c in results.columns if c not in ("task_id", "output_format")]), "finished_at").alias("r"))
    newest.select("task_id", "output_format", "r.*").write.mode("append").partitionBy("output_format").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each task over all writes."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "task_id"]
    return rows.groupBy("task_id").agg(F.max_by(F.struct(*columns), "finished_at").alias("r")).select("task_id", "r.*")


def read_outputs(results: DataFrame, path: str, glob: str | None = None) -> DataFrame:
    """``(task_id, output_path, content)`` of succeeded results whose file is there; missing files are skipped."""
    files = scan_binary(results.sparkSession, path, glob).select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("output_path"), "content")
    done = results.where("status = 'succeeded'").select("task_id", F.regexp_replace("output_path", "^[a-z]+:/+", "/").alias("output_path"))
    return done.join(files, "output_path").select("task_id", "output_path", "content")

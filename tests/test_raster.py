"""Algebraic properties of the raster operators and the shapes that their users rely on."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tesselon.functions.pixels import PX, image_sizes
from tesselon.operators import raster_point as point
from tesselon.operators import raster_resample as resample
from tesselon.operators import raster_window as window
from tesselon.plans.pipeline import apply_pipeline, apply_step
from tesselon.sources import files, views


@pytest.fixture(scope="module")
def px(spark):
    return views.px_wide(spark, "/root/testdata/sf0.001").where("image_id < 6").cache()


def rows(df):
    return sorted(tuple(r) for r in df.select(*PX).collect())


def flat(spark, w, h, colour=(200, 80, 10)):
    return spark.range(w * h).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"), *[F.lit(v).alias(c) for v, c in zip(colour, "rgb")])


def test_flips_and_turns_come_back(px):
    assert rows(point.flip(point.flip(px, "both"), "both")) == rows(px)
    turned = px
    for _ in range(4):
        turned = point.rotate_quadrant(turned, 90)
    assert rows(turned) == rows(px)
    assert rows(point.rotate_quadrant(point.rotate_quadrant(px, 90), 270)) == rows(px)


def test_quarter_turn_swaps_sides(px):
    a, b = (r for r in (image_sizes(px).first(), image_sizes(point.rotate_quadrant(px, 90)).first()))
    assert (a["w"], a["h"]) == (16, 8) and (b["w"], b["h"]) == (8, 16)


def test_right_angles_of_the_general_rotation_match(px):
    assert rows(resample.rotate(px, 180.0)) == rows(point.rotate_quadrant(px, 180))


def test_blend_ends(px):
    gray = point.grayscale(px)
    assert rows(point.blend(px, gray, 0.0)) == rows(px)
    assert rows(point.blend(px, gray, 1.0)) == rows(gray)


def test_posterize_is_idempotent(px):
    once = point.posterize(px, 3)
    assert rows(point.posterize(once, 3)) == rows(once)
    assert rows(point.posterize(px, 8)) == rows(px)


def test_weights_sum_to_one(spark):
    w = resample.axis_weights(spark.createDataFrame([(16, 5), (8, 12), (7, 7), (1, 4)], "n_in int, n_out int"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in w.groupBy("n_in", "n_out", "o").agg(F.sum("weight").alias("s")).collect())


def test_flat_images_stay_flat(spark):
    image = flat(spark, 12, 9)
    for out in (window.gaussian_blur(image, 2.0), window.sharpen(image, 2.0), resample.resize(image, 5, 7), resample.pixelate(image, 4)):
        assert {tuple(r)[3:] for r in out.collect()} == {(200, 80, 10)}
    assert {r["r"] for r in window.edges(image).where("x between 1 and 10 and y between 1 and 7").collect()} == {0}


def test_no_ops_keep_the_image(px):
    assert rows(resample.resize(px, 16, 8)) == rows(px)
    assert rows(resample.pixelate(px, 1)) == rows(px)
    assert rows(window.brightness_contrast(px, 1.0, 1.0)) == rows(px)
    assert rows(apply_step(px, ("rotate", {"angle": "360"}))) == rows(px)


def test_crop_beyond_the_image_is_black(px):
    out = point.crop(px, -1, -1, 3, 2)
    assert out.count() == px.select("image_id").distinct().count() * 12
    assert {(r["r"], r["g"], r["b"]) for r in out.where("x = 0 or y = 0").collect()} == {(0, 0, 0)}


def test_thumbnail_keeps_proportions(px):
    assert {(r["w"], r["h"]) for r in image_sizes(resample.thumbnail(px, 8, 8)).collect()} == {(8, 4)}


def test_watermark_reaches_all_quarters(spark):
    image = flat(spark, 60, 40, (245, 245, 245))
    mask = spark.createDataFrame([(y, x, 1) for y in range(4) for x in range(6)], "my int, mx int, kind int")
    out = resample.watermark_overlay(image, mask, 6, 4, 96, 45.0, "black", 6)
    changed = out.where("r < 245").select((F.col("x") >= 30).alias("right"), (F.col("y") >= 20).alias("low")).distinct()
    assert changed.count() == 4


def test_watermark_edges_are_covered_in_part(spark):
    """A bar turned by 30 degrees on black: full in its middle, between at its edges, nothing outside; half a turn and none are sharp."""
    image = flat(spark, 40, 40, (0, 0, 0))
    mask = spark.createDataFrame([(y, x, 1) for y in range(20) for x in range(10)], "my int, mx int, kind int")
    tones = lambda angle: {r["r"] for r in resample.watermark_overlay(image, mask, 10, 20, 255, angle, "white", 10).select("r").distinct().collect()}
    assert tones(0.0) == {0, 255} and tones(180.0) == {0, 255}
    seen = tones(30.0)
    assert {0, 255} < seen and len(seen) > 20
    pale = resample.watermark_overlay(image, mask, 10, 20, 51, 30.0, "white", 10).agg(F.max("r")).first()[0]
    assert pale == 51


def test_unknown_transform_is_refused(px):
    with pytest.raises(ValueError):
        apply_pipeline(px, [("swirl", {})])


def png(w, h, pixel):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(w)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, lambda x, y: (x * 10, y * 20, 5)))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    scanned = {r["path"].rsplit("/", 1)[-1]: r for r in files.scan_images(spark, str(tmp_path)).collect()}
    assert scanned["a.png"]["valid"] and not scanned["bad.png"]["valid"]
    good = files.scan_images(spark, str(tmp_path)).where("valid").select(F.lit(1).alias("image_id"), "width", "height", "data")
    assert {(r["x"], r["y"], r["r"], r["g"], r["b"]) for r in files.to_pixels(good).collect()} == {(x, y, x * 10, y * 20, 5) for x in range(3) for y in range(2)}
    probed = {r["name"]: r["p"] for r in files.scan_binary(spark, str(tmp_path)).select("name", files.probe_header(F.col("content")).alias("p")).collect()}
    assert (probed["a.png"]["format"], probed["a.png"]["width"], probed["a.png"]["height"]) == ("png", 3, 2)
    assert probed["bad.png"]["format"] is None


def test_outputs_that_are_missing_are_skipped(spark, tmp_path):
    (tmp_path / "1.png").write_bytes(b"one")
    results = spark.createDataFrame([(1, "succeeded", f"file://{tmp_path}/1.png"), (2, "succeeded", f"{tmp_path}/2.png"), (3, "failed", f"{tmp_path}/1.png")], "task_id int, status string, output_path string")
    assert [(r["task_id"], bytes(r["content"])) for r in files.read_outputs(results, str(tmp_path)).collect()] == [(1, b"one")]


def test_steps_that_leave_the_pixels(px):
    same = apply_pipeline(px, [("ocr", {}), ("inference", {}), ("format_conversion", {"format": "png"})])
    assert same.exceptAll(px.select(*same.columns)).count() == 0 and same.count() == px.count()


def test_fill_colours():
    from tesselon.plans.pipeline import colour

    assert [colour(v) for v in (None, "", "red", "#0a0B0c", "1, 2,300", (4, 5, 6))] == [(0, 0, 0), (0, 0, 0), (255, 0, 0), (10, 11, 12), (1, 2, 255), (4, 5, 6)]
    with pytest.raises(ValueError):
        colour("no colour")


def test_later_metadata_wins_and_readers_get_binary_pixels(px):
    from tesselon.plans.pipeline import pipeline_metadata

    def reader(binary):
        return binary.groupBy("image_id").agg(F.concat(F.lit(" "), F.count_distinct("r").cast("string")).alias("text"))

    told = pipeline_metadata(px, [("inference", {}), ("brightness", {"brightness": "0.1"}), ("inference", {}), ("ocr", {})], read_text=reader).collect()
    last = {r["image_id"]: r["metadata"] for r in pipeline_metadata(apply_pipeline(px, [("brightness", {"brightness": "0.1"})]), [("inference", {})]).collect()}
    assert told and all(r["metadata"]["classification_result"] == last[r["image_id"]]["classification_result"] for r in told)
    assert all(r["metadata"]["extracted_text"] in ('{"text":"1"}', '{"text":"2"}') for r in told)
    assert all(r["metadata"] == {} for r in pipeline_metadata(px, [("sepia", {})]).collect())


def test_rows_per_pixel_and_image_are_not_broadcast(spark):
    """The planner takes exploded pixels for as few as the stored rows; only weights, as many as there are distinct sides, and masks may be broadcast."""
    px = views.px_wide(spark, "/root/testdata/sf0.001")
    mask = spark.createDataFrame([(0, 0, 1)], "my int, mx int, kind int")
    steps = [("rotate", {"angle": "30"}), ("resize", {"width": "5", "height": "12"}), ("pixelate", {"block_size": "3"}), ("contrast", {"contrast": "1.4"}), ("watermark_text", {})]
    outs = [apply_pipeline(px, [step], lambda text, size: (mask, 3, 3)) for step in steps] + [point.blend(px, point.grayscale(px), 0.5), point.flip(px), window.image_stats(px)]
    for out in outs:
        joins = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in line]
        assert all("n_in#" in line or "my#" in line for line in joins), joins


def test_images_of_one_size_are_resized_in_many_parts(spark):
    px = views.px_wide(spark, "/root/testdata/sf0.001")
    joins = [line for line in resample.resize(px, 5, 12)._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in line and ("kx#" in line or "ky#" in line)]
    assert len(joins) == 2 and all("part#" in line for line in joins)

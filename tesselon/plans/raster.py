"""Registered raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import raster_point as point
from tesselon.operators import raster_resample as resample
from tesselon.operators import raster_window as window
from tesselon.plans import raster_sql as d
from tesselon.plans.pipeline import apply_pipeline, apply_pipelines, pipeline_metadata
from tesselon.plans.steps import apply_specs
from tesselon.sources import views
from tesselon.sources.views import sql

# A small glyph for the watermark query; 1 marks the stroke, 2 its outline.
MASK = ((0, 0, 2), (0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 1, 2), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1))
PIPELINE = [("grayscale", {"intensity": "0.6"}), ("resize", {"width": "12", "height": "6"}), ("flip", {"direction": "both"}), ("sharpen", {"factor": "1.5"})]
PIPELINES = {
    "a": [("sepia", {}), ("crop", {"left": "1", "upper": "1", "right": "7", "lower": "6"})],
    "b": [("rotate", {"angle": "90"}), ("brightness", {"brightness": "1.2", "contrast": "0.8"})],
    "c": [("pixelate", {"block_size": "3"}), ("edges", {})],
}
SAYING = [
    ("inference", {}), ("format_conversion", {"format": "webp"}), ("rotate", {"angle": "30", "fill_color": "#090807"}), ("ocr", {"threshold": "120"}),
    ("watermark_text", {"text": "x", "opacity": "80", "angle": "45"}), ("inference", {}), ("brightness", {"brightness": "1.2"}),
]

def _pair(name: str, run, step: str, source: str = "px", columns: str = "image_id, y, x, r, g, b"):
    base = views.px_wide if source == "px_wide" else views.px
    tables = "px px_wide" if source == "px_wide" else "px"
    return name, (lambda spark, sf: run(base(spark, sf))), sql(tables, f", {step} SELECT {columns} FROM o")


def _glyphs(spark):
    return lambda text, size: (spark.createDataFrame(MASK, "my int, mx int, kind int"), 3, 3)


def _said(px):
    told = pipeline_metadata(px, SAYING, _glyphs(px.sparkSession))
    label = F.from_json(F.col("metadata")["classification_result"], "label string, labels array<string>, score double")
    return told.select("image_id", F.col("metadata")["ocr_error"].isNotNull().alias("no_reader"), label.alias("c")).select("image_id", "no_reader", "c.label", F.array_join("c.labels", ",").alias("labels"))


def _alpha(px):
    return px.withColumn("a", ((F.col("x") * 31 + F.col("y") * 17 + F.col("image_id")) % 256).cast("int"))


def _spec(px):
    kind = F.col("image_id") % 3
    return px.select("image_id", F.when(kind == 0, "a").when(kind == 1, "b").otherwise("c").alias("signature")).distinct()


def _own_steps(px):
    """A list of steps for each image but every seventh, hardly two of them alike."""
    i, text = F.col("image_id"), lambda v: F.round(v, 2).cast("string")
    step = lambda name, *params: F.struct(F.lit(name).alias("name"), F.create_map(*params).alias("params"))
    steps = F.array(
        step("brightness", F.lit("brightness"), text(0.5 + i % 37 / 20.0)), step("flip", F.lit("direction"), F.lit("horizontal")),
        step("sharpen", F.lit("factor"), text(1.0 + i % 29 / 10.0)), step("color_tint", F.lit("r"), (i % 256).cast("string"), F.lit("intensity"), F.lit("0.25")),
    )
    return px.select("image_id").distinct().where(i % 7 != 0).select("image_id", steps.alias("steps"))


def _own_steps_sql() -> str:
    bright, sharp = "round(0.5e0 + image_id % 37 / 20.0e0, 2)", "round(1.0e0 + image_id % 29 / 10.0e0, 2)"
    smooth = lambda c: f"CASE WHEN edge THEN {c} ELSE {d.q(f'({c}3 + {c} * 4) / 13.0e0')} END"
    tint = {"r": "s.image_id % 256", "g": "255", "b": "255"}
    return ", ".join([
        "mine AS (SELECT * FROM px WHERE image_id % 7 <> 0)", d.each("mine", "k1", lambda c: d.q(f"{c} * {bright}")), d.moved("k1", "k2", "w - 1 - s.x", "s.y"),
        d.boxed("k2", "k3", "rgb"), d.each("k3", "k4", lambda c: d.q(f"({smooth(c)}) * (1.0e0 - {sharp}) + {c} * {sharp}")), d.each("k4", "k5", lambda c: d.q(f"{c} * 0.75e0 + {tint[c]} * 0.25e0")),
        "o AS (SELECT image_id, y, x, r, g, b FROM k5 UNION ALL SELECT image_id, y, x, r, g, b FROM px WHERE image_id % 7 = 0)",
    ])


def _branches() -> str:
    a = f"{d.sepia('pa', 'a1')}, {d.crop('a1', 'a2', 1, 1, 7, 6)}"
    b = f"{d.moved('pb', 'b1', 's.y', 'w - 1 - s.x')}, {d.brightness('b1', 'b2', 1.2)}, {d.contrast('b2', 'b3', 0.8)}"
    c = f"{d.pixelate('pc', 'c1', 3)}, {d.edges('c1', 'c2')}"
    split = ", ".join(f"p{n} AS (SELECT * FROM px WHERE image_id % 3 = {k})" for k, n in enumerate("abc"))
    return f"{split}, {a}, {b}, {c}, o AS (SELECT image_id, y, x, r, g, b FROM a2 UNION ALL SELECT image_id, y, x, r, g, b FROM b3 UNION ALL SELECT image_id, y, x, r, g, b FROM c2)"


STAT_COLUMNS = "image_id, r_mean, r_std, g_mean, g_std, b_mean, b_std, gray_mean, gray_std, s_mean, w, h, edge_mean"
_alpha_sql = "pa AS (SELECT *, (x * 31 + y * 17 + image_id) % 256 AS a FROM px), " + d.each("pa", "o", lambda c: d.q(f"{c} * (a / 255.0e0) + 255.0e0 * (1.0e0 - a / 255.0e0)"))
# The other image of each pair is the same one in gray; pixel by pixel that needs no second look at the table.
_blend_sql = d.each("px", "o", lambda c: d.lerp(c, d.q(d.GRAY), 0.35))
_marked = d.rotate("px", "w0", 30.0, (9, 8, 7)) + ", " + d.watermark("w0", "w1", MASK, 3, 3, 80, 45.0, resample.GAP)
_chain = f"{d.grayscale('px', 'p1', 0.6)}, {d.resize('p1', 'p2', 12, 6)}, {d.moved('p2', 'p3', 'w - 1 - s.x', 'h - 1 - s.y')}, {d.sharpen('p3', 'o', 1.5)}"

_ALL = [
    _pair("k4_flatten_alpha", lambda p: point.flatten_alpha(_alpha(p)), _alpha_sql),
    _pair("r1_grayscale", point.grayscale, d.grayscale("px", "o")),
    _pair("r1_grayscale_partial", lambda p: point.grayscale(p, 0.4), d.grayscale("px", "o", 0.4)),
    _pair("r2_sepia", lambda p: point.sepia(p, 0.8), d.sepia("px", "o", 0.8)),
    _pair("r3_color_tint", lambda p: point.color_tint(p, 200, 80, 10), d.tint("px", "o", (200, 80, 10), 0.3)),
    _pair("r4_posterize", lambda p: point.posterize(p, 3), d.posterize("px", "o", 3)),
    _pair("r5_brightness", lambda p: point.brightness(p, 1.3), d.brightness("px", "o", 1.3)),
    _pair("r6_crop", lambda p: point.crop(p, 2.0, -1.0, 19.4, 6.0), d.crop("px_wide", "o", 2, -1, 19, 6), "px_wide"),
    _pair("r7_flip", lambda p: point.flip(p, "both"), d.moved("px_wide", "o", "w - 1 - s.x", "h - 1 - s.y"), "px_wide"),
    _pair("r7_mirror", point.flip, d.moved("px_wide", "o", "w - 1 - s.x", "s.y"), "px_wide"),
    _pair("r8_rotate_quadrant", lambda p: point.rotate_quadrant(p, 90), d.moved("px_wide", "o", "s.y", "w - 1 - s.x"), "px_wide"),
    _pair("r8_rotate_270", lambda p: point.rotate_quadrant(p, 270), d.moved("px_wide", "o", "h - 1 - s.y", "s.x"), "px_wide"),
    _pair("r9_blend", lambda p: point.blend(p, point.grayscale(p), 0.35), _blend_sql),
    _pair("r10_resize", lambda p: resample.resize(p, 5, 12), d.resize("px_wide", "o", 5, 12), "px_wide"),
    _pair("r10_resize_scale", lambda p: resample.resize(p, 3, 3, 1.7), d.resize("px_wide", "o", "trunc(w * 1.7e0)", "trunc(h * 1.7e0)"), "px_wide"),
    _pair("r12_thumbnail", lambda p: resample.thumbnail(p, 6, 6), d.thumbnail("px_wide", "o", 6, 6), "px_wide"),
    _pair("r13_pixelate", lambda p: resample.pixelate(p, 3), d.pixelate("px_wide", "o", 3), "px_wide"),
    _pair("r14_rotate", lambda p: resample.rotate(p, 30.0, True, (9, 8, 7)), d.rotate("px", "o", 30.0, (9, 8, 7))),
    _pair(
        "r15_watermark_overlay",
        lambda p: resample.watermark_overlay(p, p.sparkSession.createDataFrame(MASK, "my int, mx int, kind int"), 3, 3, 80, 45.0, "white", 2),
        d.watermark("px_wide", "o", MASK, 3, 3, 80, 45.0, 2), "px_wide",
    ),
    _pair("r16_gaussian_blur", lambda p: window.gaussian_blur(p, 1.5), d.blur("px", "o", 1.5)),
    _pair("r16_gaussian_blur_passes", lambda p: window.gaussian_blur(p, 2.0, 2), d.blur("px", "o1", 1.0) + ", " + d.blur("o1", "o", 1.0)),
    _pair("r17_sharpen", lambda p: window.sharpen(p, 2.0), d.sharpen("px", "o", 2.0)),
    _pair("r18_edges", window.edges, d.edges("px", "o")),
    _pair("r19_sharpen_kernel", window.sharpen_kernel, d.sharpen_kernel("px", "o")),
    _pair("r20_contrast", lambda p: window.contrast(p, 1.4), d.contrast("px", "o", 1.4)),
    _pair("r21_brightness_contrast", lambda p: window.brightness_contrast(p, 1.2, 0.8), d.brightness("px", "o1", 1.2) + ", " + d.contrast("o1", "o", 0.8)),
    _pair("r22_ocr_binarize", window.ocr_binarize, d.binarize("px", "o", 170)),
    _pair("r23_image_stats", window.image_stats, d.stats("px", "o"), columns=STAT_COLUMNS),
    _pair("r24_image_features", window.image_features, d.features("px", "o"), columns="*"),
    _pair("r25_nearest_centroid", lambda p: window.nearest_centroid(window.image_features(p)), d.centroids("px", "o"), columns="*"),
    _pair("r26_topk_labels", lambda p: window.topk_labels(window.nearest_centroid(window.image_features(p))), d.topk("px", "o", 3), columns="*"),
    _pair("r27_image_info", window.image_info, f"o AS (SELECT image_id, w AS width, h AS height, w * h * 3 AS n_bytes FROM {d.sizes('px_wide')})", "px_wide", "*"),
    _pair("r28_apply_pipeline", lambda p: apply_pipeline(p, PIPELINE), _chain),
    _pair("r28_apply_steps_without_pixels", lambda p: apply_pipeline(p, SAYING, _glyphs(p.sparkSession)), _marked + ", " + d.brightness("w1", "o", 1.2)),
    _pair("r28_pipeline_metadata", _said, _marked + ", " + d.topk("w1", "t", 3) + ", o AS (SELECT image_id, true AS no_reader, label, labels FROM t)", columns="*"),
    _pair("r28_own_steps", lambda p: apply_specs(p, _own_steps(p)), _own_steps_sql()),
    _pair("r28_apply_pipelines", lambda p: apply_pipelines(p, _spec(p), PIPELINES), _branches()),
]
QUERIES = {name: run for name, run, _ in _ALL}
ORACLE_SQL = {name: text for name, _, text in _ALL}

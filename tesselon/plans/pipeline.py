"""Ordered pipelines of raster transforms: one for all images, or one per image."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.functions.pixels import PX, shuffled
from tesselon.operators import raster_point as point
from tesselon.operators import raster_resample as resample
from tesselon.operators import raster_window as window

Step = tuple[str, dict]
#: A text and its size as a mask: the table ``(my, mx, kind)``, its width and its height. Fonts are the caller's.
Glyphs = Callable[[str, int], tuple[DataFrame, int, int]]

# Steps that leave the pixels as they are.
NO_PIXELS = ("ocr", "inference", "format_conversion")


def colour(value) -> tuple[int, int, int]:
    """A fill as ``#rrggbb``, as ``r,g,b``, as one of the watermark's colours, or as a tuple; none is black."""
    if value is None or value == "":
        return (0, 0, 0)
    if isinstance(value, (tuple, list)):
        return tuple(int(v) for v in value[:3])
    text = str(value).strip().lower()
    if text in resample.COLOURS:
        return resample.COLOURS[text]
    if text.startswith("#") and len(text) == 7:
        return tuple(int(text[k : k + 2], 16) for k in (1, 3, 5))
    parts = text.strip("()").split(",")
    if len(parts) == 3 and all(p.strip().isdigit() for p in parts):
        return tuple(min(int(p), 255) for p in parts)
    raise ValueError(f"unknown colour: {value}")


def _truth(v) -> bool:
    return str(v).lower() == "true"


def apply_step(px: DataFrame, step: Step, glyphs: Glyphs | None = None) -> DataFrame:
    """One named transform; parameters may be strings. Unknown names raise, as they do when requests are parsed.

    Reading text, classification and the choice of an output format leave the pixels as they are; what they say is metadata.
    """
    name, p = step[0].lower(), step[1]
    number = lambda k, d: float(p.get(k, d))
    if name == "grayscale":
        return point.grayscale(px, number("intensity", 1.0))
    if name == "sepia":
        return point.sepia(px, number("intensity", 1.0))
    if name == "color_tint":
        return point.color_tint(px, *(int(p.get(c, 255)) for c in "rgb"), number("intensity", 0.3))
    if name == "posterize":
        return point.posterize(px, int(p.get("bits", 4)))
    if name == "crop":
        return point.crop(px, *(float(p[k]) for k in ("left", "upper", "right", "lower")))
    if name == "flip":
        return point.flip(px, p.get("direction", "horizontal"))
    if name == "rotate":
        angle, expand = number("angle", 0) % 360, _truth(p.get("expand", "true"))
        if angle == 0:
            return px.select(*PX)
        return point.rotate_quadrant(px, int(angle)) if angle % 90 == 0 and (expand or angle == 180) else resample.rotate(px, angle, expand, colour(p.get("fill_color")))
    if name == "resize":
        side = lambda k: int(p[k]) if p.get(k) else None
        return resample.resize(px, side("width"), side("height"), float(p["scale"]) if p.get("scale") else None)
    if name == "thumbnail":
        return resample.thumbnail(px, int(p.get("width", 256)), int(p.get("height", 256)))
    if name == "pixelate":
        return resample.pixelate(px, int(p.get("block_size", 10)))
    if name == "blur":
        return window.gaussian_blur(px, number("radius", 2.0))
    if name == "sharpen":
        return window.sharpen(px, number("factor", 2.0))
    if name == "edges":
        return window.edges(px)
    if name in ("brightness", "contrast", "brightness_contrast"):
        return window.brightness_contrast(px, number("brightness", 1.0), number("contrast", 1.0))
    if name == "watermark_text":
        if glyphs is None:
            raise ValueError("watermark_text asks for glyphs")
        mask, wide, high = glyphs(p.get("text", ""), int(number("size", 60)))
        return resample.watermark_overlay(px, mask, wide, high, int(number("opacity", 80)), number("angle", 45.0), p.get("color", p.get("fill", "white")))
    if name in NO_PIXELS:
        return px.select(*PX)
    raise ValueError(f"unknown transform: {step[0]}")


def apply_pipeline(px: DataFrame, steps: Sequence[Step], glyphs: Glyphs | None = None) -> DataFrame:
    """All images through ``steps`` in order. Point steps fuse into one projection."""
    return reduce(lambda p, step: apply_step(p, step, glyphs), steps, px.select(*PX))


def step_metadata(px: DataFrame, step: Step, read_text: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """What a step says of each image, ``(image_id, said)`` with ``said`` a map, or None for steps that say nothing.

    ``read_text`` takes binarised pixels and gives ``(image_id, text)``; without it the step tells that there is no reader.
    """
    name, p = step[0].lower(), step[1]
    if name == "inference":
        top = window.topk_labels(window.nearest_centroid(window.image_features(px)))
        told = F.to_json(F.struct("label", F.split("labels", ",").alias("labels"), "score"))
        return top.select("image_id", F.create_map(F.lit("classification_result"), told).alias("said"))
    if name == "ocr":
        if read_text is None:
            return px.select("image_id").distinct().select("image_id", F.create_map(F.lit("ocr_error"), F.lit("no reader of text is installed")).alias("said"))
        read = read_text(window.ocr_binarize(px, int(p.get("threshold", 170))))
        return read.select("image_id", F.create_map(F.lit("extracted_text"), F.to_json(F.struct(F.trim("text").alias("text")))).alias("said"))
    return None


def pipeline_metadata(px: DataFrame, steps: Sequence[Step], glyphs: Glyphs | None = None, read_text: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(image_id, metadata)``: what the steps say of each image at the point where they stand; later steps win."""
    told, now = [], px.select(*PX)
    for k, step in enumerate(steps):
        said = step_metadata(now, step, read_text)
        if said is not None:
            told.append(said.select("image_id", F.lit(k).alias("step"), F.explode("said").alias("name", "value")))
        now = apply_step(now, step, glyphs)
    images = px.select("image_id").distinct()
    if not told:
        return images.select("image_id", F.create_map().cast("map<string,string>").alias("metadata"))
    last = reduce(DataFrame.union, told).groupBy("image_id", "name").agg(F.max_by("value", "step").alias("value"))
    merged = last.groupBy("image_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metadata"))
    return images.join(shuffled(merged), "image_id", "left").select("image_id", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def apply_pipelines(px: DataFrame, specs: DataFrame, pipelines: dict[str, Sequence[Step]], glyphs: Glyphs | None = None) -> DataFrame:
    """``specs(image_id, signature)`` names each image's pipeline among ``pipelines``; other images come through unchanged."""
    from tesselon.plans.steps import STEPS, apply_specs

    rows = [(name, [(step, {k: str(v) for k, v in params.items() if v is not None}) for step, params in steps]) for name, steps in pipelines.items()]
    table = px.sparkSession.createDataFrame(rows, f"signature string, steps {STEPS}")
    return apply_specs(px, specs.join(table, "signature").select("image_id", "steps"), glyphs)

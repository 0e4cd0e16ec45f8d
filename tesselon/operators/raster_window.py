"""Neighbourhood and whole-image raster operators: windows along rows and columns, and aggregates per image."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselon.functions.pixels import PX, RGB, channel, each_channel, gray, image_sizes, shuffled
from tesselon.operators.raster_point import brightness


def in_row() -> WindowSpec:
    return W.partitionBy("image_id", "y").orderBy("x")


def in_column() -> WindowSpec:
    return W.partitionBy("image_id", "x").orderBy("y")


def boxed(px: DataFrame, channels: list[str]) -> DataFrame:
    """``px`` with the 3x3 sum ``<c>3`` of each channel, and ``edge``: whether the pixel lies on the border.

    Windows run along one row, then one column of an image, so their partitions stay as small as a side.
    """
    across = px
    for c in channels:
        across = across.withColumn(f"{c}3", F.sum(c).over(in_row().rowsBetween(-1, 1)))
    across = across.withColumn("edge_x", F.lag("x").over(in_row()).isNull() | F.lead("x").over(in_row()).isNull())
    for c in channels:
        across = across.withColumn(f"{c}3", F.sum(f"{c}3").over(in_column().rowsBetween(-1, 1)))
    return across.withColumn("edge", F.col("edge_x") | F.lag("y").over(in_column()).isNull() | F.lead("y").over(in_column()).isNull()).drop("edge_x")


def gaussian_weights(radius: float) -> list[float]:
    n = math.ceil(2.5 * radius)
    raw = [math.exp(-(i * i) / (2.0 * radius * radius)) for i in range(-n, n + 1)]
    return [v / sum(raw) for v in raw]


def gaussian_blur(px: DataFrame, radius: float = 2.0, passes: int = 1) -> DataFrame:
    """Separable Gaussian; the border value repeats outwards. ``passes`` of ``radius / passes`` each are applied in turn."""
    if radius <= 0:
        return px.select(*PX)
    for _ in range(passes):
        weights = gaussian_weights(radius / passes)
        half = len(weights) // 2

        def run(c: str, w) -> Column:
            full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            first, last = F.first(c).over(full), F.last(c).over(full)
            taps = [F.coalesce(F.lag(c, i).over(w), first) * F.lit(weights[half - i]) for i in range(half, 0, -1)]
            taps += [F.col(c) * F.lit(weights[half])]
            taps += [F.coalesce(F.lead(c, i).over(w), last) * F.lit(weights[i + half]) for i in range(1, half + 1)]
            return sum(taps[1:], taps[0])

        flat = px.select("image_id", "y", "x", *[run(c, in_row()).alias(c) for c in RGB])
        flat = flat.select("image_id", "y", "x", *[run(c, in_column()).alias(c) for c in RGB])
        px = each_channel(flat, lambda c: channel(F.col(c)))
    return px


def sharpen(px: DataFrame, factor: float = 2.0) -> DataFrame:
    """``smooth * (1 - factor) + image * factor``; smooth is (box + 4 * centre) / 13, border pixels as they are."""
    return sharpened(px, F.lit(float(factor)))


def sharpened(px: DataFrame, factor: Column) -> DataFrame:
    """As `sharpen`, by a factor that may be a column of ``px``."""

    def out(c: str) -> Column:
        smooth = F.when(F.col("edge"), F.col(c)).otherwise(channel((F.col(f"{c}3") + F.col(c) * 4) / F.lit(13.0)))
        return channel(smooth * (F.lit(1.0) - factor) + F.col(c) * factor)

    return each_channel(boxed(px, RGB), out)


def _gray_kernel(px: DataFrame, make) -> DataFrame:
    flat = boxed(px.select("image_id", "y", "x", gray().alias("v")), ["v"])
    value = F.when(F.col("edge"), F.col("v")).otherwise(channel(make(F.col("v"), F.col("v3"))))
    return flat.select("image_id", "y", "x", *[value.alias(c) for c in RGB])


def edges(px: DataFrame) -> DataFrame:
    """Gray, then 9 * centre - box; border pixels keep their gray."""
    return _gray_kernel(px, lambda v, box: (v * 9 - box).cast("double"))


def sharpen_kernel(px: DataFrame) -> DataFrame:
    """Gray, then (34 * centre - 2 * box) / 16; border pixels keep their gray."""
    return _gray_kernel(px, lambda v, box: (v * 34 - box * 2) / F.lit(16.0))


def per_image(px: DataFrame, **aggregates: Column) -> DataFrame:
    """``px`` with aggregates per image. Aggregate and join, not a window: no task has to hold a whole image."""
    return px.join(shuffled(px.groupBy("image_id").agg(*[c.alias(n) for n, c in aggregates.items()])), "image_id")


def contrast(px: DataFrame, factor: float = 1.0) -> DataFrame:
    return px.select(*PX) if factor == 1 else contrasted(px, F.lit(float(factor)))


def contrasted(px: DataFrame, factor: Column) -> DataFrame:
    """Away from or towards the image's mean gray, by a factor that may be a column of ``px``."""
    mean = F.floor(F.avg(gray()) + F.lit(0.5))
    return each_channel(per_image(px, mean=mean), lambda c: channel(F.col("mean") * (F.lit(1.0) - factor) + F.col(c) * factor))


def brightness_contrast(px: DataFrame, b: float = 1.0, c: float = 1.0) -> DataFrame:
    return contrast(brightness(px, b), c)


def ocr_binarize(px: DataFrame, threshold: int = 170) -> DataFrame:
    """Gray, stretched from its darkest to its lightest value, cut at ``threshold``, inverted where mostly black."""
    flat = per_image(px.select("image_id", "y", "x", gray().alias("v")), lo=F.min("v"), hi=F.max("v"))
    spread = F.col("hi") - F.col("lo")
    stretched = F.when(spread > 0, channel((F.col("v") - F.col("lo")) * F.lit(255.0) / spread)).otherwise(F.col("v"))
    cut = flat.select("image_id", "y", "x", F.when(stretched >= threshold, 255).otherwise(0).alias("v"))
    out = per_image(cut, mean=F.avg("v"))
    value = F.when(F.col("mean") < 127, 255 - F.col("v")).otherwise(F.col("v"))
    return out.select("image_id", "y", "x", *[value.alias(c) for c in RGB])


def image_stats(px: DataFrame) -> DataFrame:
    """Per image: mean and population deviation of each channel and of gray, mean saturation, mean edge strength."""
    top, low = F.greatest(*RGB), F.least(*RGB)
    saturation = F.when(top > 0, F.floor((top - low) * F.lit(255.0) / top)).otherwise(0)
    base = px.select(*PX, gray().alias("v"), saturation.alias("s"))
    means = [F.round(f(c), 6).alias(f"{n}_{k}") for c, n in (("r", "r"), ("g", "g"), ("b", "b"), ("v", "gray")) for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    plain = base.groupBy("image_id").agg(*means, F.round(F.avg("s"), 6).alias("s_mean"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    edge = edges(px).groupBy("image_id").agg(F.round(F.avg("r"), 6).alias("edge_mean"))
    return plain.join(shuffled(edge), "image_id")


FEATURES = ["brightness", "contrast", "saturation", "edge_density", "aspect_ratio", "color_variance"]


def image_features(px: DataFrame) -> DataFrame:
    s = image_stats(px)
    made = {
        "brightness": F.col("gray_mean") / 255.0,
        "contrast": F.col("gray_std") / 128.0,
        "saturation": F.col("s_mean") / 255.0,
        "edge_density": F.col("edge_mean") / 255.0,
        "aspect_ratio": F.col("w") / F.greatest(F.col("h"), F.lit(1)),
        "color_variance": (F.col("r_std") + F.col("g_std") + F.col("b_std")) / 3.0 / 128.0,
    }
    return s.select("image_id", *[F.round(v, 6).alias(n) for n, v in made.items()])


# Labels and centroids in the order of FEATURES.
CENTROIDS = (
    ("bright_scene", 0.82, 0.28, 0.25, 0.18, 1.30, 0.22),
    ("dark_scene", 0.18, 0.22, 0.18, 0.16, 1.20, 0.15),
    ("colorful_scene", 0.56, 0.30, 0.72, 0.24, 1.35, 0.68),
    ("monochrome_scene", 0.52, 0.20, 0.05, 0.17, 1.00, 0.04),
    ("portrait_layout", 0.58, 0.24, 0.34, 0.18, 0.72, 0.26),
    ("landscape_layout", 0.58, 0.24, 0.34, 0.18, 1.55, 0.26),
    ("high_texture", 0.48, 0.42, 0.33, 0.62, 1.05, 0.31),
    ("low_contrast_flat", 0.50, 0.12, 0.15, 0.12, 1.30, 0.10),
    ("vibrant_high_color", 0.62, 0.48, 0.88, 0.32, 1.40, 0.82),
    ("panoramic", 0.55, 0.28, 0.35, 0.22, 3.20, 0.24),
    ("square_format", 0.55, 0.28, 0.35, 0.22, 1.00, 0.24),
    ("high_detail_urban", 0.52, 0.45, 0.42, 0.82, 1.35, 0.45),
)


def nearest_centroid(features: DataFrame, centroids=CENTROIDS) -> DataFrame:
    """``(image_id, pos, label, distance, confidence)`` for every label of the model; the model is a literal array, so nothing is joined."""
    model = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(c[0]).alias("label"), F.array(*map(F.lit, map(float, c[1:]))).alias("at")) for k, c in enumerate(centroids)])
    own = F.array(*FEATURES)
    each = features.select("image_id", own.alias("own"), F.explode(model).alias("m"))
    square = F.aggregate(F.zip_with("own", "m.at", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    told = each.select("image_id", "m.pos", "m.label", F.round(F.sqrt(square), 6).alias("distance"))
    return told.withColumn("confidence", F.round(F.lit(1.0) / (F.lit(1.0) + F.col("distance")), 6))


def topk_labels(distances: DataFrame, k: int = 3) -> DataFrame:
    """Per image the nearest label, the ``k`` nearest in order and the confidence of the first; draws go to the label listed first."""
    near = F.slice(F.array_sort(F.collect_list(F.struct("distance", "pos", "label", "confidence"))), 1, k)
    top = distances.groupBy("image_id").agg(near.alias("near"))
    return top.select(
        "image_id", F.element_at("near", 1)["label"].alias("label"), F.array_join(F.transform("near", lambda n: n["label"]), ",").alias("labels"), F.round(F.element_at("near", 1)["confidence"], 4).alias("score")
    )


def image_info(px: DataFrame) -> DataFrame:
    """Width, height and bytes of the raw raster."""
    return image_sizes(px).select("image_id", F.col("w").alias("width"), F.col("h").alias("height"), (F.col("w") * F.col("h") * 3).cast("bigint").alias("n_bytes"))

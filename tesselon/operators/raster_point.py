"""Raster operators that look at one pixel at a time: projections, filters and coordinate shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.functions.pixels import PX, RGB, channel, each_channel, gray, image_sizes, lerp, shuffled, with_size


def flatten_alpha(px: DataFrame) -> DataFrame:
    """RGBA over white: ``c * a / 255 + 255 * (1 - a / 255)``; a null alpha counts as opaque."""
    share = F.coalesce(F.col("a"), F.lit(255)) / F.lit(255.0)
    return each_channel(px, lambda c: channel(F.col(c) * share + F.lit(255.0) * (F.lit(1.0) - share)))


def grayscale(px: DataFrame, intensity: float = 1.0) -> DataFrame:
    return each_channel(px, lambda c: gray() if intensity >= 1 else lerp(F.col(c), gray(), intensity))


def sepia(px: DataFrame, intensity: float = 1.0) -> DataFrame:
    # The rows of the sepia matrix.
    rows = {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}

    def toned(c: str):
        m = rows[c]
        v = F.least((F.col("r") * m[0] + F.col("g") * m[1] + F.col("b") * m[2]).cast("int"), F.lit(255))
        return v if intensity == 1 else lerp(F.col(c), v, intensity)

    return each_channel(px, toned)


def color_tint(px: DataFrame, r: int = 255, g: int = 255, b: int = 255, intensity: float = 0.3) -> DataFrame:
    tint = {"r": r, "g": g, "b": b}
    return each_channel(px, lambda c: lerp(F.col(c), F.lit(tint[c]), intensity))


def posterize(px: DataFrame, bits: int = 4) -> DataFrame:
    step = 1 << (8 - min(max(bits, 1), 8))
    return each_channel(px, lambda c: (F.col(c) - F.col(c) % step).cast("int"))


def brightness(px: DataFrame, factor: float = 1.0) -> DataFrame:
    return px.select(*PX) if factor == 1 else each_channel(px, lambda c: channel(F.col(c) * F.lit(float(factor))))


def crop(px: DataFrame, left: float, upper: float, right: float, lower: float) -> DataFrame:
    """The box, rounded to pixels; where it leaves the image the result is black."""
    x0, y0, x1, y1 = (int(round(v)) for v in (left, upper, right, lower))
    inside = px.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    moved = inside.select("image_id", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), *RGB)
    images = image_sizes(px)
    outside = images.where((F.lit(x0) < 0) | (F.lit(y0) < 0) | (F.col("w") < x1) | (F.col("h") < y1))
    if x1 <= x0 or y1 <= y0:
        return moved
    grid = outside.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(y1 - y0 - 1))).alias("y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(x1 - x0 - 1))).alias("x"))
    blank = grid.where(~(F.col("x") + x0).between(F.lit(0), F.col("w") - 1) | ~(F.col("y") + y0).between(F.lit(0), F.col("h") - 1))
    return moved.union(blank.select("image_id", "y", "x", *[F.lit(0).alias(c) for c in RGB]))


def flip(px: DataFrame, direction: str = "horizontal") -> DataFrame:
    """Mirror, flip or both; an unknown direction mirrors."""
    sized = with_size(px)
    x, y = F.col("w") - 1 - F.col("x"), F.col("h") - 1 - F.col("y")
    kind = direction.lower()
    return sized.select("image_id", (F.col("y") if kind not in ("vertical", "both") else y).alias("y"), (F.col("x") if kind == "vertical" else x).alias("x"), *RGB)


def rotate_quadrant(px: DataFrame, angle: int) -> DataFrame:
    """Counter-clockwise by 90, 180 or 270 degrees; quarter turns swap the sides."""
    sized = with_size(px)
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    to = {0: (y, x), 90: (w - 1 - x, y), 180: (h - 1 - y, w - 1 - x), 270: (x, h - 1 - y)}[angle % 360]
    return sized.select("image_id", to[0].alias("y"), to[1].alias("x"), *RGB)


def blend(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """``a * (1 - alpha) + b * alpha`` over the pixels both have."""
    other = b.select("image_id", "y", "x", *[F.col(c).alias(f"{c}2") for c in RGB])
    joined = a.join(shuffled(other), ["image_id", "y", "x"])
    return each_channel(joined, lambda c: lerp(F.col(c), F.col(f"{c}2"), alpha))

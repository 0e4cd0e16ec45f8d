"""Pixel arithmetic as column expressions. Values are computed in double, rounded half up and clamped to 0..255."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PX = ["image_id", "y", "x", "r", "g", "b"]
RGB = ["r", "g", "b"]


def channel(v: Column) -> Column:
    """A double as a channel value. Rounded to six digits first, so that sums in any order agree."""
    return F.least(F.greatest(F.floor(F.round(v, 6) + F.lit(0.5)), F.lit(0)), F.lit(255)).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return channel((r * 299 + g * 587 + b * 114) / F.lit(1000.0))


def gray() -> Column:
    return luma(F.col("r"), F.col("g"), F.col("b"))


def lerp(a: Column, b: Column, alpha: float) -> Column:
    return channel(a * F.lit(1.0 - alpha) + b * F.lit(float(alpha)))


def each_channel(px: DataFrame, make: Callable[[str], Column]) -> DataFrame:
    """``px`` with every channel replaced by ``make(name)``."""
    return px.select("image_id", "y", "x", *[make(c).alias(c) for c in RGB])


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle. The planner takes exploded rows for as few as the stored ones they come from, and would
    collect pixels in the driver to broadcast them."""
    return df.hint("merge")


def image_sizes(px: DataFrame) -> DataFrame:
    """``(image_id, w, h)``; partial aggregation leaves one row per image and task to shuffle."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def with_size(px: DataFrame) -> DataFrame:
    return px.join(shuffled(image_sizes(px)), "image_id")

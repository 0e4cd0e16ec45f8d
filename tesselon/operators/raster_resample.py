"""Resampling raster operators: resize, thumbnail, pixelate, rotation by any angle, watermark overlay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.pixels import PX, RGB, channel, image_sizes, shuffled, with_size

PI = math.pi


def axis_weights(pairs: DataFrame) -> DataFrame:
    """``pairs(n_in, n_out)`` as sparse Lanczos rows ``(n_in, n_out, o, i, weight)``; the weights of each ``o`` sum to 1.

    One row per output position and tap: as small as the distinct image sides, whatever the number of images.
    """
    scale = F.greatest(F.col("n_in") / F.col("n_out"), F.lit(1.0))
    centre = (F.col("o") + F.lit(0.5)) * F.col("n_in") / F.col("n_out")
    outs = pairs.select("n_in", "n_out", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("o"))
    outs = outs.withColumn("s", scale).withColumn("c", centre)
    low = F.greatest(F.floor(F.col("c") - F.lit(3.0) * F.col("s")), F.lit(0)).cast("int")
    high = F.least(F.ceil(F.col("c") + F.lit(3.0) * F.col("s")), F.col("n_in") - 1).cast("int")
    taps = outs.select("*", F.explode(F.sequence(low, high)).alias("i"))
    t = F.round((F.col("i") + F.lit(0.5) - F.col("c")) / F.col("s"), 9)
    raw = F.when(t == 0, F.lit(1.0)).when(F.abs(t) < 3, F.lit(3.0) * F.sin(t * PI) * F.sin(t * PI / 3.0) / (t * PI * t * PI)).otherwise(F.lit(0.0))
    weighed = taps.withColumn("raw", raw)
    total = weighed.groupBy("n_in", "n_out", "o").agg(F.sum("raw").alias("total"))
    return weighed.join(total, ["n_in", "n_out", "o"]).select("n_in", "n_out", "o", "i", (F.col("raw") / F.col("total")).alias("weight"))


# Parts that the pixels of one side length are dealt over.
PARTS = 64


def weighed(px: DataFrame, sizes: DataFrame, wide: DataFrame, high: DataFrame) -> DataFrame:
    """A sparse product along x, then along y, rounded once at the end: ``sizes(image_id, kx, ky)`` names each image's rows of the weights
    ``wide`` and ``high`` ``(key, o, i, weight)``.

    Images of one size share a few keys, so their pixels are dealt over parts by image, and each part gets the weights: neither the
    pixels nor weights of many sides are broadcast, and no task has all pixels of a column.
    """
    part = F.pmod(F.xxhash64("image_id"), F.lit(PARTS))
    dealt = lambda weights, key, at: shuffled(weights.select(F.col("key").alias(key), F.col("i").alias(at), "o", "weight", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part")))
    base = px.join(shuffled(sizes), "image_id").withColumn("part", part)
    across = (
        base.join(dealt(wide, "kx", "x"), ["kx", "x", "part"])
        .groupBy("image_id", "ky", "y", F.col("o").alias("ox"))
        .agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in RGB])
    )
    down = (
        across.withColumn("part", part).join(dealt(high, "ky", "y"), ["ky", "y", "part"])
        .groupBy("image_id", F.col("o").alias("oy"), "ox")
        .agg(*[channel(F.sum(F.col(c) * F.col("weight"))).alias(c) for c in RGB])
    )
    return down.select("image_id", F.col("oy").alias("y"), F.col("ox").alias("x"), *RGB)


def resized(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """``px`` resampled to ``sizes(image_id, w, h, nw, nh)``."""
    weights = [axis_weights(sizes.select(F.col(a).alias("n_in"), F.col(b).alias("n_out")).distinct()).select(F.struct("n_in", "n_out").alias("key"), "o", "i", "weight") for a, b in (("w", "nw"), ("h", "nh"))]
    key = lambda a, b: F.struct(F.col(a).alias("n_in"), F.col(b).alias("n_out"))
    return weighed(px, sizes.select("image_id", key("w", "nw").alias("kx"), key("h", "nh").alias("ky")), *weights)


def blurred(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each image by its own Gaussian ``sizes(image_id, w, h, radius)``, with radii above zero; the border value repeats outwards."""

    def weights(side: str) -> DataFrame:
        taps = F.sequence(-F.ceil(F.col("radius") * 2.5).cast("int"), F.ceil(F.col("radius") * 2.5).cast("int"))
        bell = sizes.select("radius").distinct().select("radius", F.explode(taps).alias("d"))
        bell = bell.withColumn("raw", F.exp(-(F.col("d") * F.col("d")) / (F.lit(2.0) * F.col("radius") * F.col("radius"))))
        bell = bell.join(bell.groupBy("radius").agg(F.sum("raw").alias("total")), "radius").select("radius", "d", (F.col("raw") / F.col("total")).alias("weight"))
        outs = sizes.select(F.col(side).alias("n"), "radius").distinct().select("n", "radius", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
        source = F.least(F.greatest(F.col("o") + F.col("d"), F.lit(0)), F.col("n") - 1)
        return outs.join(bell, "radius").groupBy(F.struct("n", "radius").alias("key"), "o", source.alias("i")).agg(F.sum("weight").alias("weight"))

    key = lambda side: F.struct(F.col(side).alias("n"), "radius")
    return weighed(px, sizes.select("image_id", key("w").alias("kx"), key("h").alias("ky")), weights("w"), weights("h"))


def resize(px: DataFrame, width: int | None = None, height: int | None = None, scale: float | None = None) -> DataFrame:
    """A missing side keeps the source's; ``scale`` wins over both. Images that keep their size pass by untouched."""
    size = image_sizes(px)
    if scale:
        nw, nh = ((F.col(c) * F.lit(float(scale))).cast("int") for c in ("w", "h"))
    else:
        nw, nh = (F.lit(int(v)) if v else F.col(c) for v, c in ((width, "w"), (height, "h")))
    return resized_where_needed(px, size.withColumn("nw", nw).withColumn("nh", nh))


def resized_where_needed(px: DataFrame, sizes: DataFrame) -> DataFrame:
    same = (F.col("nw") == F.col("w")) & (F.col("nh") == F.col("h"))
    return px.join(shuffled(sizes.where(same).select("image_id")), "image_id", "left_semi").select(*PX).union(resized(px, sizes.where(~same)).select(*PX))


def fitted_sides(sizes: DataFrame, width: Column, height: Column) -> DataFrame:
    """``sizes(w, h, ...)`` with the sides ``nw`` and ``nh`` that fit the box."""
    s = F.least(width / F.col("w"), height / F.col("h"), F.lit(1.0))
    side = lambda c: F.greatest(F.floor(F.round(F.col(c) * s, 6) + F.lit(0.5)), F.lit(1)).cast("int")
    return sizes.withColumn("nw", side("w")).withColumn("nh", side("h"))


def thumbnail(px: DataFrame, width: int = 256, height: int = 256) -> DataFrame:
    """Shrink into the box, sides in proportion; images that fit stay as they are."""
    return resized_where_needed(px, fitted_sides(image_sizes(px), F.lit(float(width)), F.lit(float(height))))


def pixelate(px: DataFrame, block: int = 10) -> DataFrame:
    """Nearest shrink by ``block``, nearest grow back; a block of 1 or less does nothing. A side shorter than a block keeps one cell."""
    return px.select(*PX) if block <= 1 else from_cells(with_size(px.select(*PX)), F.lit(block))


def from_cells(sized: DataFrame, block: Column) -> DataFrame:
    """As `pixelate`, of pixels with their image's ``w`` and ``h``, by a block of 1 and more that may be a column."""

    def source(v: Column, n: Column) -> Column:
        cells = F.greatest(F.floor(n / block), F.lit(1))
        cell = F.floor((v + F.lit(0.5)) * cells / n)
        return F.least(F.floor((cell + F.lit(0.5)) * n / cells), n - 1).cast("int")

    asked = sized.select("image_id", F.col("y").alias("oy"), F.col("x").alias("ox"), source(F.col("y"), F.col("h")).alias("y"), source(F.col("x"), F.col("w")).alias("x"))
    return asked.join(shuffled(sized.select(*PX)), ["image_id", "y", "x"]).select("image_id", F.col("oy").alias("y"), F.col("ox").alias("x"), *RGB)


def _cubic(t: Column) -> Column:
    """Keys' kernel with a = -1/2."""
    a = F.abs(t)
    near = F.lit(1.5) * a * a * a - F.lit(2.5) * a * a + F.lit(1.0)
    far = F.lit(-0.5) * a * a * a + F.lit(2.5) * a * a - F.lit(4.0) * a + F.lit(2.0)
    return F.when(a <= 1, near).when(a < 2, far).otherwise(F.lit(0.0))


def rotate(px: DataFrame, angle: float, expand: bool = True, fill: tuple[int, int, int] = (0, 0, 0), channels: list[str] | None = None) -> DataFrame:
    """Counter-clockwise by any angle, bicubic; ``expand`` grows the canvas. Pixels whose source lies outside take ``fill``."""
    names = channels or RGB
    turn = math.radians(angle)
    size = image_sizes(px).withColumn("cos", F.lit(round(math.cos(turn), 12))).withColumn("sin", F.lit(round(math.sin(turn), 12)))
    return rotated(px, turned_sides(size, F.lit(expand)).select("*", *[F.lit(v).alias(f"fill_{c}") for c, v in zip(names, fill)]), names)


def turned_sides(size: DataFrame, expand: Column) -> DataFrame:
    """``size(w, h, cos, sin, ...)`` with the sides ``nw`` and ``nh`` of the canvas after the turn."""
    side = lambda a, b: F.when(expand, F.ceil(F.round(F.col(a) * F.abs("cos") + F.col(b) * F.abs("sin"), 9)).cast("int")).otherwise(F.col(a))
    return size.withColumn("nw", side("w", "h")).withColumn("nh", side("h", "w"))


def rotated(px: DataFrame, size: DataFrame, names: list[str]) -> DataFrame:
    """Each image by its own turn ``size(image_id, w, h, nw, nh, cos, sin, fill_<name>...)``."""
    grid = size.select("*", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("oy")).select("*", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)).alias("ox"))
    dx, dy = F.col("ox") + F.lit(0.5) - F.col("nw") / 2.0, F.col("oy") + F.lit(0.5) - F.col("nh") / 2.0
    grid = grid.withColumn("sx", F.round(dx * F.col("cos") - dy * F.col("sin") + F.col("w") / 2.0 - F.lit(0.5), 9))
    grid = grid.withColumn("sy", F.round(dx * F.col("sin") + dy * F.col("cos") + F.col("h") / 2.0 - F.lit(0.5), 9))
    inside = F.col("sx").between(F.lit(-0.5), F.col("w") - F.lit(0.5)) & F.col("sy").between(F.lit(-0.5), F.col("h") - F.lit(0.5))
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-1, 3) for j in range(-1, 3)])
    each = grid.where(inside).select("*", F.inline(taps))
    tx, ty = F.floor("sx") + F.col("i"), F.floor("sy") + F.col("j")
    each = each.select(
        "image_id", "oy", "ox",
        (_cubic(F.col("sx") - tx) * _cubic(F.col("sy") - ty)).alias("weight"),
        F.least(F.greatest(ty, F.lit(0)), F.col("h") - 1).cast("int").alias("y"),
        F.least(F.greatest(tx, F.lit(0)), F.col("w") - 1).cast("int").alias("x"),
    )
    drawn = each.join(shuffled(px), ["image_id", "y", "x"]).groupBy("image_id", "oy", "ox").agg(*[channel(F.sum(F.col(c) * F.col("weight"))).alias(c) for c in names])
    bare = grid.where(~inside).select("image_id", "oy", "ox", *[F.col(f"fill_{c}").alias(c) for c in names])
    return drawn.union(bare).select("image_id", F.col("oy").alias("y"), F.col("ox").alias("x"), *names)


# The colours a watermark can have.
COLOURS = {"white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "blue": (0, 0, 255)}
GAP = 150


def watermark_overlay(px: DataFrame, mask: DataFrame, mask_width: int, mask_height: int, opacity: int = 80, angle: float = 45.0, color: str = "white", gap: int = GAP) -> DataFrame:
    """Tile ``mask(my, mx, kind)`` (kind 1: glyph, 2: its outline) over a square on the image's diagonal, every second row
    shifted by half a tile; turn it by ``angle``, cut the centre and composite it at ``opacity``.

    The mask is a glyph picture, as small as its text; the overlay is looked up by modulo coordinates, so no canvas is
    built. The turn is bicubic: a pixel's 16 taps into the mask are summed, premultiplied, where the pixel is, so that edges are covered
    in part and one row per pixel is shuffled.
    """
    tw, th = mask_width + gap, mask_height + gap
    fill = COLOURS.get(color.lower(), COLOURS["white"])
    line = (255, 255, 255) if color.lower() == "black" else (0, 0, 0)
    turn = math.radians(angle)
    cos, sin = round(math.cos(turn), 12), round(math.sin(turn), 12)
    sized = with_size(px)
    diag = F.floor(F.sqrt((F.col("w") * F.col("w") + F.col("h") * F.col("h")).cast("double"))).cast("int")
    sized = sized.withColumn("d", diag)
    dx = F.col("x") + F.floor((F.col("d") - F.col("w")) / 2) + F.lit(0.5) - F.col("d") / 2.0
    dy = F.col("y") + F.floor((F.col("d") - F.col("h")) / 2) + F.lit(0.5) - F.col("d") / 2.0
    half = F.col("d") / 2.0 - F.lit(0.5)
    placed = sized.withColumn("u", F.round(dx * F.lit(cos) - dy * F.lit(sin) + half, 9)).withColumn("v", F.round(dx * F.lit(sin) + dy * F.lit(cos) + half, 9))
    on = F.col("u").between(F.lit(-0.5), F.col("d") - F.lit(0.5)) & F.col("v").between(F.lit(-0.5), F.col("d") - F.lit(0.5))
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-1, 3) for j in range(-1, 3)])
    each = placed.select(*PX, "u", "v", "d", F.explode(F.when(on, taps).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"))))).alias("tap"))
    tu, tv = F.floor("u") + F.col("tap.i"), F.floor("v") + F.col("tap.j")
    held = lambda t: F.least(F.greatest(t, F.lit(0)), F.col("d") - 1)
    each = each.withColumn("weight", _cubic(F.col("u") - tu) * _cubic(F.col("v") - tv)).withColumn("tu", F.when(tu.isNotNull(), held(tu))).withColumn("tv", F.when(tv.isNotNull(), held(tv)))
    shift = F.pmod(F.floor(F.col("tv") / th), F.lit(2)) * (tw // 2)
    each = each.withColumn("my", F.pmod("tv", F.lit(th)).cast("int")).withColumn("mx", F.pmod(F.col("tu") - shift, F.lit(tw)).cast("int"))
    cover = lambda kind, name: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("weight"))), F.lit(0.0)).alias(name)
    marked = each.join(F.broadcast(mask), ["my", "mx"], "left").groupBy("image_id", "y", "x").agg(*[F.first(c).alias(c) for c in RGB], cover(1, "glyph"), cover(2, "outline"))
    share = F.lit(opacity / 255.0)

    def over(k: int) -> Column:
        whole = F.least(F.greatest(F.col("glyph") + F.col("outline"), F.lit(0.0)), F.lit(1.0))
        ink = F.least(F.greatest(F.col("glyph") * F.lit(fill[k]) + F.col("outline") * F.lit(line[k]), F.lit(0.0)), whole * F.lit(255.0))
        return channel(F.col(RGB[k]) * (F.lit(1.0) - whole * share) + ink * share).alias(RGB[k])

    return marked.select("image_id", "y", "x", *[over(k) for k in range(3)])

"""Every image through its own list of steps, in one plan whatever the number of different lists.

Steps are rows of a table. Those that look at one pixel become numbers (a matrix, an offset, a share) that are folded over
each pixel; turns are composed per image before a pixel is touched. What needs neighbours or another grid runs once for each kind of step
in a round, with each image's own numbers as columns. After a round its pixels are written, so that later rounds read them once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.pixels import PX, RGB, channel, image_sizes, shuffled
from tesselon.operators import raster_resample as resample
from tesselon.operators import raster_window as window
from tesselon.plans.pipeline import NO_PIXELS, Glyphs
from tesselon.sources.files import scratch

STEPS = "array<struct<name:string,params:map<string,string>>>"
POINT = ("grayscale", "sepia", "color_tint", "posterize")
LIGHT = ("brightness", "contrast", "brightness_contrast")
KINDS = ("crop", "rotate", "resize", "thumbnail", "pixelate", "blur", "sharpen", "edges", "contrast", "watermark_text")
TURNS = {90: 4, 180: 5, 270: 6}
# Rows of the luma and the sepia matrix.
LUMA = (0.299, 0.587, 0.114)
SEPIA = (0.393, 0.769, 0.189, 0.349, 0.686, 0.168, 0.272, 0.534, 0.131)


def _numbers(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def _fill(text: Column) -> Column:
    """A colour's three numbers, as `pipeline.colour` reads it."""
    low = F.lower(F.trim(text))
    named = [F.when(low == name, _numbers(*rgb)) for name, rgb in resample.COLOURS.items()]
    hexed = _numbers(*[F.conv(F.substring(low, k, 2), 16, 10).cast("double") for k in (2, 4, 6)])
    parts = F.transform(F.split(F.regexp_replace(low, "[() ]", ""), ","), lambda v: F.least(v.cast("double"), F.lit(255.0)))
    told = F.when(low.isNull() | (low == ""), _numbers(0, 0, 0)).when(low.rlike("^#[0-9a-f]{6}$"), hexed)
    told = told.when(low.rlike(r"^\(* *\d+ *, *\d+ *, *\d+ *\)*$"), parts)
    return F.coalesce(*named, told, F.raise_error(F.concat(F.lit("unknown colour: "), text)).cast("array<double>"))


def _read(step: Column) -> Column:
    """A step as one or two structs ``(kind, m, k, cut, share, q, turn, p)`` of numbers; a ``kind`` among KINDS is for a round of its own."""
    name = F.lower(step["name"])
    said = lambda key: F.nullif(F.element_at(step["params"], F.lit(key)), F.lit(""))
    n = lambda key, default: F.coalesce(said(key).cast("double"), F.lit(float(default)))
    whole = lambda key, default: F.coalesce(said(key).cast("int").cast("double"), F.lit(float(default)))
    zeros, same = _numbers(*[0] * 9), _numbers(1, 0, 0, 0, 1, 0, 0, 0, 1)

    def made(kind, m=same, k=_numbers(0, 0, 0), cut=False, share=1.0, q=1, turn=0, p=None):
        as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            as_column(kind).alias("kind"), m.alias("m"), k.alias("k"), F.lit(cut).alias("cut"), as_column(share).cast("double").alias("share"),
            as_column(q).cast("int").alias("q"), as_column(turn).cast("int").alias("turn"), (p if p is not None else F.array().cast("array<double>")).alias("p"),
        )

    angle = F.pmod(n("angle", 0), F.lit(360.0))
    grows = F.lower(F.coalesce(said("expand"), F.lit("true"))) == "true"
    square = (angle % 90 == 0) & (grows | (angle == 180) | (angle == 0))
    quarter = reduce(lambda c, a: c.when(angle == a, TURNS[a]), TURNS, F.when(angle == 0, 0)).otherwise(0)
    way = F.lower(F.coalesce(said("direction"), F.lit("horizontal")))
    light, strong = n("brightness", 1), n("contrast", 1)
    bits = F.least(F.greatest(whole("bits", 4), F.lit(1.0)), F.lit(8.0))
    return (
        F.when(name == "grayscale", F.array(made("point", _numbers(*LUMA * 3), share=F.least(n("intensity", 1), F.lit(1.0)))))
        .when(name == "sepia", F.array(made("point", _numbers(*SEPIA), cut=True, share=n("intensity", 1))))
        .when(name == "color_tint", F.array(made("point", zeros, _numbers(*[whole(c, 255) for c in RGB]), share=n("intensity", 0.3))))
        .when(name == "posterize", F.array(made("point", q=F.pow(F.lit(2.0), F.lit(8.0) - bits))))
        .when(name == "flip", F.array(made("turn", turn=F.when(way == "vertical", 2).when(way == "both", 3).otherwise(1))))
        .when(name.isin(*LIGHT), F.array(made("point", _numbers(light, 0, 0, 0, light, 0, 0, 0, light)), made(F.when(strong == 1, "none").otherwise("contrast"), p=_numbers(strong))))
        .when(name == "rotate", F.array(made(F.when(square, "turn").otherwise("rotate"), turn=F.when(square, quarter).otherwise(0), p=F.concat(_numbers(angle, F.when(grows, 1.0).otherwise(0.0)), F.when(square, F.array().cast("array<double>")).otherwise(_fill(said("fill_color")))))))
        .when(name == "crop", F.array(made("crop", p=_numbers(*[said(k).cast("double") for k in ("left", "upper", "right", "lower")]))))
        .when(name == "resize", F.array(made("resize", p=_numbers(whole("width", 0), whole("height", 0), n("scale", 0)))))
        .when(name == "thumbnail", F.array(made("thumbnail", p=_numbers(whole("width", 256), whole("height", 256)))))
        .when(name == "pixelate", F.array(made("pixelate", p=_numbers(whole("block_size", 10)))))
        .when(name == "blur", F.array(made(F.when(n("radius", 2) <= 0, "none").otherwise("blur"), p=_numbers(n("radius", 2)))))
        .when(name == "sharpen", F.array(made("sharpen", p=_numbers(n("factor", 2)))))
        .when(name == "edges", F.array(made("edges")))
        .when(name == "watermark_text", F.array(made("watermark_text")))
        .otherwise(F.array(made("none")))
    )


def _turned(image: DataFrame) -> DataFrame:
    """Adds ``to``: where a pixel goes by all turns of ``now``, as ``x' = xx x + xy y + x0`` and so on, with the sides ``w`` and ``h`` after them."""
    kind = "struct<xx:int,xy:int,x0:int,yx:int,yy:int,y0:int,w:int,h:int>"
    start = F.struct(*[v.alias(n) for n, v in zip(("xx", "xy", "x0", "yx", "yy", "y0", "w", "h"), (F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(1), F.lit(0), F.col("w"), F.col("h")))]).cast(kind)

    def step(t, s):
        x, y = (t["xx"], t["xy"], t["x0"]), (t["yx"], t["yy"], t["y0"])
        mirrored = lambda v, side: (-v[0], -v[1], side - 1 - v[2])
        x_back, y_back = mirrored(x, t["w"]), mirrored(y, t["h"])
        # By number: mirrored, upside down, both; turned by 90, 180 and 270 degrees.
        ways = {1: (x_back, y, 0), 2: (x, y_back, 0), 3: (x_back, y_back, 0), 4: (y, x_back, 1), 5: (x_back, y_back, 0), 6: (y_back, x, 1)}
        out = F.when(s["turn"] == 0, t)
        for number, (to_x, to_y, swapped) in ways.items():
            sides = (t["h"], t["w"]) if swapped else (t["w"], t["h"])
            out = out.when(s["turn"] == number, F.struct(*to_x, *to_y, *sides).cast(kind))
        return out

    return image.withColumn("to", F.aggregate("now", start, step))


def _pixel(now: Column) -> Column:
    """The point steps of ``now`` folded over one pixel, rounded after each step as the single operators do."""
    kind = "struct<r:int,g:int,b:int>"

    def step(v, s):
        def one(i: int) -> Column:
            c = v[RGB[i]]
            mixed = v["r"] * s["m"][3 * i] + v["g"] * s["m"][3 * i + 1] + v["b"] * s["m"][3 * i + 2] + s["k"][i]
            full = F.when(s["cut"], F.least(mixed.cast("int"), F.lit(255))).otherwise(channel(mixed))
            shared = F.when(s["share"] == 1, full).otherwise(channel(c * (F.lit(1.0) - s["share"]) + full * s["share"]))
            return F.when(s["q"] > 1, c - c % s["q"]).otherwise(shared).cast("int").alias(RGB[i])

        return F.when(s["kind"] == "point", F.struct(*[one(i) for i in range(3)]).cast(kind)).otherwise(v)

    return F.aggregate(now, F.struct(*[F.col(c).cast("int").alias(c) for c in RGB]).cast(kind), step)


def _lightly(px: DataFrame, image: DataFrame) -> DataFrame:
    """Point steps and turns of ``image(image_id, now, to, kind, p)``; keeps the image's next ``kind``, ``p`` and sides."""
    joined = px.select(*PX).join(shuffled(image), "image_id")
    moved = lambda a: (F.col(f"to.{a}x") * F.col("x") + F.col(f"to.{a}y") * F.col("y") + F.col(f"to.{a}0")).cast("int")
    points = F.filter("now", lambda s: s["kind"] == "point")
    drawn = joined.withColumn("c", _pixel(points))
    return drawn.select("image_id", moved("y").alias("y"), moved("x").alias("x"), *[F.col(f"c.{c}").alias(c) for c in RGB], "kind", "p", F.col("to.w").alias("w"), F.col("to.h").alias("h"))


def _p(k: int) -> Column:
    return F.get("p", F.lit(k))  # null where a row of another kind is looked at


def _cropped(px: DataFrame, images: DataFrame) -> DataFrame:
    box = images.select("image_id", "w", "h", *[F.rint(_p(k)).cast("int").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])
    inside = px.select(*PX).join(shuffled(box), "image_id").where("x >= x0 and x < x1 and y >= y0 and y < y1")
    moved = inside.select("image_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *RGB)
    outside = box.where("(x0 < 0 or y0 < 0 or w < x1 or h < y1) and x1 > x0 and y1 > y0")
    grid = outside.select("*", F.explode(F.sequence(F.lit(0), F.expr("y1 - y0 - 1"))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.expr("x1 - x0 - 1"))).alias("x"))
    blank = grid.where("not (x + x0 between 0 and w - 1) or not (y + y0 between 0 and h - 1)")
    return moved.union(blank.select("image_id", "y", "x", *[F.lit(0).alias(c) for c in RGB]))


def _by_kind(kind: str, px: DataFrame, images: DataFrame, glyphs: Glyphs | None, specs: DataFrame, number: int) -> DataFrame:
    """The pixels of ``images(image_id, w, h, p)`` after their step of one ``kind``, each with its own numbers ``p``."""
    if kind == "crop":
        return _cropped(px, images)
    if kind == "rotate":
        turn = images.withColumn("cos", F.round(F.cos(F.radians(_p(0))), 12)).withColumn("sin", F.round(F.sin(F.radians(_p(0))), 12))
        return resample.rotated(px.select(*PX), resample.turned_sides(turn, _p(1) == 1).select("image_id", "w", "h", "nw", "nh", "cos", "sin", *[_p(k + 2).cast("int").alias(f"fill_{c}") for k, c in enumerate(RGB)]), RGB)
    if kind == "resize":
        side = lambda k, c: F.when(_p(2) > 0, (F.col(c) * _p(2)).cast("int")).when(_p(k) > 0, _p(k).cast("int")).otherwise(F.col(c))
        return resample.resized_where_needed(px.select(*PX), images.select("image_id", "w", "h", side(0, "w").alias("nw"), side(1, "h").alias("nh")))
    if kind == "thumbnail":
        return resample.resized_where_needed(px.select(*PX), resample.fitted_sides(images, _p(0), _p(1)).select("image_id", "w", "h", "nw", "nh"))
    if kind == "pixelate":
        return resample.from_cells(px, F.greatest(_p(0), F.lit(1.0)))
    if kind == "blur":
        return resample.blurred(px.select(*PX), images.select("image_id", "w", "h", _p(0).alias("radius")))
    if kind == "sharpen":
        return window.sharpened(px, _p(0))
    if kind == "contrast":
        return window.contrasted(px, _p(0))
    if kind == "edges":
        return window.edges(px)
    if glyphs is None:
        raise ValueError("watermark_text asks for glyphs")
    # Masks are the caller's, so each different text and style is one branch.
    own = specs.join(images.select("image_id"), "image_id", "left_semi").select("image_id", F.get(F.filter("steps", lambda s: F.lower(s["name"]) == "watermark_text"), F.lit(number - 1))["params"].alias("q"))
    keys = {"text": "", "size": "60", "opacity": "80", "angle": "45", "color": None, "fill": "white"}
    told = own.select("image_id", *[F.coalesce(F.nullif(F.element_at("q", F.lit(k)), F.lit("")), F.lit(v)).alias(k) for k, v in keys.items()])
    told = told.select("image_id", "text", "size", "opacity", "angle", F.coalesce("color", "fill").alias("color"))
    parts = []
    for r in told.drop("image_id").distinct().collect():
        mask, wide, high = glyphs(r["text"], int(float(r["size"])))
        mine = px.join(shuffled(told.where(reduce(lambda a, c: a & (F.col(c) == F.lit(r[c])), ("text", "size", "opacity", "angle", "color"), F.lit(True))).select("image_id")), "image_id", "left_semi")
        parts.append(resample.watermark_overlay(mine.select(*PX), mask, wide, high, int(float(r["opacity"])), float(r["angle"]), r["color"]))
    return reduce(DataFrame.unionByName, parts)


def apply_specs(px: DataFrame, specs: DataFrame, glyphs: Glyphs | None = None) -> DataFrame:
    """``px`` after each image's own ``specs(image_id, steps)``, steps of type STEPS, with the results of `pipeline.apply_pipeline`.

    Images without a row in ``specs``, with null or with no steps come through unchanged; specs of images without pixels say
    nothing; of several rows of one image the one with the most steps counts (then the greatest). Unknown names raise.
    A step that leaves neighbours alone costs no round; the number of rounds is the most that one image has of the others.
    """
    known = POINT + LIGHT + KINDS + ("flip",) + NO_PIXELS
    odd = specs.select(F.explode("steps").alias("s")).where(~F.lower(F.col("s.name")).isin(*known) | F.col("s.name").isNull()).select("s.name").first()
    if odd is not None:
        raise ValueError(f"unknown transform: {odd['name']}")
    rank = F.struct(F.size("steps"), F.to_json("steps"), "steps")
    once = specs.where("steps is not null").groupBy("image_id").agg(F.max_by("steps", rank.dropFields("steps")).alias("steps"))
    read = once.select("image_id", F.flatten(F.transform("steps", _read)).alias("done"))
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.size("done"), F.lit(1))), lambda i: F.coalesce(F.get("done", i - 1)["kind"].isin(*KINDS), F.lit(False)))
    path = scratch(px.sparkSession, "specs")
    read.withColumn("spots", spots).write.parquet(path)
    table = px.sparkSession.read.parquet(path)
    rounds = table.agg(F.max(F.size("spots"))).first()[0] or 0
    marks = F.filter("done", lambda s: s["kind"].isin(*KINDS))

    def cut(k: int) -> DataFrame:
        """What each image does before its step of round ``k``, and that step; images that have none of it any more are left out after the first round."""
        since = F.lit(1) if k == 0 else F.get("spots", F.lit(k - 1)) + 1
        upto = F.coalesce(F.get("spots", F.lit(k)), F.size("done") + 1)
        now = F.slice("done", since, F.greatest(upto - since, F.lit(0)))
        return table.where(F.size("spots") >= k).select("image_id", now.alias("now"), F.get(marks, F.lit(k))["kind"].alias("kind"), F.get(marks, F.lit(k))["p"].alias("p"), F.size(F.filter(F.slice(marks, 1, k + 1), lambda s: s["kind"] == "watermark_text")).alias("masks"))

    now, finished = px.select(*PX), [px.select(*PX).join(shuffled(table.select("image_id")), "image_id", "left_anti")]
    for k in range(rounds + 1):
        image = _turned(cut(k).join(image_sizes(now), "image_id"))
        drawn = _lightly(now, image.drop("w", "h"))
        if k == rounds:
            finished.append(drawn.select(*PX))
            break
        # Written, since each kind of step reads it: a round's plan must not hold those of all rounds before.
        path = scratch(px.sparkSession, f"round{k}")
        drawn.write.partitionBy("kind").parquet(path)
        drawn = px.sparkSession.read.schema(drawn.schema).parquet(path)
        finished.append(drawn.where("kind is null").select(*PX))
        images = image.select("image_id", "kind", "p", "masks", F.col("to.w").alias("w"), F.col("to.h").alias("h"))
        parts = []
        for row in image.where("kind is not null").groupBy("kind").agg(F.collect_set("masks").alias("masks")).orderBy("kind").collect():
            kind = row["kind"]
            # Texts are looked up by how many an image has had before; other steps carry their numbers.
            for number in sorted(row["masks"]) if kind == "watermark_text" else [0]:
                mine = images.where((F.col("kind") == kind) & ((F.col("masks") == number) if kind == "watermark_text" else F.lit(True)))
                own = drawn.where(F.col("kind") == kind)
                own = own.join(shuffled(mine.select("image_id")), "image_id", "left_semi") if kind == "watermark_text" else own
                parts.append(_by_kind(kind, own, mine, glyphs, once, number).select(*PX))
        path = scratch(px.sparkSession, f"after{k}")
        reduce(DataFrame.unionByName, parts).write.parquet(path)
        now = px.sparkSession.read.schema(px.select(*PX).schema).parquet(path)
    return reduce(DataFrame.unionByName, finished)

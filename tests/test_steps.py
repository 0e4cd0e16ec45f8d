"""Images with steps of their own, in one plan, against one pipeline at a time."""

import pytest
from pyspark.sql import functions as F

from tesselon.plans.pipeline import apply_pipeline, apply_pipelines
from tesselon.plans.steps import STEPS, apply_specs


@pytest.fixture(scope="module")
def small(spark):
    """Six images of unlike sides."""
    sides = [(k, 5 + k, 9 - k) for k in range(6)]
    df = spark.createDataFrame(sides, "image_id long, w int, h int")
    grid = df.select("image_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "w").select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    value = lambda a, b, c: ((F.col("x") * a + F.col("y") * b + F.col("image_id") * c) % 256).cast("int")
    return grid.select("image_id", "y", "x", value(31, 17, 5).alias("r"), value(7, 91, 3).alias("g"), value(53, 11, 29).alias("b"))


def glyphs(spark):
    return lambda text, size: (spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 2)], "my int, mx int, kind int"), 2 + len(text), 2)


LISTS = [
    [("grayscale", {"intensity": "0.4"}), ("sepia", {}), ("flip", {}), ("rotate", {"angle": "90"}), ("posterize", {"bits": "3"})],
    [("sepia", {"intensity": "0.7"}), ("blur", {"radius": "1.3"}), ("flip", {"direction": "vertical"}), ("crop", {"left": "1", "upper": "-2", "right": "9", "lower": "4"}), ("color_tint", {"r": "200", "g": "10", "b": "60"})],
    [("resize", {"width": "4"}), ("rotate", {"angle": "-90"}), ("resize", {"scale": "1.5"}), ("sharpen", {"factor": "1.7"}), ("ocr", {})],
    [("rotate", {"angle": "30", "fill_color": "#0a0b0c"}), ("brightness", {"brightness": "1.2", "contrast": "0.8"}), ("pixelate", {"block_size": "3"}), ("blur", {"radius": "0.7"})],
    [("watermark_text", {"text": "a"}), ("rotate", {"angle": "180"}), ("watermark_text", {"text": "bc", "opacity": "120", "color": "red"}), ("edges", {}), ("rotate", {"angle": "45", "expand": "false", "fill": ""})],
    [("thumbnail", {"width": "6", "height": "5"}), ("contrast", {"contrast": "1.5"}), ("grayscale", {}), ("flip", {"direction": "both"}), ("rotate", {"angle": "270"}), ("sharpen", {})],
]


def test_each_image_as_by_its_own_pipeline(spark, small):
    specs = spark.createDataFrame([(k, steps) for k, steps in enumerate(LISTS)], f"image_id long, steps {STEPS}")
    got = {}
    for r in apply_specs(small, specs, glyphs(spark)).collect():
        assert got.setdefault(r["image_id"], {}).setdefault((r["y"], r["x"]), tuple(r)[3:]) == tuple(r)[3:]
    for k, steps in enumerate(LISTS):
        want = {(r["y"], r["x"]): tuple(r)[3:] for r in apply_pipeline(small.where(F.col("image_id") == k), steps, glyphs(spark)).collect()}
        assert got[k] == want, steps


def test_images_without_known_steps_stay(spark, small):
    specs = spark.createDataFrame([(0, "a"), (1, "unknown"), (3, None), (99, "a")], "image_id long, signature string")
    out = apply_pipelines(small, specs, {"a": [("brightness", {"brightness": "0.5"})]})
    assert out.where("image_id = 0").exceptAll(small.where("image_id = 0")).count() > 0
    kept = small.where("image_id > 0")
    assert out.where("image_id > 0").exceptAll(kept).count() == kept.exceptAll(out).count() == 0
    assert out.count() == small.count()
    none = spark.createDataFrame([(0, None), (1, [])], f"image_id long, steps {STEPS}")
    same = apply_specs(small, none)
    assert same.exceptAll(small).count() == small.exceptAll(same).count() == 0
    assert apply_specs(small.limit(0), none).count() == 0


def test_plan_does_not_grow_with_signatures(spark, small):
    def plan(n):
        rows = [(k % 6, [("brightness", {"brightness": str(1 + k / 999)}), ("flip", {}), ("sharpen", {"factor": str(1 + k / 500)})]) for k in range(n)]
        return apply_specs(small, spark.createDataFrame(rows, f"image_id long, steps {STEPS}"))._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(1000) == plan(6)


def test_unknown_steps_are_refused(spark, small):
    with pytest.raises(ValueError, match="swirl"):
        apply_specs(small, spark.createDataFrame([(0, [("swirl", {})])], f"image_id long, steps {STEPS}"))

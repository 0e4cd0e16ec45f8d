"""Cost of tasks, scores and backlog order, as column expressions over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselon.operators.ordered import free, ranked
from tesselon.operators.requests import literal_map

MIB = 1024 * 1024

# Base weight of each operation, multiplier of each output format, names that share a weight.
WEIGHTS = {
    "grayscale": 0.35, "resize": 0.95, "crop": 0.25, "rotate": 0.65, "flip": 0.20, "blur": 1.30, "sharpen": 1.00, "brightness_contrast": 0.60,
    "watermark_text": 1.10, "format_conversion": 0.30, "ocr": 3.20, "inference": 3.80,
}
MULTIPLIERS = {"jpg": 1.0, "jpeg": 1.0, "png": 1.05, "webp": 1.25, "bmp": 0.85, "gif": 1.35, "ico": 1.20, "tif": 1.15, "tiff": 1.15}
SAME_WEIGHT = {"brightness": "brightness_contrast", "contrast": "brightness_contrast", "watermark": "watermark_text", "format": "format_conversion"}


def _numbers(pairs: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def transform_weight(steps: DataFrame) -> DataFrame:
    """Adds ``weight`` to ``steps(op, params, width, height, output_format)``: the operation's base times what its parameters make of it.

    The constants below are fixed values as well.
    """
    p = lambda k, d: F.coalesce(F.col("params")[k].cast("double"), d if isinstance(d, Column) else F.lit(float(d)))
    one = F.lit(1.0)
    w, h = F.greatest(F.col("width"), F.lit(1)).cast("double"), F.greatest(F.col("height"), F.lit(1)).cast("double")
    area = F.greatest(F.col("width").cast("double") * F.col("height"), one)
    grown = F.greatest(p("width", w), one) * F.greatest(p("height", h), one) / area
    resize = F.when(grown >= 1, F.least(one + (grown - one) * 0.35, F.lit(2.2))).otherwise(F.greatest(F.lit(0.65), F.lit(0.9) - (one - grown) * 0.25))
    cut = F.greatest(p("right", w) - p("left", 0), one) * F.greatest(p("lower", h) - p("upper", 0), one) / area
    crop = F.greatest(F.lit(0.45), F.least(one, cut + 0.15))
    angle, expand = F.abs(p("angle", 0)) % 360, F.lower(F.coalesce(F.col("params")["expand"], F.lit("true"))) == "true"
    quadrant = F.when(angle == 180, 0.70).otherwise(0.85) + F.when(expand, 0.0).otherwise(0.10)
    flip = F.when(F.lower(F.col("params")["direction"]) == "both", 1.15).otherwise(1.0)
    blur = F.least(F.lit(0.85) + F.greatest(p("radius", 1.5), F.lit(0.0)) * 0.22, F.lit(2.0))
    sharpen = F.least(F.lit(0.9) + F.abs(F.greatest(p("factor", 2.0), F.lit(0.0)) - one) * 0.35, F.lit(1.9))
    off = F.greatest(F.abs(F.greatest(p("brightness", 1.0), F.lit(0.0)) - one), F.abs(F.greatest(p("contrast", 1.0), F.lit(0.0)) - one))
    light = F.least(F.lit(0.9) + off * 0.4, F.lit(1.8))
    text = F.coalesce(F.length(F.col("params")["text"]), F.lit(0))
    mark = F.least(F.lit(0.9) + text / F.lit(80.0) + F.greatest(p("size", 36).cast("int"), F.lit(1)) / F.lit(180.0), F.lit(1.9))
    convert = F.coalesce(F.element_at(_numbers(MULTIPLIERS), F.lower(F.coalesce("output_format", F.lit("png")))), F.lit(1.1))
    op = F.col("op")
    factor = (
        F.when(op == "resize", resize).when(op == "crop", crop).when((op == "rotate") & angle.isin(90.0, 180.0, 270.0), quadrant).when(op == "rotate", F.lit(1.30))
        .when(op == "flip", flip).when(op == "blur", blur).when(op == "sharpen", sharpen).when(op == "brightness_contrast", light)
        .when(op == "watermark_text", mark).when(op == "format_conversion", convert).otherwise(one)
    )
    base = F.coalesce(F.element_at(_numbers(WEIGHTS), op), one)
    return steps.withColumn("weight", F.when((op == "rotate") & (angle < 1e-9), F.lit(0.05)).otherwise(base * factor))


def queue_cost_hints(names: Column, formats: Column) -> tuple[Column, Column]:
    """Hints by filter name and by output format, rounded to three digits; null for unknown ones."""
    name = F.coalesce(F.element_at(literal_map(SAME_WEIGHT), names), names)
    return F.element_at(_numbers(WEIGHTS), name), F.round(F.element_at(_numbers(MULTIPLIERS), formats) * WEIGHTS["format_conversion"], 3)


def heuristic_ms(weights: Column) -> Column:
    """Service time from the sum of weights (null or zero: one half) and the columns ``width``, ``height``, ``size_bytes``. Its constants are fixed values."""
    mp = F.greatest(F.greatest("width", F.lit(1)).cast("double") * F.greatest("height", F.lit(1)) / 1e6, F.col("size_bytes") / F.lit(6.0 * MIB), F.lit(0.2))
    return F.lit(40.0) + mp * 70.0 * F.coalesce(F.nullif(weights, F.lit(0.0)), F.lit(0.5))


def task_signature(ops: Column) -> Column:
    """Operations in order, half-megapixel bucket, mebibyte bucket."""
    pixels = F.greatest(F.col("width").cast("bigint") * F.col("height"), F.lit(1))
    return F.concat_ws(":", F.array_join(ops, "-"), F.floor(pixels / 500000).cast("string"), F.floor(F.greatest("size_bytes", F.lit(1)) / MIB).cast("string"))


def ema_service_ms(log: DataFrame, alpha: float = 0.35) -> DataFrame:
    """``(signature, ema_ms, n)`` from ``log(signature, ts, event_id, latency_ms)``: the moving average in the order of time.

    An observation ``k`` places back weighs (1 - alpha)^k. Only as many as weigh more than 2^-60 enter the fold, a number that
    follows from ``alpha``, so a signature that holds most of the log is as cheap as any other.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha has to lie between 0 and 1")
    keep = 1 if alpha == 1 else math.ceil(-60 * math.log(2) / math.log1p(-alpha)) + 1
    recent = log.withColumn("n", F.row_number().over(W.partitionBy("signature").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("n") <= keep)
    folded = recent.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "latency_ms"))).alias("seen"))
    step = lambda a, x: F.when(a > 0, F.lit(1.0 - alpha) * a + F.lit(alpha) * x["latency_ms"]).otherwise(x["latency_ms"])
    counts = log.groupBy("signature").agg(F.count("*").alias("n"))
    return folded.select("signature", F.round(F.aggregate("seen", F.lit(0.0), step), 6).alias("ema_ms")).join(counts, "signature")


def estimate_service(tasks: DataFrame, learned: DataFrame) -> DataFrame:
    """Adds ``service_ms`` (learned average if there is one, else ``heuristic``) and ``cost`` in seconds."""
    joined = tasks.join(learned.select("signature", "ema_ms"), "signature", "left")
    ms = F.when(F.col("ema_ms") > 0, F.col("ema_ms")).otherwise(F.col("heuristic"))
    return joined.withColumn("service_ms", ms).withColumn("cost", F.col("service_ms") / 1000.0).drop("ema_ms")


def resource_need(service_ms: Column) -> tuple[Column, Column, Column]:
    """Memory bytes, processor units, input/output units."""
    size = F.greatest(F.col("size_bytes").cast("bigint"), F.col("width").cast("bigint") * F.col("height") * 3)
    memory = F.greatest((size * 2.5).cast("bigint"), F.lit(32 * MIB))
    return memory, F.least(F.greatest(service_ms / 250.0, F.lit(0.25)), F.lit(2.0)), F.least(F.greatest(size / F.lit(32.0 * MIB), F.lit(0.1)), F.lit(1.0))


def _unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def seconds_between(a: Column, b: Column) -> Column:
    """From ``b`` to ``a`` in seconds."""
    return F.timestamp_diff("MICROSECOND", b, a) / F.lit(1e6)


def score_tasks(tasks: DataFrame, as_of: Column, deadline_s: float, aging_s: float, cost_ms: float = 1500.0, large_bytes: int = 32 * MIB) -> DataFrame:
    """Adds ``score``: weighted priority, urgency and age, less cost, retries and size; ``tasks`` has ``service_ms``. The weights are fixed values."""
    left = seconds_between(F.col("deadline"), as_of)
    urgency = F.when(F.col("deadline").isNull(), 0.15).when(left <= 0, 1.0).otherwise(_unit(F.lit(1.0) - left / deadline_s))
    age = _unit(F.greatest(seconds_between(as_of, F.col("created_at")), F.lit(0.0)) / max(aging_s, 0.1))
    cost = _unit(F.col("service_ms") / max(cost_ms, 1.0))
    retries = _unit(F.col("attempt") / F.greatest(F.col("max_retries"), F.lit(1)))
    size = _unit(F.col("size_bytes") / F.lit(float(large_bytes)))
    score = _unit(F.col("priority") / 10.0) * 0.35 + urgency * 0.25 + age * 0.20 - cost * 0.10 - retries * 0.05 - size * 0.05
    return tasks.withColumn("score", F.round(score, 6))


def rank_backlog(tasks: DataFrame, by: str = "node_id") -> DataFrame:
    """Adds ``rank`` within ``by``: best score first, then the earliest deadline (none last), then the smallest id.

    Tasks are dealt out by ranges of this order, so one node with most tasks is spread, even if they all have one score.
    """
    return ranked(tasks, by, [F.desc_nulls_last("score"), F.asc_nulls_last("deadline"), F.col("task_id")], "rank")


def next_ready(tasks: DataFrame, as_of: Column, k: int) -> DataFrame:
    """The best ``k`` tasks that are eligible at ``as_of``, with ``next_wait_s``: the shortest wait among the others."""
    wait = tasks.where(F.col("next_eligible") > as_of).agg(F.min(seconds_between(F.col("next_eligible"), as_of)).alias("next_wait_s"))
    best = tasks.where(F.col("next_eligible") <= as_of).orderBy(F.desc("score"), F.asc_nulls_last("deadline"), "task_id").limit(k)
    return best.join(F.broadcast(wait))  # one row


def backlog_by_priority(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("priority").agg(F.count("*").alias("tasks"))


def admission_split(tasks: DataFrame, nodes: DataFrame, watermark: int, large_bytes: int = 32 * MIB, min_free: int = 256 * MIB) -> DataFrame:
    """Adds ``reason`` to tasks in arrival order per node: not accepting, backlog at the watermark, or a large image with
    little memory; null where admitted. ``nodes(node_id, accepting, free_bytes)``.

    Only the first ``watermark`` tasks of a node are ordered; the last of them tells for every other task whether it came later.
    """
    arrival, cut = F.struct("created_at", "task_id"), free(tasks, "cut")
    nth = F.row_number().over(W.partitionBy("node_id").orderBy("created_at", "task_id"))
    few = tasks.select("node_id", "created_at", "task_id").withColumn("nth", nth).where(F.col("nth") <= watermark)
    last = few.where(F.col("nth") == watermark).select("node_id", arrival.alias(cut))
    joined = tasks.join(nodes.join(last, "node_id", "left"), "node_id")
    reason = (
        F.when(~F.col("accepting"), "not accepting")
        .when((arrival > F.col(cut)) if watermark > 0 else F.lit(True), "backlog at watermark")
        .when((F.col("size_bytes") >= large_bytes) & (F.col("free_bytes") < 2 * min_free), "too little memory")
    )
    return joined.withColumn("reason", reason).drop(cut)

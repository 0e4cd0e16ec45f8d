"""Request preparation over whole tables: filter specs, limits, formats, fingerprints, uploads, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of filters and their aliases, and the operations they stand for.
ALIASES = {
    "gray": "grayscale", "brightness-contrast": "brightness_contrast", "watermark": "watermark_text", "convert": "format", "format_conversion": "format",
}
FILTERS = ("grayscale", "resize", "crop", "rotate", "flip", "blur", "sharpen", "brightness", "contrast", "brightness_contrast", "watermark_text", "ocr", "inference", "format")
OPERATIONS = {"brightness": "brightness_contrast", "contrast": "brightness_contrast", "format": "format_conversion"}
WATERMARK = (
    ("text", ""), ("x", "16"), ("y", "16"), ("fill", "white"), ("size", "36"), ("stroke_width", "2"), ("opacity", "96"), ("angle", "-28"), ("spacing_x", "220"), ("spacing_y", "160"),
)
SAVE_FORMATS = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "tif": "TIFF", "tiff": "TIFF", "webp": "WEBP", "bmp": "BMP", "gif": "GIF", "ico": "ICO"}
MAX_BYTES, MAX_FILTERS, MAX_SIDE, MAX_PIXELS, MAX_BATCH = 25 * 1024 * 1024, 12, 12000, 40_000_000, 16
INTERNAL_KEYS = ("node_id", "execution_isolation", "child_pid", "ocr_command", "inference_command", "adapter_timeout_seconds", "payload_bytes")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def canonical(key: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(ALIASES), key), key)


def normalize_filters(requests: DataFrame) -> DataFrame:
    """Adds ``ops``: ``(key, payload)`` per entry that is not blank, names trimmed, lower-cased and without aliases; and
    ``output_format``: the payload of the last format entry."""

    def spec(f: Column) -> Column:
        t = F.trim(f)
        name, rest = F.substring_index(t, ":", 1), F.when(F.instr(t, ":") > 0, F.substring(t, F.instr(t, ":") + 1, F.length(t))).otherwise("")
        return F.struct(canonical(F.lower(F.trim(name))).alias("key"), F.trim(rest).alias("payload"))

    ops = F.transform(F.filter("filters", lambda f: F.trim(f) != ""), spec)
    formats = F.filter("ops", lambda o: o["key"] == "format")
    return requests.withColumn("ops", ops).withColumn("output_format", F.when(F.size(formats) > 0, F.lower(F.element_at(formats, -1)["payload"])))


def _list(payload: Column) -> Column:
    return F.filter(F.transform(F.split(payload, ","), lambda s: F.trim(s)), lambda s: s != "")


def _params(key: Column, payload: Column) -> Column:
    either = lambda d: F.coalesce(F.nullif(payload, F.lit("")), F.lit(d))
    parts = _list(payload)
    pipes = F.transform(F.split(payload, r"\|"), lambda s: F.trim(s))
    cut = F.instr(payload, "x")
    mark = F.create_map(*[v for k, (name, d) in enumerate(WATERMARK) for v in (F.lit(name), F.coalesce(F.nullif(F.get(pipes, F.lit(k)), F.lit("")), F.lit(d)))])
    none = F.create_map().cast("map<string,string>")
    named = lambda *kv: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in kv])
    return (
        F.when(key == "resize", named("width", F.trim(F.substring(payload, F.lit(1), cut - 1)), "height", F.trim(F.substring(payload, cut + 1, F.length(payload)))))
        .when(key == "crop", named("left", F.get(parts, F.lit(0)), "upper", F.get(parts, F.lit(1)), "right", F.get(parts, F.lit(2)), "lower", F.get(parts, F.lit(3))))
        .when((key == "rotate") & payload.contains(","), named("angle", F.get(parts, F.lit(0)), "expand", F.lower(F.get(parts, F.lit(1)))))
        .when(key == "rotate", named("angle", either("0"), "expand", F.lit("true")))
        .when(key == "flip", named("direction", either("horizontal")))
        .when(key == "blur", named("radius", either("1.5")))
        .when(key == "sharpen", named("factor", either("2.0")))
        .when(key == "brightness", named("brightness", either("1.0"), "contrast", F.lit("1.0")))
        .when(key == "contrast", named("brightness", F.lit("1.0"), "contrast", either("1.0")))
        .when(key == "brightness_contrast", named("brightness", F.get(parts, F.lit(0)), "contrast", F.get(parts, F.lit(1))))
        .when(key == "watermark_text", mark)
        .otherwise(none)
    )


def _problem(key: Column, payload: Column) -> Column:
    n, cut = F.size(_list(payload)), F.instr(payload, "x")
    wrong = (
        ((key == "resize") & ((cut <= 1) | (cut == F.length(payload))))
        | ((key == "crop") & (n != 4))
        | ((key == "rotate") & payload.contains(",") & (n != 2))
        | ((key == "brightness_contrast") & (n != 2))
    )
    return F.when(~key.isin(*FILTERS), F.concat(F.lit("unsupported filter: "), key)).when(wrong, F.concat(F.lit("wrong arguments: "), key))


def filter_problems(requests: DataFrame) -> DataFrame:
    """Adds ``problems``: per entry what is wrong with it, null for nothing; takes what ``normalize_filters`` gives."""
    return requests.withColumn("problems", F.transform("ops", lambda o: _problem(o["key"], o["payload"])))


def _operation(key: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(OPERATIONS), key), key)


def filter_args(requests: DataFrame) -> DataFrame:
    """Adds ``steps``: ``(op, params, problem)`` per entry, with each operation's arguments and defaults; takes what ``normalize_filters`` gives."""

    def step(o: Column, problem: Column) -> Column:
        none = F.create_map().cast("map<string,string>")
        return F.struct(_operation(o["key"]).alias("op"), F.when(problem.isNull(), _params(o["key"], o["payload"])).otherwise(none).alias("params"), problem.alias("problem"))

    return filter_problems(requests).withColumn("steps", F.zip_with("ops", "problems", step)).drop("problems")


def step_rows(requests: DataFrame, *keep: str) -> DataFrame:
    """One row per step of the requests without problems: ``(request_id, keep..., pos, op, params)``; takes what ``normalize_filters`` gives.

    Entries become rows before their arguments are taken apart, so that all of it is plain, compiled expressions.
    """
    good = filter_problems(requests).where(~F.exists("problems", lambda p: p.isNotNull()))
    each = good.select("request_id", *keep, F.posexplode("ops").alias("pos", "o"))
    return each.select("request_id", *keep, "pos", _operation(F.col("o.key")).alias("op"), _params(F.col("o.key"), F.col("o.payload")).alias("params"))


def params_text(params: Column) -> Column:
    """Parameters as ``key=value`` in the order of keys."""
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def reject_bad_filters(requests: DataFrame) -> DataFrame:
    """Adds ``reason``: the problem of the first bad filter, null for accepted requests. Filter on it for the two outputs. Takes what
    ``normalize_filters`` gives."""
    found = filter_problems(requests)
    return found.withColumn("reason", F.get(F.filter("problems", lambda p: p.isNotNull()), F.lit(0))).drop("problems")


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".\.([^./]+)$", 1))


def resolve_output_format(explicit: Column, detected: Column, file_name: Column) -> Column:
    """Explicit, else detected, else by suffix, else png."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(explicit), blank(detected), blank(suffix_of(file_name)), F.lit("png"))


def map_save_format(fmt: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(SAVE_FORMATS), F.lower(fmt)), F.upper(fmt))


def expand_pipeline(requests: DataFrame) -> DataFrame:
    """``(request_id, step, operation, params)`` from ``pipeline(type, params_json)``: a type may itself be JSON with a name and
    params, which ``params_json`` overrides; a target size fills what is missing."""
    each = requests.select("request_id", "target_width", "target_height", F.posexplode("pipeline").alias("pos", "item"))
    kind = F.trim("item.type")
    own = kind.startswith("{")
    as_map = lambda j: F.coalesce(F.from_json(j, "map<string,string>"), F.create_map().cast("map<string,string>"))
    each = each.withColumn("name", F.when(own, F.coalesce(F.get_json_object(kind, "$.name"), kind)).otherwise(kind))
    each = each.withColumn("inner", F.when(own, as_map(F.get_json_object(kind, "$.params"))).otherwise(F.create_map().cast("map<string,string>"))).withColumn("outer", as_map(F.col("item.params_json")))
    merged = F.map_concat(F.map_filter("inner", lambda k, v: ~F.map_contains_key(F.col("outer"), k)), "outer")
    each = each.withColumn("params", merged)
    for side in ("width", "height"):
        target = F.col(f"target_{side}")
        fill = F.create_map(F.lit(side), target.cast("string"))
        each = each.withColumn("params", F.when((target > 0) & ~F.map_contains_key("params", F.lit(side)), F.map_concat("params", fill)).otherwise(F.col("params")))
    return each.select("request_id", (F.col("pos") + 1).alias("step"), F.lower("name").alias("operation"), "params")


def expand_legacy_filters(requests: DataFrame) -> DataFrame:
    """``(request_id, step, operation, width, height)`` from a bracketed comma list in ``filter_type``."""
    names = F.filter(F.transform(F.split(F.regexp_replace("filter_type", r"^[\[\]]+|[\[\]]+$", ""), ","), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    each = requests.select("request_id", "target_width", "target_height", F.posexplode(names).alias("pos", "operation"))
    return each.select("request_id", (F.col("pos") + 1).alias("step"), "operation", F.col("target_width").alias("width"), F.col("target_height").alias("height"))


def map_filter_type(filter_type: Column, width: Column, height: Column) -> Column:
    """Filter entries of a comma list: thumbnail becomes a resize, and a target size adds one where there is none."""
    size = F.concat(F.lit("resize:"), width.cast("string"), F.lit("x"), height.cast("string"))
    parts = F.filter(F.transform(F.split(F.lower(F.trim(F.coalesce(filter_type, F.lit("")))), ","), lambda s: F.trim(s)), lambda p: p != "")
    named = F.transform(parts, lambda p: F.when(p == "thumbnail", size).otherwise(p))
    missing = (F.size(named) > 0) & ~F.exists(named, lambda f: f.startswith("resize")) & (width > 0)
    return F.when(missing, F.array_append(named, size)).otherwise(named)


def project_transforms(requests: DataFrame) -> DataFrame:
    """``(request_id, filter_type, target_width, target_height)``: the last resize, the last of grayscale, ocr and inference."""
    resizes = F.filter("steps", lambda s: (s["op"] == "resize") & s["problem"].isNull())
    kinds = F.filter("steps", lambda s: s["op"].isin("grayscale", "ocr", "inference"))
    side = lambda k: F.coalesce(F.get(resizes, F.size(resizes) - 1)["params"][k].cast("int"), F.lit(0))
    last = F.coalesce(F.get(kinds, F.size(kinds) - 1)["op"], F.lit("none"))
    return requests.select("request_id", last.alias("filter_type"), side("width").alias("target_width"), side("height").alias("target_height"))


def priority_in(wire: Column) -> Column:
    return F.when(wire > 0, 9).otherwise(5)


def priority_out(internal: Column) -> Column:
    return F.when(internal >= 8, 1).otherwise(0)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds ``reason``: the first limit that a request breaks, null for none. An image whose sides are not known could not be opened."""
    w, h, size = F.col("width"), F.col("height"), F.col("size_bytes")
    reason = (
        F.when(size.isNull() | (size <= 0), "empty payload")
        .when(size > MAX_BYTES, "payload too large")
        .when(F.size("filters") > MAX_FILTERS, "too many filters")
        .when(w.isNull() | h.isNull(), "invalid image")
        .when((w <= 0) | (h <= 0), "dimensions not positive")
        .when(w > MAX_SIDE, "width over limit")
        .when(h > MAX_SIDE, "height over limit")
        .when(w.cast("bigint") * h > MAX_PIXELS, "pixels over limit")
    )
    return requests.withColumn("reason", reason)


def limit_batches(requests: DataFrame, most: int = MAX_BATCH) -> DataFrame:
    """Adds ``batch_size`` and ``accepted``: batches with more than ``most`` requests go as a whole. Counted by partial
    aggregation and joined back, so a huge batch burdens no single task."""
    sizes = requests.groupBy("batch_id").agg(F.count("*").alias("batch_size"))
    return requests.join(sizes, "batch_id").withColumn("accepted", F.col("batch_size") <= most)


def assemble_uploads(chunks: DataFrame, most_bytes: int = MAX_BYTES) -> DataFrame:
    """``(upload_id, payload, n_bytes, file_name, reason)``: chunks joined in order, the last name given wins. Uploads that
    pass ``most_bytes`` are found before any chunk is gathered, so a group holds at most that much."""
    size = F.octet_length(F.coalesce("chunk", F.lit("")))
    totals = chunks.groupBy("upload_id").agg(F.sum(size).alias("n_bytes"), F.max_by("file_name", F.when(F.col("file_name") != "", F.col("seq"))).alias("named"))
    within = totals.where(F.col("n_bytes") <= most_bytes).select("upload_id")
    gathered = chunks.join(within, "upload_id", "left_semi").groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("chunk")))).alias("parts"))
    joined = totals.join(gathered, "upload_id", "left")
    reason = F.when(F.col("n_bytes") > most_bytes, "payload too large").when(F.col("n_bytes") == 0, "empty upload")
    name = F.coalesce(F.nullif("named", F.lit("")), F.concat(F.lit("upload-"), F.col("upload_id").cast("string"), F.lit(".png")))
    payload = F.array_join(F.transform("parts", lambda p: p["chunk"]), "")
    return joined.select("upload_id", payload.alias("payload"), "n_bytes", name.alias("file_name"), reason.alias("reason"))


def fingerprint(file_name: Column, filters: Column, data: Column) -> Column:
    """SHA-256 over name, filters (each ended by a zero byte) and the digest of the bytes, as hex."""
    zero = F.lit(b"\x00")
    listed = F.aggregate(filters, F.lit(b""), lambda acc, f: F.concat(acc, f.cast("binary"), zero))
    return F.sha2(F.concat(file_name.cast("binary"), zero, listed, F.unhex(F.sha2(data, 256))), 256)


def idempotency_key(prefix: str, given: Column, print_: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(given, F.lit("")), print_))


def clean_metadata(*maps: Column) -> Column:
    """Maps merged, later ones win; internal keys and null values left out."""
    merged = maps[0]
    for more in maps[1:]:
        merged = F.map_concat(_without(merged, more), more)
    return F.map_filter(merged, lambda k, v: ~k.isin(*INTERNAL_KEYS) & v.isNotNull())


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))


def parse_result_json(results: DataFrame) -> DataFrame:
    """``(task_id, label, labels, score, engine)`` from the JSON of a classification; fields that are missing are null."""
    parsed = F.from_json("classification_result", "label string, labels array<string>, score double, metadata struct<engine:string>")
    return results.select("task_id", parsed.alias("p")).select("task_id", "p.label", F.array_join("p.labels", ",").alias("labels"), "p.score", F.col("p.metadata.engine").alias("engine"))


def rollup_batch(requests: DataFrame) -> DataFrame:
    """``(batch_id, responses, all_success)`` from ``requests(batch_id, success)``."""
    return requests.groupBy("batch_id").agg(F.count("*").alias("responses"), F.min("success").alias("all_success"))

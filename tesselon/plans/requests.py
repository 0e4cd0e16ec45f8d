"""Registered queries of request preparation and of cost and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.operators import costing as c
from tesselon.operators import requests as r
from tesselon.sources import views
from tesselon.sources.views import sql

AS_OF = "2001-08-02 00:00:00"
DAY = 86400.0
TTL_DAYS, DEADLINE_DAYS, AGING_DAYS = 30, 30, 3650


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def normal(spark, sf) -> DataFrame:
    return r.normalize_filters(views.requests(spark, sf))


def q1(spark, sf):
    listed = F.array_join(F.transform("ops", lambda o: F.concat_ws("|", o["key"], o["payload"])), ";")
    return r.normalize_filters(views.requests(spark, sf)).select("request_id", listed.alias("ops"), "output_format")


def q2(spark, sf):
    return r.step_rows(normal(spark, sf)).select("request_id", "pos", "op", r.params_text(F.col("params")).alias("params"))


def q3(spark, sf):
    return r.reject_bad_filters(normal(spark, sf)).select("request_id", "reason", F.col("reason").isNull().alias("accepted"))


def _resolved():
    return r.resolve_output_format(F.col("output_format"), F.lit(None).cast("string"), F.col("file_name"))


def q4(spark, sf):
    return r.normalize_filters(views.requests(spark, sf)).select("request_id", _resolved().alias("output_format"))


def q5(spark, sf):
    return q4(spark, sf).select("request_id", r.map_save_format(F.col("output_format")).alias("save_format"))


def _piped(spark, sf) -> DataFrame:
    """Requests with a pipeline whose types are plain, or JSON with params as object or text."""
    q = views.requests(spark, sf).where(F.size("filters") > 0)
    key = F.trim(F.element_at("filters", 1))
    quoted = F.regexp_replace(key, '[^A-Za-z]', "")
    kind = F.col("request_id") % 3
    typ = (
        F.when(kind == 0, F.concat(F.lit(" "), F.upper(quoted), F.lit(" ")))
        .when(kind == 1, F.concat(F.lit('{"name":"'), quoted, F.lit('","params":{"a":"1","b":"2"}}')))
        .otherwise(F.concat(F.lit('{"name":"'), quoted, F.lit('","params":"{\\"a\\":\\"7\\"}"}')))
    )
    extra = F.when(F.col("request_id") % 2 == 0, F.lit('{"b":"9","width":"50"}')).otherwise("")
    item = F.struct(typ.alias("type"), extra.alias("params_json"))
    return q.select("request_id", F.array(item, F.struct(F.lit("flip").alias("type"), F.lit("{}").alias("params_json"))).alias("pipeline"), (F.col("width") % 100).alias("target_width"), F.lit(0).alias("target_height"))


def q6(spark, sf):
    return r.expand_pipeline(_piped(spark, sf)).select("request_id", "step", "operation", r.params_text(F.col("params")).alias("params"))


def q7(spark, sf):
    q = views.requests(spark, sf).select("request_id", F.concat(F.lit("["), F.array_join("filters", " , "), F.lit("]")).alias("filter_type"), F.col("width").alias("target_width"), F.col("height").alias("target_height"))
    return r.expand_legacy_filters(q)


def q8(spark, sf):
    kind = F.when(F.col("request_id") % 4 == 0, "thumbnail").when(F.col("request_id") % 4 == 1, " Gray, thumbnail ").when(F.col("request_id") % 4 == 2, "blur,, edges").otherwise("")
    q = views.requests(spark, sf).withColumn("kind", kind)
    return q.select("request_id", F.array_join(r.map_filter_type(F.col("kind"), F.col("width") % 3 * 40, F.col("height")), ";").alias("filters"))


def q9(spark, sf):
    return r.project_transforms(r.filter_args(normal(spark, sf)))


def q10(spark, sf):
    t = views.tasks(spark, sf)
    wire = F.col("priority") - 5
    return t.select("task_id", r.priority_in(wire).alias("priority_in"), r.priority_out(F.col("priority")).alias("priority_out"))


def q11(spark, sf):
    opened = F.when(F.col("request_id") % 13 != 5, F.col("width"))  # the others could not be opened
    return r.validate_requests(views.requests(spark, sf).withColumn("width", opened)).select("request_id", "reason")


def q12(spark, sf):
    return r.limit_batches(views.requests(spark, sf)).select("request_id", "batch_id", "batch_size", "accepted")


def q13(spark, sf):
    return r.assemble_uploads(views.uploads(spark, sf), 2000).select("upload_id", F.md5("payload").alias("payload_md5"), "n_bytes", "file_name", "reason")


def _data():
    return F.concat(F.col("file_name"), F.col("size_bytes").cast("string")).cast("binary")


def q14(spark, sf):
    return views.requests(spark, sf).select("request_id", r.fingerprint(F.col("file_name"), F.col("filters"), _data()).alias("fingerprint"))


def q15(spark, sf):
    given = F.when(F.col("request_id") % 2 == 0, F.concat(F.lit("k"), F.col("request_id").cast("string"))).otherwise("")
    return views.requests(spark, sf).select("request_id", r.idempotency_key("business:", given, r.fingerprint(F.col("file_name"), F.col("filters"), _data())).alias("idempotency_key"))


def q16(spark, sf):
    q = views.requests(spark, sf)
    text = lambda name: F.col(name).cast("string")
    a = F.create_map(F.lit("node_id"), text("batch_id"), F.lit("file"), F.col("file_name"), F.lit("size"), text("size_bytes"))
    b = F.create_map(F.lit("file"), F.concat(F.lit("x-"), F.col("file_name")), F.lit("width"), F.when(F.col("width") > 6000, text("width")))
    return q.select("request_id", r.params_text(r.clean_metadata(a, b)).alias("metadata"))


def q17(spark, sf):
    return r.parse_result_json(views.model_output(spark, sf))


def q18(spark, sf):
    return r.rollup_batch(r.validate_requests(views.requests(spark, sf)).withColumn("success", F.col("reason").isNull()))


def _steps(spark, sf) -> DataFrame:
    sized = normal(spark, sf).withColumn("output_format", _resolved())
    return c.transform_weight(r.step_rows(sized, "width", "height", "output_format"))


def c1(spark, sf):
    return _steps(spark, sf).select("request_id", "pos", "op", F.round("weight", 6).alias("weight"))


def c2(spark, sf):
    each = r.normalize_filters(views.requests(spark, sf)).select("request_id", r.suffix_of(F.col("file_name")).alias("fmt"), F.posexplode("ops").alias("pos", "o"))
    hint, fmt = c.queue_cost_hints(F.col("o.key"), F.col("fmt"))
    return each.select("request_id", "pos", hint.alias("filter_hint"), fmt.alias("format_hint"))


def _costed(spark, sf) -> DataFrame:
    sums = _steps(spark, sf).groupBy("request_id").agg(F.sum("weight").alias("weights"), F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("ops"))
    q = views.requests(spark, sf).join(sums, "request_id", "left")
    return q.withColumn("heuristic", F.round(c.heuristic_ms(F.col("weights")), 9))


def c3(spark, sf):
    return _costed(spark, sf).select("request_id", F.col("heuristic").alias("heuristic_ms"))


def c4(spark, sf):
    ops = F.coalesce(F.transform("ops", lambda o: o["op"]), F.array().cast("array<string>"))
    return _costed(spark, sf).select("request_id", c.task_signature(ops).alias("signature"))


def c5(spark, sf):
    return c.ema_service_ms(views.task_log(spark, sf))


def _estimated(spark, sf) -> DataFrame:
    t = views.tasks(spark, sf).withColumn("signature", F.concat(F.lit("sig"), (F.col("task_id") % 12).cast("string"))).withColumn("heuristic", c.heuristic_ms(F.lit(None).cast("double")))
    return c.estimate_service(t, c5(spark, sf))


def c6(spark, sf):
    return _estimated(spark, sf).select("task_id", F.round("service_ms", 6).alias("service_ms"), F.round("cost", 9).alias("cost"))


def c7(spark, sf):
    memory, cpu, io = c.resource_need(F.col("service_ms"))
    return _estimated(spark, sf).select("task_id", memory.alias("memory_bytes"), F.round(cpu, 9).alias("cpu_units"), F.round(io, 9).alias("io_units"))


def scored(spark, sf) -> DataFrame:
    return c.score_tasks(_estimated(spark, sf), as_of(), DEADLINE_DAYS * DAY, AGING_DAYS * DAY)


def c8(spark, sf):
    return scored(spark, sf).select("task_id", "score")


def c9(spark, sf):
    return c.rank_backlog(scored(spark, sf).where("status = 'queued'")).select("node_id", "task_id", "rank")


def c10(spark, sf):
    eligible = F.col("created_at") + F.make_dt_interval(F.col("attempt") * 400)
    return c.next_ready(scored(spark, sf).withColumn("next_eligible", eligible), as_of(), 25).select("task_id", "score", F.round("next_wait_s", 6).alias("next_wait_s"))


def c11(spark, sf):
    return c.backlog_by_priority(views.tasks(spark, sf).where("status = 'queued'"))


def c12(spark, sf):
    nodes = views.tasks(spark, sf).select("node_id").distinct()
    nodes = nodes.select("node_id", (F.col("node_id") != 7).alias("accepting"), (F.col("node_id") * 128 * c.MIB).alias("free_bytes"))
    return c.admission_split(views.tasks(spark, sf), nodes, 500, 20_000_000).select("task_id", "reason")


# The filter entries and what they stand for, in DuckDB.
PARSED = """, parsed AS (
  SELECT request_id, pos, payload, CASE k WHEN 'gray' THEN 'grayscale' WHEN 'brightness-contrast' THEN 'brightness_contrast' WHEN 'watermark' THEN 'watermark_text' WHEN 'convert' THEN 'format' WHEN 'format_conversion' THEN 'format' ELSE k END AS key
  FROM (SELECT request_id, pos, lower(trim(split_part(t, ':', 1))) AS k, CASE WHEN contains(t, ':') THEN trim(substr(t, instr(t, ':') + 1)) ELSE '' END AS payload
    FROM (SELECT request_id, generate_subscripts(f, 1) - 1 AS pos, trim(unnest(f)) AS t FROM (SELECT request_id, list_filter(filters, lambda x: trim(x) <> '') AS f FROM requests)))
), split_up AS (
  SELECT *, list_filter(list_transform(string_split(payload, ','), lambda s: trim(s)), lambda s: s <> '') AS l, list_transform(string_split(payload, '|'), lambda s: trim(s)) AS w FROM parsed
), judged AS (
  SELECT *, CASE WHEN key NOT IN ('grayscale', 'resize', 'crop', 'rotate', 'flip', 'blur', 'sharpen', 'brightness', 'contrast', 'brightness_contrast', 'watermark_text', 'ocr', 'inference', 'format') THEN 'unsupported filter: ' || key
    WHEN key = 'resize' AND (split_part(payload, 'x', 1) = '' OR NOT contains(payload, 'x') OR substr(payload, instr(payload, 'x') + 1) = '') OR key = 'crop' AND len(l) <> 4
      OR key = 'rotate' AND contains(payload, ',') AND len(l) <> 2 OR key = 'brightness_contrast' AND len(l) <> 2 THEN 'wrong arguments: ' || key END AS problem,
    CASE key WHEN 'brightness' THEN 'brightness_contrast' WHEN 'contrast' THEN 'brightness_contrast' WHEN 'format' THEN 'format_conversion' ELSE key END AS op
  FROM split_up
), fields AS (
  SELECT *, CASE WHEN key = 'resize' THEN trim(split_part(payload, 'x', 1)) END AS p_width, CASE WHEN key = 'resize' THEN trim(substr(payload, instr(payload, 'x') + 1)) END AS p_height,
    CASE WHEN key = 'crop' THEN l[1] END AS p_left, CASE WHEN key = 'crop' THEN l[2] END AS p_upper, CASE WHEN key = 'crop' THEN l[3] END AS p_right, CASE WHEN key = 'crop' THEN l[4] END AS p_lower,
    CASE WHEN key = 'rotate' THEN CASE WHEN contains(payload, ',') THEN l[1] ELSE coalesce(nullif(payload, ''), '0') END END AS p_angle,
    CASE WHEN key = 'rotate' THEN CASE WHEN contains(payload, ',') THEN lower(l[2]) ELSE 'true' END END AS p_expand,
    CASE WHEN key = 'flip' THEN coalesce(nullif(payload, ''), 'horizontal') END AS p_direction, CASE WHEN key = 'blur' THEN coalesce(nullif(payload, ''), '1.5') END AS p_radius,
    CASE WHEN key = 'sharpen' THEN coalesce(nullif(payload, ''), '2.0') END AS p_factor,
    CASE key WHEN 'brightness' THEN coalesce(nullif(payload, ''), '1.0') WHEN 'contrast' THEN '1.0' WHEN 'brightness_contrast' THEN l[1] END AS p_brightness,
    CASE key WHEN 'brightness' THEN '1.0' WHEN 'contrast' THEN coalesce(nullif(payload, ''), '1.0') WHEN 'brightness_contrast' THEN l[2] END AS p_contrast,
    CASE WHEN key = 'watermark_text' THEN coalesce(w[1], '') END AS p_text, CASE WHEN key = 'watermark_text' THEN coalesce(nullif(w[2], ''), '16') END AS p_x,
    CASE WHEN key = 'watermark_text' THEN coalesce(nullif(w[3], ''), '16') END AS p_y, CASE WHEN key = 'watermark_text' THEN coalesce(nullif(w[4], ''), 'white') END AS p_fill,
    CASE WHEN key = 'watermark_text' THEN coalesce(nullif(w[5], ''), '36') END AS p_size
  FROM judged WHERE request_id NOT IN (SELECT request_id FROM judged WHERE problem IS NOT NULL)
), formats AS (
  SELECT q.request_id, p.explicit, coalesce(nullif(trim(p.explicit), ''), nullif(lower(regexp_extract(q.file_name, '.\\.([^./]+)$', 1)), ''), 'png') AS fmt
  FROM requests q LEFT JOIN (SELECT request_id, arg_max(lower(payload), pos) AS explicit FROM parsed WHERE key = 'format' GROUP BY 1) p USING (request_id)
)"""
MULTIPLIER = "CASE {0} WHEN 'jpg' THEN 1.0e0 WHEN 'jpeg' THEN 1.0e0 WHEN 'png' THEN 1.05e0 WHEN 'webp' THEN 1.25e0 WHEN 'bmp' THEN 0.85e0 WHEN 'gif' THEN 1.35e0 WHEN 'ico' THEN 1.2e0 WHEN 'tif' THEN 1.15e0 WHEN 'tiff' THEN 1.15e0 END"
BASE = "CASE {0} WHEN 'grayscale' THEN 0.35e0 WHEN 'resize' THEN 0.95e0 WHEN 'crop' THEN 0.25e0 WHEN 'rotate' THEN 0.65e0 WHEN 'flip' THEN 0.2e0 WHEN 'blur' THEN 1.3e0 WHEN 'sharpen' THEN 1.0e0 WHEN 'brightness_contrast' THEN 0.6e0 WHEN 'watermark_text' THEN 1.1e0 WHEN 'format_conversion' THEN 0.3e0 WHEN 'ocr' THEN 3.2e0 WHEN 'inference' THEN 3.8e0 END"
WEIGHED = (
    PARSED
    + f""", sized AS (
  SELECT f.*, greatest(q.width, 1)::DOUBLE AS w1, greatest(q.height, 1)::DOUBLE AS h1, greatest(q.width::DOUBLE * q.height, 1) AS area, m.fmt, q.width, q.height, q.size_bytes
  FROM fields f JOIN requests q USING (request_id) JOIN formats m USING (request_id)
), ratios AS (
  SELECT *, greatest(coalesce(p_width::DOUBLE, w1), 1) * greatest(coalesce(p_height::DOUBLE, h1), 1) / area AS grown,
    greatest(coalesce(p_right::DOUBLE, w1) - coalesce(p_left::DOUBLE, 0), 1) * greatest(coalesce(p_lower::DOUBLE, h1) - coalesce(p_upper::DOUBLE, 0), 1) / area AS kept,
    abs(coalesce(p_angle::DOUBLE, 0)) % 360 AS angle,
    greatest(abs(greatest(coalesce(p_brightness::DOUBLE, 1), 0) - 1), abs(greatest(coalesce(p_contrast::DOUBLE, 1), 0) - 1)) AS away FROM sized
), weighed AS (
  SELECT *, CASE WHEN op = 'rotate' AND angle < 1e-9 THEN 0.05e0 ELSE coalesce({BASE.format("op")}, 1.0e0) * CASE op
    WHEN 'resize' THEN CASE WHEN grown >= 1 THEN least(1 + (grown - 1) * 0.35e0, 2.2e0) ELSE greatest(0.65e0, 0.9e0 - (1 - grown) * 0.25e0) END
    WHEN 'crop' THEN greatest(0.45e0, least(1.0e0, kept + 0.15e0))
    WHEN 'rotate' THEN CASE WHEN angle IN (90, 180, 270) THEN CASE WHEN angle = 180 THEN 0.7e0 ELSE 0.85e0 END + CASE WHEN p_expand = 'true' THEN 0 ELSE 0.1e0 END ELSE 1.3e0 END
    WHEN 'flip' THEN CASE WHEN lower(p_direction) = 'both' THEN 1.15e0 ELSE 1.0e0 END
    WHEN 'blur' THEN least(0.85e0 + greatest(p_radius::DOUBLE, 0) * 0.22e0, 2.0e0)
    WHEN 'sharpen' THEN least(0.9e0 + abs(greatest(p_factor::DOUBLE, 0) - 1) * 0.35e0, 1.9e0)
    WHEN 'brightness_contrast' THEN least(0.9e0 + away * 0.4e0, 1.8e0)
    WHEN 'watermark_text' THEN least(0.9e0 + length(p_text) / 80.0e0 + greatest(p_size::INT, 1) / 180.0e0, 1.9e0)
    WHEN 'format_conversion' THEN coalesce({MULTIPLIER.format("lower(fmt)")}, 1.1e0) ELSE 1.0e0 END END AS weight FROM ratios
)"""
)
HEURISTIC = "40.0e0 + greatest(greatest(width, 1)::DOUBLE * greatest(height, 1) / 1e6, size_bytes / 6291456.0e0, 0.2e0) * 70.0e0 * {0}"
EMA = """, ordered AS (SELECT signature, list(latency_ms ORDER BY ts, event_id) AS l, count(*) AS n FROM task_log GROUP BY signature),
ema AS (SELECT signature, round(list_reduce(l, lambda a, v: CASE WHEN a > 0 THEN 0.65e0 * a + 0.35e0 * v ELSE v END), 6) AS ema_ms, n FROM ordered)"""
ESTIMATED = (
    EMA
    + f""", estimated AS (
  SELECT t.*, CASE WHEN ema_ms > 0 THEN ema_ms ELSE {HEURISTIC.format("0.5e0")} END AS service_ms
  FROM tasks t LEFT JOIN ema e ON e.signature = concat('sig', CAST(t.task_id % 12 AS STRING))
)"""
)
SCORED = (
    ESTIMATED
    + f""", scored AS (SELECT *, round(0.35e0 * least(greatest(priority / 10.0e0, 0), 1) + 0.25e0 * CASE WHEN deadline IS NULL THEN 0.15e0 WHEN deadline <= TIMESTAMP '{AS_OF}' THEN 1.0e0
    ELSE least(greatest(1 - (epoch_us(deadline) - epoch_us(TIMESTAMP '{AS_OF}')) / 1e6 / {DEADLINE_DAYS * DAY!r}e0, 0), 1) END
  + 0.2e0 * least(greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 1e6, 0) / {AGING_DAYS * DAY!r}e0, 1) - 0.1e0 * least(greatest(service_ms / 1500.0e0, 0), 1)
  - 0.05e0 * least(attempt / greatest(max_retries, 1)::DOUBLE, 1) - 0.05e0 * least(size_bytes / 33554432.0e0, 1), 6) AS score FROM estimated)"""
)
PRINT = "sha256(encode(file_name) || '\\x00'::BLOB || coalesce(list_reduce(list_transform(filters, lambda f: encode(f) || '\\x00'::BLOB), lambda a, v: a || v), ''::BLOB) || unhex(sha256(encode(file_name || CAST(size_bytes AS STRING)))))"
_PIPED = """, piped AS (
  SELECT request_id, step, CASE WHEN step = 2 THEN 'flip' ELSE lower(regexp_replace(trim(filters[1]), '[^A-Za-z]', '', 'g')) END AS operation,
    CASE WHEN step = 1 AND request_id % 3 = 1 THEN '1' WHEN step = 1 AND request_id % 3 = 2 THEN '7' END AS a,
    CASE WHEN step = 1 AND request_id % 2 = 0 THEN '9' WHEN step = 1 AND request_id % 3 = 1 THEN '2' END AS b,
    CASE WHEN step = 1 AND request_id % 2 = 0 THEN '50' WHEN width % 100 > 0 THEN CAST(width % 100 AS STRING) END AS w
  FROM requests CROSS JOIN (VALUES (1), (2)) s(step)
)"""

_ALL = [
    ("q1_normalize_filters", q1, "requests", PARSED + " SELECT q.request_id, coalesce(string_agg(concat(key, '|', payload), ';' ORDER BY pos), '') AS ops, arg_max(lower(payload), pos) FILTER (key = 'format') AS output_format FROM requests q LEFT JOIN parsed USING (request_id) GROUP BY q.request_id"),
    ("q2_filter_args", q2, "requests", PARSED + """ SELECT request_id, pos, op, CASE WHEN key = 'resize' THEN concat('height=', p_height, ';width=', p_width) WHEN key = 'crop' THEN concat('left=', p_left, ';lower=', p_lower, ';right=', p_right, ';upper=', p_upper)
      WHEN key = 'rotate' THEN concat('angle=', p_angle, ';expand=', p_expand) WHEN key = 'flip' THEN 'direction=' || p_direction WHEN key = 'blur' THEN 'radius=' || p_radius WHEN key = 'sharpen' THEN 'factor=' || p_factor
      WHEN op = 'brightness_contrast' THEN concat('brightness=', p_brightness, ';contrast=', p_contrast)
      WHEN key = 'watermark_text' THEN concat('angle=', coalesce(nullif(w[8], ''), '-28'), ';fill=', p_fill, ';opacity=', coalesce(nullif(w[7], ''), '96'), ';size=', p_size, ';spacing_x=', coalesce(nullif(w[9], ''), '220'), ';spacing_y=', coalesce(nullif(w[10], ''), '160'), ';stroke_width=', coalesce(nullif(w[6], ''), '2'), ';text=', p_text, ';x=', p_x, ';y=', p_y) ELSE '' END AS params FROM fields"""),
    ("q3_reject_bad_filters", q3, "requests", PARSED + " SELECT request_id, reason, reason IS NULL AS accepted FROM (SELECT q.request_id, arg_min(problem, pos) FILTER (problem IS NOT NULL) AS reason FROM requests q LEFT JOIN judged USING (request_id) GROUP BY 1)"),
    ("q4_resolve_output_format", q4, "requests", PARSED + " SELECT request_id, fmt AS output_format FROM formats"),
    ("q5_map_save_format", q5, "requests", PARSED + " SELECT request_id, CASE fmt WHEN 'jpg' THEN 'JPEG' WHEN 'tif' THEN 'TIFF' ELSE upper(fmt) END AS save_format FROM formats"),
    ("q6_expand_pipeline", q6, "requests", _PIPED + " SELECT request_id, step, operation, concat_ws(';', 'a=' || a, 'b=' || b, 'width=' || w) AS params FROM piped"),
    ("q7_expand_legacy_filters", q7, "requests", """, one AS (SELECT request_id, width, height, list_filter(list_transform(string_split(array_to_string(filters, ','), ','), lambda s: lower(trim(s))), lambda s: s <> '') AS l FROM requests)
      SELECT request_id, CAST(generate_subscripts(l, 1) AS INT) AS step, unnest(l) AS operation, width, height FROM one"""),
    ("q8_map_filter_type", q8, "requests", """ SELECT request_id, CASE request_id % 4 WHEN 0 THEN size WHEN 1 THEN 'gray;' || size WHEN 2 THEN 'blur;edges' || CASE WHEN tw > 0 THEN ';' || size ELSE '' END ELSE '' END AS filters
      FROM (SELECT request_id, tw, concat('resize:', CAST(tw AS STRING), 'x', CAST(height AS STRING)) AS size FROM (SELECT *, width % 3 * 40 AS tw FROM requests))"""),
    ("q9_project_transforms", q9, "requests", PARSED + """, good AS (SELECT *, CASE WHEN key = 'resize' AND problem IS NULL THEN CAST(trim(split_part(payload, 'x', 1)) AS INT) END AS tw, CASE WHEN key = 'resize' AND problem IS NULL THEN CAST(trim(substr(payload, instr(payload, 'x') + 1)) AS INT) END AS th FROM judged)
      SELECT q.request_id, coalesce(arg_max(op, pos) FILTER (op IN ('grayscale', 'ocr', 'inference')), 'none') AS filter_type, coalesce(arg_max(tw, pos) FILTER (tw IS NOT NULL), 0) AS target_width, coalesce(arg_max(th, pos) FILTER (th IS NOT NULL), 0) AS target_height FROM requests q LEFT JOIN good USING (request_id) GROUP BY 1"""),
    ("q10_priority", q10, "tasks", " SELECT task_id, CASE WHEN priority - 5 > 0 THEN 9 ELSE 5 END AS priority_in, CASE WHEN priority >= 8 THEN 1 ELSE 0 END AS priority_out FROM tasks"),
    ("q11_validate_requests", q11, "requests", """ SELECT request_id, CASE WHEN size_bytes <= 0 THEN 'empty payload' WHEN size_bytes > 26214400 THEN 'payload too large' WHEN len(filters) > 12 THEN 'too many filters' WHEN request_id % 13 = 5 THEN 'invalid image' WHEN width <= 0 OR height <= 0 THEN 'dimensions not positive'
      WHEN width > 12000 THEN 'width over limit' WHEN height > 12000 THEN 'height over limit' WHEN CAST(width AS BIGINT) * height > 40000000 THEN 'pixels over limit' END AS reason FROM requests"""),
    ("q12_limit_batches", q12, "requests", " SELECT request_id, batch_id, count(*) OVER (PARTITION BY batch_id) AS batch_size, count(*) OVER (PARTITION BY batch_id) <= 16 AS accepted FROM requests"),
    ("q13_assemble_uploads", q13, "uploads", """ SELECT upload_id, CASE WHEN n_bytes <= 2000 THEN md5(payload) END AS payload_md5, n_bytes, coalesce(named, concat('upload-', CAST(upload_id AS STRING), '.png')) AS file_name, CASE WHEN n_bytes > 2000 THEN 'payload too large' WHEN n_bytes = 0 THEN 'empty upload' END AS reason
      FROM (SELECT upload_id, string_agg(coalesce(chunk, ''), '' ORDER BY seq) AS payload, CAST(sum(strlen(coalesce(chunk, ''))) AS BIGINT) AS n_bytes, arg_max(file_name, seq) FILTER (file_name <> '') AS named FROM uploads GROUP BY upload_id)"""),
    ("q14_fingerprint", q14, "requests", f" SELECT request_id, {PRINT} AS fingerprint FROM requests"),
    ("q15_idempotency_key", q15, "requests", f" SELECT request_id, 'business:' || CASE WHEN request_id % 2 = 0 THEN concat('k', CAST(request_id AS STRING)) ELSE {PRINT} END AS idempotency_key FROM requests"),
    ("q16_clean_metadata", q16, "requests", " SELECT request_id, concat('file=x-', file_name, ';size=', CAST(size_bytes AS STRING), CASE WHEN width > 6000 THEN concat(';width=', CAST(width AS STRING)) ELSE '' END) AS metadata FROM requests"),
    ("q17_parse_result_json", q17, "model_output", """ SELECT task_id, json_extract_string(classification_result, '$.label') AS label, array_to_string(CAST(json_extract(classification_result, '$.labels') AS VARCHAR[]), ',') AS labels,
      CAST(json_extract(classification_result, '$.score') AS DOUBLE) AS score, json_extract_string(classification_result, '$.metadata.engine') AS engine FROM model_output"""),
    ("q18_rollup_batch", q18, "requests", " SELECT batch_id, count(*) AS responses, bool_and(size_bytes > 0 AND size_bytes <= 26214400 AND len(filters) <= 12 AND width > 0 AND height > 0 AND width <= 12000 AND height <= 12000 AND CAST(width AS BIGINT) * height <= 40000000) AS all_success FROM requests GROUP BY batch_id"),
    ("c1_transform_weight", c1, "requests", WEIGHED + " SELECT request_id, pos, op, round(weight, 6) AS weight FROM weighed"),
    ("c2_queue_cost_hints", c2, "requests", PARSED + f""" SELECT request_id, pos, {BASE.format("CASE key WHEN 'brightness' THEN 'brightness_contrast' WHEN 'contrast' THEN 'brightness_contrast' WHEN 'format' THEN 'format_conversion' ELSE key END")} AS filter_hint,
      round({MULTIPLIER.format("lower(regexp_extract(file_name, '.\\.([^./]+)$', 1))")} * 0.3e0, 3) AS format_hint FROM parsed JOIN requests USING (request_id)"""),
    ("c3_heuristic_ms", c3, "requests", WEIGHED + f", sums AS (SELECT request_id, sum(weight) AS s FROM weighed GROUP BY 1) SELECT q.request_id, round({HEURISTIC.format('coalesce(nullif(s, 0), 0.5e0)')}, 9) AS heuristic_ms FROM requests q LEFT JOIN sums USING (request_id)"),
    ("c4_task_signature", c4, "requests", WEIGHED + """ SELECT q.request_id, concat(coalesce(any_value(o), ''), ':', CAST(any_value(greatest(CAST(width AS BIGINT) * height, 1) // 500000) AS STRING), ':', CAST(any_value(greatest(size_bytes, 1) // 1048576) AS STRING)) AS signature
      FROM requests q LEFT JOIN (SELECT request_id, string_agg(op, '-' ORDER BY pos) AS o FROM weighed GROUP BY 1) USING (request_id) GROUP BY q.request_id"""),
    ("c5_ema_service_ms", c5, "task_log", EMA + " SELECT signature, ema_ms, n FROM ema"),
    ("c6_estimate_service", c6, "tasks task_log", ESTIMATED + " SELECT task_id, round(service_ms, 6) AS service_ms, round(service_ms / 1000.0e0, 9) AS cost FROM estimated"),
    ("c7_resource_need", c7, "tasks task_log", ESTIMATED + """ SELECT task_id, greatest(CAST(trunc(n * 2.5e0) AS BIGINT), 33554432) AS memory_bytes, round(least(greatest(service_ms / 250.0e0, 0.25e0), 2.0e0), 9) AS cpu_units, round(least(greatest(n / 33554432.0e0, 0.1e0), 1.0e0), 9) AS io_units
      FROM (SELECT *, greatest(size_bytes, CAST(width AS BIGINT) * height * 3) AS n FROM estimated)"""),
    ("c8_score_tasks", c8, "tasks task_log", SCORED + " SELECT task_id, score FROM scored"),
    ("c9_rank_backlog", c9, "tasks task_log", SCORED + " SELECT node_id, task_id, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, deadline ASC NULLS LAST, task_id) AS rank FROM scored WHERE status = 'queued'"),
    ("c10_next_ready", c10, "tasks task_log", SCORED + f""", due AS (SELECT *, created_at + INTERVAL 1 DAY * (attempt * 400) AS e FROM scored)
      SELECT task_id, score, (SELECT round(min(epoch_us(e) - epoch_us(TIMESTAMP '{AS_OF}')) / 1e6, 6) FROM due WHERE e > TIMESTAMP '{AS_OF}') AS next_wait_s FROM due WHERE e <= TIMESTAMP '{AS_OF}' ORDER BY score DESC, deadline ASC NULLS LAST, task_id LIMIT 25"""),
    ("c11_backlog_by_priority", c11, "tasks", " SELECT priority, count(*) AS tasks FROM tasks WHERE status = 'queued' GROUP BY priority"),
    ("c12_admission_split", c12, "tasks", """ SELECT task_id, CASE WHEN node_id = 7 THEN 'not accepting' WHEN ahead >= 500 THEN 'backlog at watermark' WHEN size_bytes >= 20000000 AND node_id * 134217728 < 536870912 THEN 'too little memory' END AS reason
      FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY created_at, task_id) - 1 AS ahead FROM tasks)"""),
]
QUERIES = {name: run for name, run, _, _ in _ALL}
ORACLE_SQL = {name: sql(tables, body) for name, _, tables, body in _ALL}

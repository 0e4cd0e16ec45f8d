"""The raster operators as DuckDB common table expressions: each function names one step from ``src`` to ``dst``."""

from __future__ import annotations

import math

from tesselon.operators.raster_window import CENTROIDS, FEATURES, gaussian_weights

RGB = "rgb"
GRAY = "(299 * r + 587 * g + 114 * b) / 1000.0e0"


def q(v: str) -> str:
    return f"CAST(least(greatest(floor(round({v}, 6) + 0.5e0), 0), 255) AS INT)"


def lerp(a: str, b: str, alpha: float) -> str:
    return q(f"{a} * {1.0 - alpha!r}e0 + {b} * {float(alpha)!r}e0")


def each(src: str, dst: str, make, more: str = "") -> str:
    return f"{dst} AS (SELECT s.image_id, s.y, s.x, {', '.join(f'{make(c)} AS {c}' for c in RGB)} FROM {src} s {more})"


def sizes(src: str) -> str:
    return f"(SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {src} GROUP BY image_id)"


def grayscale(src, dst, intensity=1.0):
    return each(src, dst, lambda c: q(GRAY) if intensity >= 1 else lerp(c, q(GRAY), intensity))


def sepia(src, dst, intensity=1.0):
    m = {"r": "0.393e0 * r + 0.769e0 * g + 0.189e0 * b", "g": "0.349e0 * r + 0.686e0 * g + 0.168e0 * b", "b": "0.272e0 * r + 0.534e0 * g + 0.131e0 * b"}
    return each(src, dst, lambda c: lerp(c, f"least(CAST(trunc({m[c]}) AS INT), 255)", intensity))


def tint(src, dst, rgb, intensity):
    return each(src, dst, lambda c: lerp(c, str(rgb[RGB.index(c)]), intensity))


def posterize(src, dst, bits):
    return each(src, dst, lambda c: f"CAST({c} - {c} % {1 << (8 - bits)} AS INT)")


def brightness(src, dst, f):
    return each(src, dst, lambda c: q(f"{c} * {float(f)!r}e0"))


def contrast(src, dst, f):
    mean = f"JOIN (SELECT image_id, floor(avg({q(GRAY)}) + 0.5e0) AS m FROM {src} GROUP BY image_id) t USING (image_id)"
    return each(src, dst, lambda c: q(f"m * {1.0 - f!r}e0 + {c} * {float(f)!r}e0"), mean)


def crop(src, dst, x0, y0, x1, y1):
    return f"""{dst} AS (SELECT i.image_id, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x, {", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in RGB)}
FROM (SELECT DISTINCT image_id FROM {src}) i CROSS JOIN (SELECT unnest(range({y1 - y0})) AS y) a CROSS JOIN (SELECT unnest(range({x1 - x0})) AS x) b
LEFT JOIN {src} s ON s.image_id = i.image_id AND s.y = a.y + {y0} AND s.x = b.x + {x0})"""


def moved(src, dst, x, y):
    return f"{dst} AS (SELECT s.image_id, CAST({y} AS INT) AS y, CAST({x} AS INT) AS x, r, g, b FROM {src} s JOIN {sizes(src)} z USING (image_id))"


def resize(src, dst, nw, nh):
    def weights(name, side, n):
        return f"""{name} AS (
  SELECT n_in, o, i, w0 / sum(w0) OVER (PARTITION BY n_in, n_out, o) AS wt, n_out FROM (
    SELECT *, CASE WHEN t = 0 THEN 1.0e0 WHEN abs(t) < 3 THEN 3.0e0 * sin(pi() * t) * sin(pi() * t / 3.0e0) / (t * pi() * t * pi()) ELSE 0.0e0 END AS w0 FROM (
      SELECT n_in, n_out, o, i, round((i + 0.5e0 - (o + 0.5e0) * n_in / CAST(n_out AS DOUBLE)) / greatest(n_in / CAST(n_out AS DOUBLE), 1.0e0), 9) AS t FROM (
        SELECT n_in, n_out, o, unnest(range(n_in)) AS i FROM (
          SELECT n_in, n_out, unnest(range(n_out)) AS o FROM (SELECT DISTINCT {side} AS n_in, CAST({n} AS INT) AS n_out FROM {dst}_z))))))"""

    return f"""{dst}_z AS (SELECT *, CAST({nw} AS INT) AS nw, CAST({nh} AS INT) AS nh FROM {sizes(src)}),
{weights(dst + "_wx", "w", "nw")}, {weights(dst + "_wy", "h", "nh")},
{dst}_a AS (SELECT s.image_id, z.h, z.nh, s.y, k.o AS x, {", ".join(f"sum(s.{c} * k.wt) AS {c}" for c in RGB)}
  FROM {src} s JOIN {dst}_z z USING (image_id) JOIN {dst}_wx k ON k.n_in = z.w AND k.n_out = z.nw AND k.i = s.x GROUP BY ALL),
{dst} AS (SELECT a.image_id, CAST(k.o AS INT) AS y, CAST(a.x AS INT) AS x, {", ".join(q(f"sum(a.{c} * k.wt)") + f" AS {c}" for c in RGB)}
  FROM {dst}_a a JOIN {dst}_wy k ON k.n_in = a.h AND k.n_out = a.nh AND k.i = a.y GROUP BY a.image_id, k.o, a.x)"""


def thumbnail(src, dst, w, h):
    side = lambda c: f"greatest(floor(round({c} * least({w}.0e0 / w, {h}.0e0 / h, 1.0e0), 6) + 0.5e0), 1)"
    return resize(src, dst, side("w"), side("h"))


def pixelate(src, dst, block):
    def source(v, n):
        cells = f"greatest(floor({n} / {block}.0e0), 1)"
        return f"least(floor((floor(({v} + 0.5e0) * {cells} / {n}) + 0.5e0) * {n} / {cells}), {n} - 1)"

    return f"""{dst} AS (SELECT o.image_id, o.y, o.x, s.r, s.g, s.b FROM (SELECT p.image_id, p.y, p.x, {source("p.y", "h")} AS sy, {source("p.x", "w")} AS sx FROM {src} p JOIN {sizes(src)} z USING (image_id)) o
JOIN {src} s ON s.image_id = o.image_id AND s.y = o.sy AND s.x = o.sx)"""


def cubic(t):
    return f"CASE WHEN abs({t}) <= 1 THEN 1.5e0 * abs({t})**3 - 2.5e0 * abs({t})**2 + 1 WHEN abs({t}) < 2 THEN -0.5e0 * abs({t})**3 + 2.5e0 * abs({t})**2 - 4e0 * abs({t}) + 2 ELSE 0e0 END"


def rotate(src, dst, angle, fill):
    cos, sin = round(math.cos(math.radians(angle)), 12), round(math.sin(math.radians(angle)), 12)
    return f"""{dst}_z AS (SELECT *, CAST(ceil(round(w * {abs(cos)!r}e0 + h * {abs(sin)!r}e0, 9)) AS INT) AS nw, CAST(ceil(round(h * {abs(cos)!r}e0 + w * {abs(sin)!r}e0, 9)) AS INT) AS nh FROM {sizes(src)}),
{dst}_g AS (SELECT *, round((ox + 0.5e0 - nw / 2.0e0) * {cos!r}e0 - (oy + 0.5e0 - nh / 2.0e0) * {sin!r}e0 + w / 2.0e0 - 0.5e0, 9) AS sx,
  round((ox + 0.5e0 - nw / 2.0e0) * {sin!r}e0 + (oy + 0.5e0 - nh / 2.0e0) * {cos!r}e0 + h / 2.0e0 - 0.5e0, 9) AS sy
  FROM (SELECT *, unnest(range(nw)) AS ox FROM (SELECT *, unnest(range(nh)) AS oy FROM {dst}_z))),
{dst}_t AS (SELECT image_id, oy, ox, ({cubic("(sx - tx)")}) * ({cubic("(sy - ty)")}) AS wt, least(greatest(tx, 0), w - 1) AS x, least(greatest(ty, 0), h - 1) AS y
  FROM (SELECT g.*, floor(sx) + i.i AS tx, floor(sy) + j.j AS ty FROM {dst}_g g CROSS JOIN (SELECT unnest(range(-1, 3)) AS i) i CROSS JOIN (SELECT unnest(range(-1, 3)) AS j) j
    WHERE sx >= -0.5e0 AND sx <= w - 0.5e0 AND sy >= -0.5e0 AND sy <= h - 0.5e0)),
{dst} AS (SELECT g.image_id, CAST(g.oy AS INT) AS y, CAST(g.ox AS INT) AS x, {", ".join(f"coalesce(v.{c}, {fill[k]}) AS {c}" for k, c in enumerate(RGB))} FROM {dst}_g g LEFT JOIN (
  SELECT t.image_id, t.oy, t.ox, {", ".join(q(f"sum(s.{c} * t.wt)") + f" AS {c}" for c in RGB)} FROM {dst}_t t JOIN {src} s USING (image_id, y, x) GROUP BY ALL) v USING (image_id, oy, ox))"""


def watermark(src, dst, mask, mw, mh, opacity, angle, gap):
    cos, sin = round(math.cos(math.radians(angle)), 12), round(math.sin(math.radians(angle)), 12)
    tw, th = mw + gap, mh + gap
    values = ", ".join(f"({a}, {b}, {k})" for a, b, k in mask)
    share = f"{opacity / 255.0!r}e0"
    whole = "least(greatest(cg + cl, 0e0), 1e0)"
    over = lambda c: q(f"{c} * (1.0e0 - {whole} * {share}) + least(greatest(cg * 255e0, 0e0), {whole} * 255e0) * {share}") + f" AS {c}"
    held = lambda t: f"least(greatest({t}, 0), d - 1)"
    return f"""{dst}_m(my, mx, kind) AS (VALUES {values}),
{dst}_d AS (SELECT s.*, w, h, CAST(floor(sqrt(CAST(w * w + h * h AS DOUBLE))) AS INT) AS d FROM {src} s JOIN {sizes(src)} z USING (image_id)),
{dst}_o AS (SELECT *, x + floor((d - w) / 2.0e0) + 0.5e0 - d / 2.0e0 AS dx, y + floor((d - h) / 2.0e0) + 0.5e0 - d / 2.0e0 AS dy FROM {dst}_d),
{dst}_u AS (SELECT *, round(dx * {cos!r}e0 - dy * {sin!r}e0 + d / 2.0e0 - 0.5e0, 9) AS u, round(dx * {sin!r}e0 + dy * {cos!r}e0 + d / 2.0e0 - 0.5e0, 9) AS v FROM {dst}_o),
{dst}_t AS (SELECT *, {cubic("(u - tu)")} AS wu, {cubic("(v - tv)")} AS wv, CAST({held("tu")} AS INT) AS hu, CAST({held("tv")} AS INT) AS hv FROM (
  SELECT image_id, y, x, d, u, v, floor(u) + i.i AS tu, floor(v) + j.j AS tv FROM {dst}_u CROSS JOIN (SELECT unnest(range(-1, 3)) AS i) i CROSS JOIN (SELECT unnest(range(-1, 3)) AS j) j
    WHERE u >= -0.5e0 AND u <= d - 0.5e0 AND v >= -0.5e0 AND v <= d - 0.5e0)),
{dst}_p AS (SELECT image_id, y, x, wu * wv AS wt, (hu - (hv // {th}) % 2 * {tw // 2} + 4 * {tw}) % {tw} AS mx, hv % {th} AS my FROM {dst}_t),
{dst}_s AS (SELECT image_id, y, x, coalesce(sum(wt) FILTER (kind = 1), 0e0) AS cg, coalesce(sum(wt) FILTER (kind = 2), 0e0) AS cl FROM {dst}_p JOIN {dst}_m USING (my, mx) GROUP BY image_id, y, x),
{dst} AS (SELECT image_id, y, x, {", ".join(over(c) for c in RGB)} FROM (SELECT t.*, coalesce(cg, 0e0) AS cg, coalesce(cl, 0e0) AS cl FROM {src} t LEFT JOIN {dst}_s USING (image_id, y, x)))"""


def blur(src, dst, radius):
    w = gaussian_weights(radius)
    half = len(w) // 2
    taps = ", ".join(f"({i - half}, {v!r}e0)" for i, v in enumerate(w))
    part = lambda a, b, along, side, cast: f"""{b} AS (SELECT t.image_id, t.y, t.x, {", ".join(cast(f"sum(s.{c} * k.wt)") + f" AS {c}" for c in RGB)}
FROM (SELECT image_id, y, x, w, h FROM {src} JOIN {sizes(src)} z USING (image_id)) t CROSS JOIN {dst}_k k
JOIN {a} s ON s.image_id = t.image_id AND s.{"y" if along == "x" else "x"} = t.{"y" if along == "x" else "x"} AND s.{along} = least(greatest(t.{along} + k.i, 0), t.{side} - 1)
GROUP BY t.image_id, t.y, t.x)"""  # noqa: E731
    return f"{dst}_k(i, wt) AS (VALUES {taps}), {part(src, dst + '_a', 'x', 'w', str)}, {part(dst + '_a', dst, 'y', 'h', q)}"


def boxed(src, dst, cols):
    sums = ", ".join(f"sum(n.{c}) AS {c}3, any_value(s.{c}) AS {c}" for c in cols)
    return f"""{dst} AS (SELECT s.image_id, s.y, s.x, {sums}, count(*) < 9 AS edge FROM {src} s JOIN {src} n ON n.image_id = s.image_id AND abs(n.y - s.y) <= 1 AND abs(n.x - s.x) <= 1 GROUP BY s.image_id, s.y, s.x)"""


def sharpen(src, dst, f):
    smooth = lambda c: f"CASE WHEN edge THEN {c} ELSE {q(f'({c}3 + {c} * 4) / 13.0e0')} END"
    return boxed(src, dst + "_b", RGB) + ", " + each(dst + "_b", dst, lambda c: q(f"({smooth(c)}) * {1.0 - f!r}e0 + {c} * {float(f)!r}e0"))


def kernel(src, dst, form):
    value = f"CASE WHEN edge THEN v ELSE {q(form)} END"
    return f"{dst}_v AS (SELECT image_id, y, x, {q(GRAY)} AS v FROM {src}), {boxed(dst + '_v', dst + '_b', 'v')}, {each(dst + '_b', dst, lambda c: value)}"


def edges(src, dst):
    return kernel(src, dst, "CAST(v * 9 - v3 AS DOUBLE)")


def sharpen_kernel(src, dst):
    return kernel(src, dst, "(v * 34 - v3 * 2) / 16.0e0")


def binarize(src, dst, threshold):
    return f"""{dst}_v AS (SELECT image_id, y, x, {q(GRAY)} AS v FROM {src}),
{dst}_s AS (SELECT image_id, y, x, CASE WHEN hi > lo THEN {q("(v - lo) * 255.0e0 / (hi - lo)")} ELSE v END AS v FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM {dst}_v)),
{dst}_c AS (SELECT image_id, y, x, CASE WHEN v >= {threshold} THEN 255 ELSE 0 END AS v FROM {dst}_s),
{dst} AS (SELECT image_id, y, x, v AS r, v AS g, v AS b FROM (SELECT image_id, y, x, CASE WHEN avg(v) OVER (PARTITION BY image_id) < 127 THEN 255 - v ELSE v END AS v FROM {dst}_c))"""


def stats(src, dst):
    s = "CASE WHEN greatest(r, g, b) > 0 THEN floor((greatest(r, g, b) - least(r, g, b)) * 255.0e0 / greatest(r, g, b)) ELSE 0 END"
    cols = ", ".join(f"round(avg({c}), 6) AS {n}_mean, round(stddev_pop({c}), 6) AS {n}_std" for c, n in (("r", "r"), ("g", "g"), ("b", "b"), ("v", "gray")))
    return f"""{edges(src, dst + "_e")}, {dst} AS (SELECT * FROM (SELECT image_id, {cols}, round(avg(s), 6) AS s_mean, max(x) + 1 AS w, max(y) + 1 AS h FROM (SELECT *, {q(GRAY)} AS v, {s} AS s FROM {src}) GROUP BY image_id)
JOIN (SELECT image_id, round(avg(r), 6) AS edge_mean FROM {dst}_e GROUP BY image_id) USING (image_id))"""


def features(src, dst):
    made = ("gray_mean / 255.0e0", "gray_std / 128.0e0", "s_mean / 255.0e0", "edge_mean / 255.0e0", "w / CAST(greatest(h, 1) AS DOUBLE)", "(r_std + g_std + b_std) / 3.0e0 / 128.0e0")
    return f"{stats(src, dst + '_s')}, {dst} AS (SELECT image_id, {', '.join(f'round({m}, 6) AS {n}' for m, n in zip(made, FEATURES))} FROM {dst}_s)"


def centroids(src, dst):
    rows = ", ".join("({}, '{}', {})".format(k, c[0], ", ".join(f"{v!r}e0" for v in c[1:])) for k, c in enumerate(CENTROIDS))
    square = " + ".join(f"(f.{n} - c.c{k}) ** 2" for k, n in enumerate(FEATURES))
    return f"""{features(src, dst + "_f")}, {dst}_c(pos, label, {", ".join(f"c{k}" for k in range(6))}) AS (VALUES {rows}),
{dst} AS (SELECT *, round(1.0e0 / (1.0e0 + distance), 6) AS confidence FROM (SELECT f.image_id, c.pos, c.label, round(sqrt({square}), 6) AS distance FROM {dst}_f f CROSS JOIN {dst}_c c))"""


def topk(src, dst, k):
    return f"""{centroids(src, dst + "_d")}, {dst} AS (SELECT image_id, min(label) FILTER (n = 1) AS label, string_agg(label, ',' ORDER BY n) AS labels, round(max(confidence) FILTER (n = 1), 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY distance, pos) AS n FROM {dst}_d) WHERE n <= {k} GROUP BY image_id)"""

"""GIF streams and page labelling."""

import itertools
import random
import struct

import numpy as np
import pytest

from tesselon.llm import gif, html


@pytest.mark.parametrize("minimum", [2, 4, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 500, 9000])
def test_streams_round_trip(minimum, n):
    rng = random.Random(n)
    for most in (1, 2, 1 << minimum):
        s = bytes(rng.randrange(most) for _ in range(n))
        packed = gif.pack_streams([gif.lzw_codes(x, minimum) for x in (s, s[:9], b"")], minimum)
        assert [gif.lzw_samples(p, minimum) for p in packed] == [s, s[:9], b""] == gif.lzw_streams(packed, minimum)


def test_known_stream():
    """The sample stream that descriptions of the format use: a 10x10 picture in four colours."""
    data = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert gif.lzw_samples(data, 2) == bytes(map(int, "".join(rows)))


def test_broken_streams_do_not_raise():
    packed = gif.pack_streams([gif.lzw_codes(bytes(range(200)) * 3)])[0]
    for cut in range(0, len(packed), 7):
        assert (bytes(range(200)) * 3).startswith(gif.lzw_samples(packed[:cut]))
    gif.lzw_samples(bytes(range(256)))


def frame(left, top, w, h, samples, disposal=0, clear=None, delay=5, local=None, woven=False):
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
    bits = (0x80 | 0 if local else 0) | (0x40 if woven else 0)
    packed = gif.pack_streams([gif.lzw_codes(bytes(samples), 2)], 2)[0]
    return control + struct.pack("<BHHHHB", 0x2C, left, top, w, h, bits) + (local or b"") + b"\x02" + bytes([len(packed)]) + packed + b"\0"


def picture(w, h, *frames):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette + b"".join(frames) + b";"


def canvases(data):
    return [c for c in gif.composed(*gif.decode_gif(data))]


def test_disposal_and_transparency():
    base = frame(0, 0, 2, 2, [1, 1, 1, 1], disposal=1)
    keep, wipe, undo = (canvases(picture(2, 2, base, frame(0, 0, 2, 1, [2, 3], disposal=k, clear=3), frame(1, 1, 1, 1, [3]))) for k in (1, 2, 3))
    assert [tuple(v) for v in keep[1].reshape(4, 4)] == [(0, 255, 0, 255), (255, 0, 0, 255), (255, 0, 0, 255), (255, 0, 0, 255)]
    assert tuple(keep[2][0, 0]) == (0, 255, 0, 255)
    assert tuple(wipe[2][0, 0]) == (0, 0, 0, 0) and tuple(wipe[2][1, 0]) == (255, 0, 0, 255)
    assert tuple(undo[2][0, 0]) == (255, 0, 0, 255) and tuple(undo[2][1, 1]) == (0, 0, 255, 255)


def test_local_palette_and_interlace():
    shade = bytes([9, 9, 9, 200, 200, 200])
    rows = [0, 1, 0, 1, 1, 0, 1, 0]  # stored order: rows 0, 4, 2, 6, 1, 3, 5, 7
    out = canvases(picture(1, 8, frame(0, 0, 1, 8, rows, local=shade, woven=True)))[0]
    assert out[:, 0, 0].tolist() == [9, 200, 9, 9, 200, 200, 200, 9]


def test_text_media_and_timed_frames(spark):
    texts = ["", None, "a", "é" * 2000, "x" * 576, "y" * 577, "z" * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = gif.text_media(df)
    for r in media.collect():
        raw = (texts[r["doc_id"]] or "").encode()
        _, _, frames = gif.decode_gif(bytes(r["media"]))
        payload = b"".join(f.indices.tobytes() for f in frames)
        assert r["n_bytes"] == len(raw) and len(payload) % 576 == 0 and len(payload) - len(raw) <= 576
        assert payload == raw + b"\xff" * (len(payload) - len(raw))
    timed = gif.gif_frames(media).where("doc_id = 6").orderBy("frame").collect()
    assert [r["start_ms"] for r in timed] == [100 * k for k in range(len(timed))] and len(timed) == 9
    total = np.sum([r["histogram"] for r in timed], axis=0)
    digest = {r["doc_id"]: r for r in gif.media_digest(media).collect()}[6]
    feature = digest["feature"]
    assert [(r["start_ms"], r["delay_ms"], r["histogram"]) for r in timed] == [tuple(f) for f in digest["frames"]]
    assert feature.split(";")[2] == ",".join(map(str, total))


def test_null_broken_and_oversized_media(spark):
    good = gif.encode_gifs([b"a" * 576])[0]
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    wide_frame = picture(2, 2, frame(0, 0, 2, 2, [1, 1, 1, 1])).replace(struct.pack("<HHHH", 0, 0, 2, 2), struct.pack("<HHHH", 0, 0, 65535, 65535))
    rows = [(1, 5, None), (2, 5, b""), (3, 5, b"no gif"), (4, 5, huge), (5, 5, wide_frame), (6, 5, good), (6, 5, good)]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").selectExpr("*", "1 as feature", "2 as payload_bytes")
    got = {r["doc_id"]: (r["payload_bytes"], r["media_bytes"], r["feature"] is None) for r in gif.media_digest(df).collect()}
    assert got == {1: (None, None, True), 2: (None, 0, True), 3: (None, 6, True), 4: (None, len(huge), True), 5: (None, len(wide_frame), True), 6: (576, len(good), False)}
    assert [r["doc_id"] for r in gif.gif_frames(df).collect()] == [6, 6]
    assert gif.media_digest(df.limit(0)).count() == gif.gif_frames(df.limit(0)).count() == gif.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_cut_by_bytes(monkeypatch):
    assert gif.runs([], len) == []
    monkeypatch.setattr(gif, "RUN_BYTES", 10)
    assert gif.runs([b"a" * n for n in (4, 4, 4, 50, 1, 1)], len) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    long = bytes(range(256)) * 60
    assert gif.encode_gifs([long[: 96 * 150]])[0] == gif.encode_gifs([long[: 96 * 150], b"x" * 576])[0]


def test_min_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 8)
        scores = [rng.choice([-2, -1, -0.5, 0.3, 0.7, 1.3, 2.1]) for _ in range(n)]
        ties = [(a, b, rng.choice([0.2, 0.5, 1.1])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(labels):
            return sum(abs(s) for s, x in zip(scores, labels) if (s > 0) != bool(x)) + sum(c for a, b, c in ties if bool(labels[a]) != bool(labels[b]))

        assert abs(cost(html.min_cut(scores, ties)) - min(map(cost, itertools.product((0, 1), repeat=n)))) < 1e-9


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies to make this page work well for you.</div><nav><a href=x>Home</a></nav>
<div class="post-content"><h1>Title here</h1><p>First para with &eacute; a &lt; b and <a href=q>a link</a>
 in it.<p>Short.<ul><li>Item <b>one</b> is here</li><li>two</li></ul><div class=ad>Buy this now, it is the best thing ever made.</div>
<script>var t="</p>";</script><p>After the advert comes a paragraph that is long enough to count.</p><form><p>Your email please</p></form></div>
<div class="comments"><p>I read this and found it very good, thanks a lot for all of it.</p></div><aside>Related stories</aside><footer>&copy; 2020</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE).split("\n") == [
        "Title here", "First para with é a < b and a link in it.", "Short.", "Item one is here", "two", "After the advert comes a paragraph that is long enough to count.",
    ]


def test_pages_of_the_table_by_their_markup(spark):
    import re
    from html import unescape

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = re.search("<article>(.*)</article>", r["html"], re.S).group(1)
        parts = [" ".join(unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", inside)]
        assert html.main_text(r["html"]) == "\n".join(p for p in parts if p)

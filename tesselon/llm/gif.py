"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, HEIGHT, STRIP = 96, 36, 6
UNIT = WIDTH * STRIP
GRAY = bytes(v for i in range(256) for v in (i, i, i))
FULL = 4096
BINS = 8
ROWS, RUN_BYTES = 64, 1 << 20
#: Samples of the largest screen that is laid out, and of the largest frame that its stream does not fill.
MOST_BLANK = 1 << 26


def runs(items: list, size, most: int = ROWS) -> list[tuple[int, int]]:
    """Stretches of ``items`` of at most ``most`` items and about RUN_BYTES by ``size``; a larger item stands alone."""
    out, begin, held = [], 0, 0
    for i, item in enumerate(items):
        n = size(item)
        if i > begin and (held + n > RUN_BYTES or i - begin == most):
            out.append((begin, i))
            begin, held = i, 0
        held += n
    return [*out, (begin, len(items))] if items else []


def _widths(minimum: int) -> np.ndarray:
    """Bit widths of the codes that follow a clear code, as many as fill the table, and then some."""
    first = (1 << minimum) + 1
    entries = np.arange(first, FULL + 1)
    width = np.maximum(minimum + 1, np.ceil(np.log2(entries + 1)).astype(int))
    return np.minimum(width, 12)


_SCHEDULE = {m: _widths(m) for m in range(2, 9)}


def lzw_codes(samples: bytes, minimum: int = 8) -> list[int]:
    """The code stream of ``samples``, from the clear code to the end code, each code times 256 (the low byte is free)."""
    clear = 256 << minimum
    out = [clear]
    if not samples:
        return [clear, clear + 256]
    send, room = out.append, FULL - (1 << minimum) - 2
    for at in range(0, len(samples), room):  # a stretch that cannot fill the table; the next begins with a clear code
        if at:
            send(clear)
        part = samples[at : at + room]
        table: dict[int, int] = {}
        find, free, prefix = table.get, clear + 512, part[0] << 8
        for b in part[1:]:
            code = find(prefix | b)
            if code:
                prefix = code
            else:
                send(prefix)
                table[prefix | b] = free
                free += 256
                prefix = b << 8
        send(prefix)
    send(clear + 256)
    return out


def pack_streams(streams: list[list[int]], minimum: int = 8) -> list[bytes]:
    """Code streams (as ``lzw_codes`` gives them) as bits, lowest first, each code as wide as its table has grown; each
    stream starts on a byte."""
    if not streams:
        return []
    many = np.array([len(s) for s in streams])
    c = np.fromiter(chain.from_iterable(streams), np.int64, int(many.sum())) >> 8
    clear, schedule = 1 << minimum, _SCHEDULE[minimum]
    first = np.r_[0, np.cumsum(many)[:-1]]
    # A code's width goes by how many codes came since the last clear code, which itself is as wide as those before it.
    resets = np.flatnonzero(c == clear)
    since = np.arange(len(c)) - 1 - resets[np.maximum(np.searchsorted(resets, np.arange(len(c)), side="left") - 1, 0)]
    width = schedule[np.clip(since, 0, len(schedule) - 1)]
    width[first] = minimum + 1
    bits = np.add.reduceat(width, first)
    size = (bits + 7) // 8
    begin = np.r_[0, np.cumsum(size)]
    within = np.cumsum(width) - width
    at = within - np.repeat(within[first], many) + np.repeat(begin[:-1] * 8, many)
    flat = np.zeros(begin[-1] * 8, np.uint8)
    for b in range(int(width.max())):
        wide = slice(None) if b <= minimum else width > b
        flat[at[wide] + b] = c[wide] >> b & 1
    packed = np.packbits(flat, bitorder="little").tobytes()
    return [packed[s:e] for s, e in zip(begin[:-1].tolist(), begin[1:].tolist())]


def _expanded(codes: list[int], base: list[bytes], out: list[bytes]) -> bool:
    """Append the samples of codes between two clear codes; False if a code is impossible."""
    table, known = base.copy(), len(base)
    if codes[0] >= known - 2:
        return False
    last = table[codes[0]]
    grow, send = table.append, out.append
    send(last)
    for code in codes[1:]:
        if code < known:
            entry = table[code]
        elif code == known < FULL:
            entry = last + last[:1]
        else:
            return False
        if known < FULL:
            grow(last + entry[:1])
            known += 1
        send(entry)
        last = entry
    return True


def lzw_samples(data: bytes, minimum: int = 8) -> bytes:
    """The samples of one packed code stream; a stream that breaks off gives what came before."""
    clear, schedule = 1 << minimum, _SCHEDULE[minimum]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at, out = len(data) * 8, 0, []
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    while at < total:
        most = (total - at) // (minimum + 1) + 1
        width = schedule[:most] if most <= len(schedule) else np.r_[schedule, np.full(most - len(schedule), 12)]
        start = at + np.r_[0, np.cumsum(width)]
        fits = int(np.searchsorted(start[1:], total, side="right"))
        if not fits:
            break
        codes = (wide[start[:fits] >> 3] >> (start[:fits] & 7).astype(np.uint32)) & ((1 << width[:fits]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stop[0]) if len(stop) else fits
        if n and not _expanded(codes[:n].tolist(), base, out) or not len(stop) or codes[n] == clear + 1:
            break
        at = int(start[n + 1])
    return b"".join(out)


def lzw_streams(streams: list[bytes], minimum: int = 8) -> list[bytes]:
    """The samples of many packed streams. Streams with one clear code, at their start, are unpacked together."""
    if len(streams) < 2:
        return [lzw_samples(s, minimum) for s in streams]
    clear, schedule = 1 << minimum, _SCHEDULE[minimum]
    bits = np.array([len(s) for s in streams]) * 8
    width = np.r_[minimum + 1, schedule, np.full(max(0, int(bits.max()) // 12 - len(schedule) + 1), 12)]
    edge = np.r_[0, np.cumsum(width)]
    many = np.searchsorted(edge[1:], bits, side="right")
    begin, first = np.r_[0, np.cumsum(bits)[:-1]], np.r_[0, np.cumsum(many)]
    raw = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    k = np.arange(first[-1]) - np.repeat(first[:-1], many)
    at = np.repeat(begin, many) + edge[k]
    codes = (wide[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << width[k]) - 1).astype(np.uint32)
    marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
    base, found = [bytes((i,)) for i in range(clear)] + [b"", b""], []
    for s, e, stream in zip(first[:-1].tolist(), first[1:].tolist(), streams):
        lo = int(np.searchsorted(marks, s))
        here = marks[lo : lo + 2].tolist()
        if len(here) == 2 and here[0] == s and here[1] < e and codes[s] == clear and codes[here[1]] == clear + 1:
            out: list[bytes] = []
            if here[1] > s + 1:
                _expanded(codes[s + 1 : here[1]].tolist(), base, out)
            found.append(b"".join(out))
        else:
            found.append(lzw_samples(stream, minimum))
    return found


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gifs(payloads: list[bytes], width: int = WIDTH, height: int = HEIGHT, palette: bytes = GRAY, delay: int = 10) -> list[bytes]:
    """One GIF89a per payload, a whole number of rows of ``width`` samples: opaque frames of up to ``height`` rows, the last
    one as high as what is left. ``delay`` in hundredths of a second."""
    size = width * height
    cut = [[p[at : at + size] for at in range(0, len(p), size)] for p in payloads]
    flat = [f for frames in cut for f in frames]
    packed = (p for s, e in runs(flat, len, len(flat)) for p in pack_streams([lzw_codes(f) for f in flat[s:e]]))
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0)
    made = []
    for frames in cut:
        high = len(frames[0]) // width if frames else 0
        out = [b"GIF89a", struct.pack("<HHBBB", width, high, 0xF7, 0, 0), palette]
        for f in frames:
            out += [control, struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(f) // width, 0, 8), _blocks(next(packed))]
        made.append(b"".join([*out, b";"]))
    return made


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    clear_index: int | None
    palette: np.ndarray
    indices: np.ndarray


def decode_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Screen size and frames as stored. Broken streams give the frames before the break; missing samples are zero."""
    return decode_gifs([data])[0]


def decode_gifs(media: list[bytes]) -> list[tuple[int, int, list[Frame]]]:
    """Many media, whose code streams are unpacked together."""
    read = [_stored(data) for data in media]
    samples: dict[int, list[bytes]] = {}
    for minimum in {f[-2] for _, _, found in read for f in found}:
        streams = [f[-1] for _, _, found in read for f in found if f[-2] == minimum]
        samples[minimum] = [x for s, e in runs(streams, len, len(streams)) for x in lzw_streams(streams[s:e], minimum)][::-1]
    return [(wide, high, [_frame(f, samples[f[-2]].pop()) for f in found]) for wide, high, found in read]


def _frame(stored: tuple, samples: bytes) -> Frame:
    left, top, w, h, delay, disposal, index, palette, woven, _, _ = stored
    if w * h > max(MOST_BLANK, len(samples)):
        raise ValueError("a frame beyond what is laid out")
    got = samples[: w * h]
    grid = np.frombuffer(got + bytes(w * h - len(got)), np.uint8).reshape(h, w)
    if woven:
        straight = np.empty_like(grid)
        straight[[*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]] = grid
        grid = straight
    return Frame(left, top, w, h, delay, disposal, index, palette, grid)


def _stored(data: bytes) -> tuple[int, int, list[tuple]]:
    """Screen size and, per frame, place, timing, disposal, palette and packed codes."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack("<HHB", data[6:11])
    if wide * high > MOST_BLANK:
        raise ValueError("a screen beyond what is laid out")
    at, shared = 13, np.zeros((256, 3), np.uint8)

    def colours(at: int, flags: int) -> np.ndarray:
        n = 2 << (flags & 7)
        table = np.zeros((256, 3), np.uint8)
        got = np.frombuffer(data[at : at + 3 * n], np.uint8)
        table[: len(got) // 3] = got[: len(got) // 3 * 3].reshape(-1, 3)
        return table

    if flags & 0x80:
        shared = colours(at, flags)
        at += 3 * (2 << (flags & 7))
    found, control = [], (0, 0, None)

    def body(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            raw, at = body(at + 2)
            if label == 0xF9 and len(raw) >= 4:
                bits, delay, index = struct.unpack("<BHB", raw[:4])
                control = (delay * 10, bits >> 2 & 7, index if bits & 1 else None)
        elif kind == 0x2C and at + 11 <= len(data):
            left, top, w, h, bits = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = shared
            if bits & 0x80:
                palette = colours(at, bits)
                at += 3 * (2 << (bits & 7))
            if at >= len(data) or not 2 <= data[at] <= 8:
                break
            raw, after = body(at + 1)
            found.append((left, top, w, h, *control, palette, bits & 0x40, data[at], raw))
            at, control = after, (0, 0, None)
        else:
            break
    return wide, high, found


def composed(wide: int, high: int, frames: list[Frame]):
    """Yields the RGBA canvas of each frame after transparency, with earlier frames disposed of by their rules."""
    canvas = np.zeros((high, wide, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        own = f.indices[: area.shape[0], : area.shape[1]]
        shown = np.ones(own.shape, bool) if f.clear_index is None else own != f.clear_index
        area[shown, :3] = f.palette[own[shown]]
        area[shown, 3] = 255
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(pixels: np.ndarray) -> np.ndarray:
    """``BINS`` counts for each of red, green and blue over the visible pixels."""
    seen = pixels.reshape(-1, pixels.shape[-1])
    if seen.shape[1] == 4:
        seen = seen[seen[:, 3] > 0]
    return np.concatenate([np.bincount(seen[:, c] // (256 // BINS), minlength=BINS) for c in range(3)])


def frame_histograms(wide: int, high: int, frames: list[Frame]) -> np.ndarray:
    """The colour histogram of each frame's canvas, one row per frame. Opaque frames of one palette are composed as indices."""
    if frames and all(f.clear_index is None and f.disposal < 2 and f.palette is frames[0].palette for f in frames) and (frames[0].width, frames[0].height) == (wide, high):
        counts, canvas = np.zeros((len(frames), 256), np.int64), np.zeros((high, wide), np.uint8)
        for k, f in enumerate(frames):
            area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
            area[:] = f.indices[: area.shape[0], : area.shape[1]]
            counts[k] = np.bincount(canvas.ravel(), minlength=256)
        bins = frames[0].palette // (256 // BINS)
        return counts @ (bins[:, :, None] == np.arange(BINS)).reshape(256, 3 * BINS)
    return np.array([histogram(c) for c in composed(wide, high, frames)], np.int64).reshape(-1, 3 * BINS)


def gif_frames(media: DataFrame) -> DataFrame:
    """``media(doc_id, media)`` as timed frames: ``(doc_id, frame, start_ms, delay_ms, width, height, pixels, histogram)``.

    ``pixels`` is RGBA after palettes, transparency and disposal. A null, broken or oversized medium has no frames. Repeated rows
    have their frames each, extra columns are ignored, an empty table gives an empty result.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "pixels", "histogram"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    wide, high, frames = decode_gif(raw or b"")
                except ValueError:
                    continue
                start, rows = 0, []
                for k, (f, canvas) in enumerate(zip(frames, composed(wide, high, frames))):
                    rows.append((k, start, f.delay_ms, wide, high, canvas.tobytes(), histogram(canvas).tolist()))
                    start += f.delay_ms
                    if len(rows) == ROWS or k + 1 == len(frames):
                        ids = batch.column(0).take(pa.array([i] * len(rows)))
                        yield pa.record_batch([ids, *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)
                        rows = []

    shape = f"doc_id {kind}, frame int, start_ms bigint, delay_ms int, width int, height int, pixels binary, histogram array<bigint>"
    return media.select("doc_id", "media").mapInArrow(run, shape)


def text_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text as UTF-8, padded with bytes 255 to a positive multiple of 576, as a GIF.

    Null counts as empty; every medium has one frame at least. Repeated rows get equal media, extra columns are ignored, an
    empty table gives an empty result. Texts are coded in runs of about RUN_BYTES; a longer one alone, a frame at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in runs(texts, lambda t: len(t or "")):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[s:e]]
                made = encode_gifs([t + b"\xff" * (UNIT * max(1, -(-len(t) // UNIT)) - len(t)) for t in raw])
                yield pa.record_batch([batch.column(0).slice(s, e - s), pa.array([len(t) for t in raw], pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """What the stored bytes of ``media(doc_id, n_bytes, media)`` hold when read back: sizes, digests and a colour feature.

    ``feature`` lists the colour histogram over all timed frames and the playing time, ``frames`` each frame's time and histogram. Equal media give equal values. A null, broken or
    oversized medium has nulls but for ``media_bytes`` and ``media_sha256``, which a null one lacks as well. Repeated rows get equal values,
    extra columns are ignored, an empty table gives an empty result.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    timed = pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), timed]

    def told(raw, read) -> tuple:
        if raw is None:
            return (None,) * 7
        stored = len(raw), hashlib.sha256(raw).hexdigest()
        if read is None:
            return None, None, None, *stored, None, None
        wide, high, frames = read
        payload = b"".join(f.indices.tobytes() for f in frames)
        each = frame_histograms(wide, high, frames)
        counts = each.sum(0)
        start = np.cumsum([0, *[f.delay_ms for f in frames]]).tolist()
        timed = [{"start_ms": start[k], "delay_ms": f.delay_ms, "histogram": h} for k, (f, h) in enumerate(zip(frames, each.tolist()))]
        feature = f"{len(frames)}x{wide}x{high};{sum(f.delay_ms for f in frames)}ms;" + ",".join(map(str, counts.tolist()))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature, timed

    def run(batches):
        for batch in batches:
            found = batch.column(2).to_pylist()
            for s, e in runs(found, lambda m: len(m or b"")):
                rows = [told(raw, read) for raw, read in zip(found[s:e], readable(found[s:e]))]
                yield pa.record_batch([*(batch.column(k).slice(s, e - s) for k in (0, 1)), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    shape = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames array<struct<start_ms:bigint,delay_ms:int,histogram:array<bigint>>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, shape)


def readable(media: list[bytes | None]) -> list[tuple[int, int, list[Frame]] | None]:
    """As ``decode_gifs``, with None for what is null or broken."""
    try:
        return decode_gifs(media)
    except (ValueError, TypeError):
        pass
    out = []
    for raw in media:
        try:
            out.append(decode_gif(raw or b""))
        except ValueError:
            out.append(None)
    return out

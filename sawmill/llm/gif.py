"""GIF images: an LZW decoder with palettes, disposal and transparency, timed frames with colour histograms, and an
encoder that stores bytes losslessly as 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowmap import map_texts, small_batches

WIDTH, ROWS, DELAY = 64, 2048, 4
#: Pixels of one canvas or frame at most (8192 x 8192): what a task holds at a time, whatever the number of frames.
MOST = 1 << 26
#: Rows of a canvas that are coloured, and bytes of frames that are sent on, at a time.
BAND, SENT = 256, 16 << 20
#: Histogram cells: two bits of each of red, green and blue.
CELLS = 64


class GifError(ValueError):
    pass


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """LZW codes of samples of ``bits`` bits, low bits first, of growing width; the table restarts when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, table, new = [clear], {}, end + 1
    put, get = codes.append, table.get
    samples = iter(data)
    last = next(samples, -1)
    for b in samples:
        key = last << 8 | b
        code = get(key)
        if code is not None:
            last = code
            continue
        put(last)
        last = b
        if new < 4096:
            table[key] = new
            new += 1
        else:
            put(clear)
            table.clear()
            new = end + 1
    if last >= 0:
        put(last)
    put(end)
    return _joined(np.array(codes, np.int64), bits)


def _widths(n: int, bits: int) -> np.ndarray:
    """Widths of the codes that follow a clear code, which the decoder knows: its table grows with every code but the
    first, and a width grows once the next entry would not fit."""
    entries = np.minimum((1 << bits) + 1 + np.maximum(np.arange(n), 0), 4095)
    return np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1


def _joined(codes: np.ndarray, bits: int) -> bytes:
    clear = 1 << bits
    width = np.empty(len(codes), np.int64)
    starts = np.flatnonzero(codes == clear)
    for a, z in zip(starts, [*starts[1:], len(codes) - 1], strict=True):
        # the codes after this clear, up to and with the next one
        width[a + 1 : z + 1] = _widths(z - a, bits)
    width[0] = bits + 1
    total = int(width.sum())
    at = np.cumsum(width) - width
    out = np.zeros(total + 24 >> 3, np.uint8)
    value = codes << (at & 7)
    byte = at >> 3
    for k in range(3):
        _or(out, byte + k, value >> 8 * k & 255)
    return out[: total + 7 >> 3].tobytes()


def _or(out: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """out[at] |= value, where equal places have disjoint bits, so that or is sum."""
    out += np.bincount(at, value, len(out)).astype(np.uint8)


def _grown(codes: np.ndarray, end: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples, begin, length of each code) of the codes behind a clear code, while the table grows.

    The entry that a code adds is that code's own samples and the one behind them, so every code is a literal or a copy of
    samples further front: lengths and samples come by following those copies, twice as far in each step.  Only codes that
    begin before ``most`` samples count; one beyond the table raises unless that many samples come before it.
    """
    n = len(codes)
    par = codes - (end + 1)
    bad = np.flatnonzero(par >= np.arange(n))
    n = int(bad[0]) if len(bad) else n
    codes, par = codes[:n], par[:n]
    literal = par < 0
    length, up = np.ones(n + 1, np.int64), np.append(np.where(literal, n, par), n)
    length[n] = 0
    while (up != n).any():
        length, up = length + length[up], up[up]
    length = length[:n]
    begin = np.cumsum(length) - length
    total = int(begin[-1] + length[-1]) if n else 0
    if len(bad) and total < most:
        raise GifError("a code beyond the table")
    if total > most:
        n = int(np.searchsorted(begin, most))
        literal, par, length, begin, codes = literal[:n], par[:n], length[:n], begin[:n], codes[:n]
        total = int(begin[-1] + length[-1]) if n else 0
    back = np.where(literal, 0, begin[np.maximum(par, 0)] - begin).astype(np.int32)
    source = np.arange(total, dtype=np.int32) + np.repeat(back, length)
    value = np.zeros(total, np.uint8)
    value[begin[literal]] = codes[literal]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return value[source], begin, length
        source = further


def _full(codes: np.ndarray, end: int, grown: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Samples of codes that come once the table is full: literals and entries of the codes that made it."""
    samples, begin, length = grown
    literal, par = codes < end, np.maximum(codes - (end + 1), 0)
    size = np.where(literal, 1, length[par] + 1)
    at = np.cumsum(size) - size
    out = samples[np.arange(int(size.sum())) + np.repeat(np.where(literal, 0, begin[par]) - at, size)]
    out[at[literal]] = codes[literal]
    return out


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """Samples of a code stream; it ends at the end code, after ``most`` samples or with the data."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, out, size, ended = len(data) * 8, 0, [], 0, False
    while not ended and at + bits + 1 <= total and size < most:
        # codes up to the next clear code, whose widths are known beforehand
        parts, seen, grown, done = [], 0, None, False
        while not done and size < most:
            width = min(end + seen, 4095).bit_length()
            left = (total - at) // width
            n = min(4096 if width == 12 else (1 << width) - (end + seen), left)
            if n <= 0:
                done = ended = True
                codes = np.zeros(0, np.int64)
            else:
                place = at + width * np.arange(n)
                byte = place >> 3
                codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7)) & ((1 << width) - 1)
                stop = np.flatnonzero((codes == clear) | (codes == end))
                if len(stop):
                    n, done = int(stop[0]), True
                    ended = bool(codes[n] == end)
                    codes = codes[:n]
                    at += width
                at += width * n
                seen += n
            if grown is None:
                parts.append(codes)
                if not done and seen < 4096:
                    continue
                grown = _grown(np.concatenate(parts), end, most - size)
                made = grown[0]
            else:
                made = _full(codes, end, grown)
            out.append(made)
            size += len(made)
    return b"".join(x.tobytes() for x in out)[:most]


@dataclass
class Frame:
    """A frame as stored (samples, palette) and as shown (canvas, after this frame is drawn)."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: np.ndarray
    palette: np.ndarray
    canvas: np.ndarray
    start_ms: int = 0


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)
    loops: int | None = None


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _interlaced(samples: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(samples), 0
    for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        rows = out[first::step]
        rows[...] = samples[at : at + len(rows)]
        at += len(rows)
    return out


def decode(data: bytes) -> Gif:
    """All frames, each with a canvas of its own; ``images`` holds one at a time."""
    gif = Gif(0, 0)
    for f in images(data, gif):
        f.canvas = f.canvas.copy()
        gif.frames.append(f)
    return gif


def images(data: bytes, gif: Gif | None = None) -> Iterator[Frame]:
    """The frames one after the other, on one canvas: a frame's canvas is good until the next frame is asked for.  ``gif``
    gets the size and the loops.

    Disposal 2 clears a frame's rectangle before the next one is drawn, 3 restores what was below it; transparent samples
    leave the canvas as it is.  Missing samples of a truncated frame are 0; a sample beyond its palette is black.  Data that
    isn't a GIF raises GifError, and so does a canvas or frame of more than MOST pixels.
    """
    gif = Gif(0, 0) if gif is None else gif
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at = 13
    black = np.zeros((256, 3), np.uint8)

    def palette(flags: int, at: int):
        n = 2 << (flags & 7)
        p = black.copy()
        got = np.frombuffer(data[at : at + 3 * n], np.uint8)
        p[: len(got) // 3] = got[: len(got) // 3 * 3].reshape(-1, 3)
        return p, at + 3 * n

    shared = None
    if flags & 0x80:
        shared, at = palette(flags, at)
    gif.width, gif.height = width, height
    if width * height > MOST:
        raise GifError("a canvas of too many pixels")
    canvas = np.zeros((height, width, 4), np.uint8)
    control, below, start = (0, 0, None), None, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10, body[3] if body[0] & 1 else None)
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                gif.loops = struct.unpack("<H", body[12:14])[0]
            continue
        if kind != 0x2C or at + 11 > len(data):
            raise GifError(f"unknown block {kind}")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        own = shared
        if flags & 0x80:
            own, at = palette(flags, at)
        bits = data[at] if at < len(data) else 0
        if not 2 <= bits <= 8:
            raise GifError("bad sample size")
        body, at = _blocks(data, at + 1)
        if w * h > MOST:
            raise GifError("a frame of too many pixels")
        got = np.frombuffer(lzw_decode(body, bits, w * h), np.uint8)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(got)] = got
        samples = samples.reshape(h, w)
        if flags & 0x40:
            samples = _interlaced(samples)
        disposal, delay, transparent = control
        colours = own if own is not None else black
        if disposal == 3:
            below = canvas.copy()
        y, x = min(top + h, height), min(left + w, width)
        part = samples[: max(0, y - top), : max(0, x - left)]
        area = canvas[top:y, left:x]
        rgba = np.column_stack([colours, np.full(256, 255, np.uint8)])
        for r in range(0, len(part), BAND):
            band, some = area[r : r + BAND], part[r : r + BAND]
            if transparent is None:
                band[...] = rgba[some]
            else:
                shown = some != transparent
                band[shown] = rgba[some[shown]]
        yield Frame(left, top, w, h, delay, disposal, transparent, samples, colours, canvas, start)
        start += delay
        if disposal == 2:
            canvas[top:y, left:x] = 0
        elif disposal == 3:
            canvas = below
        control = (0, 0, None)


_GREY = bytes(c for i in range(256) for c in (i, i, i))


def store(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A grey-scale GIF whose samples are the payload (a positive multiple of ``width`` bytes), ``rows`` rows a frame."""
    lines = len(payload) // width
    if lines * width != len(payload) or not lines:
        raise GifError("the payload must be a positive multiple of the width")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(lines, rows), 0xF7, 0, 0), _GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for at in range(0, lines, rows):
        h = min(rows, lines - at)
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay), b"\x00\x00", b"\x2c", struct.pack("<HHHHB", 0, 0, width, h, 0), b"\x08"]
        codes = lzw_encode(payload[at * width : (at + h) * width])
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def payload_of(gif: Gif) -> bytes:
    return b"".join(f.samples.tobytes() for f in gif.frames)


def cells(rgba: np.ndarray) -> np.ndarray:
    """The number of opaque pixels in each of CELLS colour cells."""
    out = np.zeros(CELLS, np.int64)
    for r in range(0, len(rgba), BAND):
        part = rgba[r : r + BAND]
        opaque = part[part[..., 3] > 0]
        out += np.bincount((opaque[:, 0] >> 6 << 4) | (opaque[:, 1] >> 6 << 2) | opaque[:, 2] >> 6, minlength=CELLS)
    return out


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Share of the opaque pixels in each of CELLS colour cells."""
    n = cells(rgba)
    return n / max(1, n.sum())


def luminance(rgba: np.ndarray) -> np.ndarray:
    """The number of pixels of each luminance."""
    out = np.zeros(256, np.int64)
    for r in range(0, len(rgba), BAND):
        part = rgba[r : r + BAND].reshape(-1, 4).astype(np.uint16)
        out += np.bincount((part[:, 0] * 77 + part[:, 1] * 150 + part[:, 2] * 29) >> 8, minlength=256)
    return out


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def with_media(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``media``: each text's UTF-8, padded with zero bytes to a positive multiple of 64, as a GIF.
    Null texts are empty ones, whose payload is 64 zero bytes.  A column named ``media`` is replaced."""
    return map_texts(df, text_col, lambda: lambda texts: [pa.array([store(padded(t)) for t in texts], pa.binary())], [T.StructField("media", T.BinaryType())], keep)


_FRAME = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("index", "left", "top", "width", "height", "start_ms", "delay_ms", "disposal")]
    + [T.StructField("rgb", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.FloatType()))]
)


def frames(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """A row per frame: the kept columns and index, left, top, width, height, start_ms, delay_ms, disposal, rgb (the whole
    canvas as shown, three bytes a pixel) and histogram.  Null, empty or broken media have no frames; frames before a
    broken one stay.  Frames are sent on as they are drawn, so their number takes no memory."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in _FRAME.names]
    source = df.select(*[df[f"`{c}`"] for c in dict.fromkeys([*kept, media_col])])
    schema = T.StructType([source.schema[c] for c in kept] + _FRAME.fields)
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for k, media in enumerate(batch.column(media_col).to_pylist()):
                rows, size = [], 0
                own = [batch.column(c).slice(k, 1) for c in kept]

                def sent(rows, own=own):
                    cells = [pa.concat_arrays([a] * len(rows)).cast(out.field(i).type) for i, a in enumerate(own)]
                    cells += [pa.array([r[i] for r in rows], out.field(len(own) + i).type) for i in range(len(_FRAME.names))]
                    return pa.RecordBatch.from_arrays(cells, schema=out)

                try:
                    for i, f in enumerate(images(media or b"")):
                        rows.append((i, f.left, f.top, f.width, f.height, f.start_ms, f.delay_ms, f.disposal, f.canvas[..., :3].tobytes(), histogram(f.canvas).astype(np.float32)))
                        size += f.canvas.size
                        if size >= SENT:
                            yield sent(rows)
                            rows, size = [], 0
                except (GifError, IndexError, struct.error):
                    pass
                if rows:
                    yield sent(rows)

    return small_batches(source).mapInArrow(run, schema)


def read_back(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with payload (the samples of all frames, decoded), media_bytes, media_sha256 and feature: counts
    of frames and milliseconds, the luminance mean and deviation and the fullest colour cells of the shown pixels.
    Broken media have a null payload and feature."""

    def one(media: bytes):
        size, name = len(media), hashlib.sha256(media).hexdigest()
        samples, level, cell, ms = [], np.zeros(256), np.zeros(CELLS, np.int64), 0
        try:
            for f in images(media):
                samples.append(f.samples.tobytes())
                shown = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
                level += luminance(shown)
                cell += cells(shown)
                ms += f.delay_ms
        except (GifError, IndexError, struct.error):
            return None, size, name, None
        n = max(1.0, level.sum())
        mean = (level * np.arange(256)).sum() / n
        sd = np.sqrt(max(0.0, (level * np.arange(256) ** 2).sum() / n - mean * mean))
        share = cell / max(1, cell.sum())
        fullest = ",".join(f"{c}:{share[c]:.4f}" for c in np.argsort(-share, kind="stable")[:4] if share[c] > 0)
        return b"".join(samples), size, name, f"frames={len(samples)};ms={ms};mean={mean:.3f};sd={sd:.3f};cells={fullest}"

    def f(media):
        rows = [one(m) for m in media]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.string(), pa.string()))]

    fields = [T.StructField("payload", T.BinaryType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
    return map_texts(df, media_col, lambda: f, fields, keep)

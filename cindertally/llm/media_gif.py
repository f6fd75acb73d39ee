"""GIF columns: an encoder and a decoder of the format's LZW code streams, in Python and numpy.

Decoding is general: local and global palettes, interlace, transparency, the four disposal
methods, delays, clear codes at any place. Encoding makes frames of 8-bit palette indices. An opened
file is stored as a row with its timed frames, each with the colour histogram of what is shown;
features are sums over these, by Spark's own functions.

A code stream is decoded a run between two clear codes at a time. Inside a run the width of each
code is known from its position, so all codes are cut out at once. The string of entry 258 + p is
what the stream gave at code p and one sample more; each output sample therefore points to an
earlier one, and pointer doubling resolves them all.

Cases: a null text is empty; an empty one still has one row of padding. Very long texts become
many frames. Repeated texts give repeated media. An empty table gives an empty result. A damaged file
(cut off, without its end marker, with codes or sizes that can't be, or a canvas over MOST_PIXELS)
raises ValueError when decoded alone; in a column it becomes a row of nulls with an error, and has no
frames. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .columns import sliced, small_batches

WIDTH, ROWS, DELAY = 192, 64, 4
#: No canvas or frame may be larger.
MOST_PIXELS = 1 << 26
GREY = bytes(x for v in range(256) for x in (v, v, v))
#: A timed frame, and an opened file.
FRAME = ("frame", "start_ms", "duration_ms", "histogram")
FRAMES = "array<struct<frame:bigint,start_ms:bigint,duration_ms:bigint,histogram:array<bigint>>>"
FRAME_TYPE = pa.struct([*((c, pa.int64()) for c in FRAME[:3]), (FRAME[3], pa.list_(pa.int64()))])
OPENED = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "frames": pa.list_(FRAME_TYPE), "error": pa.string(),
}


def schedule(bits: int, n: int = 4200) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and their first bits; bits: the minimum code size."""
    nxt = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    widths = np.clip(np.floor(np.log2(nxt)).astype(np.int64) + 1, bits + 1, 12)
    return widths, np.cumsum(widths) - widths


PLANS = {bits: schedule(bits) for bits in range(2, 9)}
COLUMNS = np.arange(12)


def lzw_encode(samples: bytes) -> bytes:
    """8-bit samples as a code stream: greedy longest entries, a clear code whenever the table is full."""
    out, table, nxt = [256], {}, 258
    put, get = out.append, table.get
    w = -1
    for c in samples:
        if w < 0:
            w = c
            continue
        key = w << 8 | c
        found = get(key)
        if found is not None:
            w = found
            continue
        put(w)
        if nxt < 4096:
            table[key] = nxt
            nxt += 1
        else:
            put(256)
            table.clear()
            nxt = 258
        w = c
    if w >= 0:
        put(w)
    put(257)
    codes = np.array(out, dtype=np.int64)
    clear = np.flatnonzero(codes == 256)
    since = np.arange(len(codes)) - np.concatenate([[0], np.repeat(clear + 1, np.diff(np.append(clear, len(codes) - 1)))])
    widths = PLANS[8][0][since]
    bits = (codes[:, None] >> COLUMNS & 1).astype(np.uint8)
    return np.packbits(bits[COLUMNS < widths[:, None]], bitorder="little").tobytes()


def run_samples(codes: np.ndarray, bits: int) -> np.ndarray:
    """Samples of the codes between two clear codes."""
    base = (1 << bits) + 2
    n = len(codes)
    at = np.arange(n)
    entry = codes - base
    literal = entry < 0
    if (codes[literal] >= 1 << bits).any() or (entry >= np.minimum(at, 4096 - base)).any():
        raise ValueError("a code points to no entry")
    up = np.where(literal, at, entry)
    # entries from a code up to its literal, by pointer doubling
    far, hops = up, (~literal).astype(np.int64)
    while (more := hops[far]).any():
        hops, far = hops + more, far[far]
    length = hops + 1
    ends = np.cumsum(length)
    starts = ends - length
    total = int(ends[-1]) if n else 0
    source = np.arange(total) + np.repeat(starts[up] - starts, length)
    while True:
        far = source[source]
        if (far == source).all():
            break
        source = far
    first = np.zeros(total, dtype=np.uint8)
    first[starts[literal]] = codes[literal]
    return first[source]


def lzw_decode(data: bytes, bits: int, most: int) -> np.ndarray:
    """The first `most` samples of a code stream."""
    clear, end = 1 << bits, (1 << bits) + 1
    widths, offsets = PLANS[bits]
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    have, at, made, out, done = len(data) * 8, 0, 0, [], False
    while not done and made < most and at < have:
        codes = np.zeros(0, dtype=np.int64)
        skip = 0  # codes of this run so far; beyond the plan all are 12 bits wide
        while True:
            w, o = (widths, offsets + at) if not skip else (np.full(4200, 12), at + 12 * np.arange(4200))
            fits = int(np.searchsorted(o + w, have, side="right"))
            w, o = w[:fits], o[:fits]
            byte = o >> 3
            got = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (o & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)).astype(np.int64)
            stops = np.flatnonzero((got == clear) | (got == end))
            if len(stops):
                k = int(stops[0])
                codes = np.concatenate([codes, got[:k]])
                at, done = int(o[k] + w[k]), bool(got[k] == end)
                break
            codes = np.concatenate([codes, got])
            skip += len(got)
            if fits < len(PLANS[bits][0]):
                done = True
                break
            at = int(o[-1] + w[-1])
        if len(codes):
            out.append(run_samples(codes, bits))
            made += len(out[-1])
    return np.concatenate(out)[:most] if out else np.zeros(0, dtype=np.uint8)


def blocked(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


@dataclass
class Frame:
    """A frame as stored: samples (rows x columns of palette indices) and how it is shown."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray  # colours x 3
    delay: int = DELAY  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """The payload, a multiple of width, as timed grey frames of up to `rows` rows."""
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    for k in range(0, len(payload), width * rows):
        part = payload[k : k + width * rows]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 0x04, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", blocked(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames in order; ValueError for a damaged file."""
    try:
        return decoded_blocks(data)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"damaged: {e}") from e


def decoded_blocks(data: bytes) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    at, shared = 13, np.zeros((0, 3), dtype=np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > MOST_PIXELS:
            raise ValueError("a frame is too large")
        at += 10
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3), at + 3 * n
        bits = data[at]
        body, at = blocks(at + 1)
        samples = lzw_decode(body, bits, w * h)
        if len(samples) < w * h:
            raise ValueError("a frame ends early")
        samples = samples.reshape(h, w)
        if flags & 0x40:  # interlace: four passes of rows
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        frames.append(Frame(left, top, samples, palette, delay, disposal, transparent))
        delay, disposal, transparent = 0, 0, None
    if at >= len(data):
        raise ValueError("the end marker is missing")
    return width, height, frames


def compose(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """What is on the canvas (rows x columns x RGBA) while each frame is shown."""
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in frames:
        h, w = f.samples.shape
        box = (slice(f.top, min(f.top + h, height)), slice(f.left, min(f.left + w, width)))
        before = canvas[box].copy() if f.disposal == 3 else None
        samples = f.samples[: canvas[box].shape[0], : canvas[box].shape[1]]
        shown = np.ones(samples.shape, dtype=bool) if f.transparent is None else samples != f.transparent
        canvas[box][shown] = np.dstack([f.palette[samples], np.full(samples.shape, 255, np.uint8)])[shown]
        yield canvas.copy()
        if f.disposal == 2:
            canvas[box] = 0
        elif before is not None:
            canvas[box] = before


def histogram(frame: Frame, width: int, height: int, shown: np.ndarray | None = None) -> np.ndarray:
    """Visible pixels in each of 64 colours (two bits each of red, green and blue)."""
    if shown is None:  # an opaque frame over the whole canvas: palette and index counts tell
        counts = np.bincount(frame.samples.ravel(), minlength=len(frame.palette))
        p = frame.palette >> 6
        return np.bincount(p[:, 0] * 16 + p[:, 1] * 4 + p[:, 2], weights=counts[: len(p)], minlength=64).astype(np.int64)
    seen = shown[shown[..., 3] > 0] >> 6
    return np.bincount(seen[:, 0].astype(np.int64) * 16 + seen[:, 1] * 4 + seen[:, 2], minlength=64)


def timed(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, int, int, list[int]]]:
    """frame, start and duration in milliseconds, colour histogram of the canvas as shown."""
    plain = [f.transparent is None and f.samples.shape == (height, width) for f in frames]
    canvases = compose(width, height, frames) if not all(plain) else [None] * len(frames)
    at = 0
    for k, (f, whole, shown) in enumerate(zip(frames, plain, canvases, strict=True)):
        yield k, at, 10 * f.delay, histogram(f, width, height, None if whole else shown).tolist()
        at += 10 * f.delay


def frame_rows(media: bytes) -> Iterator[tuple[int, int, int, list[int]]]:
    """The timed frames of a file."""
    return timed(*decode_gif(media))


def gif_frames(files: DataFrame) -> DataFrame:
    """A row for each timed frame of opened files: doc_id, frame, start_ms, duration_ms, histogram. Damaged files have none."""
    return files.select("doc_id", F.explode("frames").alias("f")).select("doc_id", "f.*")


def padded(text: str | None, unit: int = WIDTH) -> tuple[bytes, int]:
    """The text's bytes, filled with spaces to a positive multiple of unit; and their number before."""
    raw = (text or "").encode()
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text as a GIF in the shared folder: doc_id, n_bytes, media."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                made = [padded(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([encode_gif(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "gif-media", compression="none")


def open_media(media: DataFrame) -> DataFrame:
    """Decodes stored media (doc_id, n_bytes, media) and stores what is in them.

    A row for each file: doc_id, n_bytes, digests of the payload and of the file, its timed frames with
    colour histograms (one entry for each 12,288 bytes of payload), and the error of a damaged one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "media"):
                rows = []
                for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    try:
                        gif = decode_gif(data or b"")
                    except ValueError as e:
                        rows.append((doc, n, *[None] * 6, str(e)))
                        continue
                    payload = b"".join(f.samples.tobytes() for f in gif[2])
                    frames = [dict(zip(FRAME, r, strict=True)) for r in timed(*gif)]
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), frames, None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), OPENED.values(), strict=True)], list(OPENED))

    columns = ", ".join(f"{c} {'string' if t == pa.string() else 'long' if t == pa.int64() else FRAMES}" for c, t in OPENED.items())
    return stored(media.mapInArrow(run, columns), "gif-frames", compression="zstd")


def media_features(files: DataFrame) -> DataFrame:
    """Opened files with their feature (visible pixels by colour, summed over the stored frames), number of frames and time."""
    zeros = F.array_repeat(F.lit(0).cast("long"), 64)
    total = F.aggregate("frames", zeros, lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    named = F.transform(total, lambda n, k: F.when(n > 0, F.concat(k.cast("string"), F.lit(":"), n.cast("string"))))
    time = F.aggregate("frames", F.lit(0).cast("long"), lambda acc, f: acc + f["duration_ms"])
    kept = [c for c in OPENED if c not in ("frames", "error")]
    return files.select(*kept, F.array_join(named, " ").alias("feature"), F.when(F.col("frames").isNotNull(), F.size("frames")).cast("long").alias("n_frames"), time.alias("duration_ms"), "error")


def text_as_gif(docs: DataFrame) -> DataFrame:
    """Stores every text losslessly as a GIF, reads the files back, stores their timed frames and computes features of these."""
    return media_features(open_media(text_media(docs)))

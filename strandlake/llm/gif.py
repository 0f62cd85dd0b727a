"""GIF media columns: a lossless GIF writer and a decoder of LZW streams, palettes, disposal, transparency and timing.

The writer stores bytes as 8-bit samples under a grey palette: rows of ``WIDTH`` samples, so many rows to a frame, each
frame with its own delay. The decoder reads any GIF87a or GIF89a stream, interlaced frames included, and yields for
each frame its samples, its composed picture, its delay and colour histogram.

Defined cases: null or empty text is one row of blanks; equal data gives equal files; a text of any length is stored
whole, in as many frames as it needs; repeated rows are stored each; an empty table gives an empty result; only the id,
length and media columns are read, so further ones cannot clash. Null media have no frames and null digests; damaged
files raise ValueError. Pixels with equal colours count in one cell, so histograms have no ties to break.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, utf8_rows

WIDTH, FRAME_ROWS, DELAY = 192, 256, 4
_GREY = bytes(v for i in range(256) for v in (i, i, i))


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of ``data``, as GIF wants it: clear and end codes, widths from bits + 1 to 12."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes: list[int] = [clear]
    emit = codes.append
    table: dict[int, int] = {}
    known = table.get
    fresh = end + 1
    if data:
        now = data[0]
        for byte in memoryview(data)[1:]:
            key = now << 8 | byte
            code = known(key)
            if code is not None:
                now = code
                continue
            emit(now)
            now = byte
            if fresh < 4096:
                table[key] = fresh
                fresh += 1
            else:
                emit(clear)
                table.clear()
                fresh = end + 1
        emit(now)
    emit(end)
    return _pack_codes(np.array(codes, dtype=np.uint32), bits)


def _width_at(place: np.ndarray, bits: int) -> np.ndarray:
    """Width of the code at ``place`` (from 1) after a clear code: enough for the table when it is read, 12 at most."""
    size = place + (1 << bits)
    return bits + 1 + sum((size >= 1 << w).astype(np.int64) for w in range(bits + 1, 12))


def _widths(codes: np.ndarray, bits: int) -> np.ndarray:
    """The width of each code of a stream that begins with a clear code."""
    clears = np.flatnonzero(codes == 1 << bits)
    index = np.arange(len(codes))
    place = index - clears[np.maximum(np.searchsorted(clears, index, side="left") - 1, 0)]
    return _width_at(np.maximum(place, 1), bits)


def _pack_codes(codes: np.ndarray, bits: int) -> bytes:
    width = _widths(codes, bits)
    ends = np.cumsum(width)
    begin = ends - width
    out = np.zeros(int(ends[-1] + 7) // 8 + 4, dtype=np.uint8)
    value = codes.astype(np.uint64) << (begin & 7).astype(np.uint64)
    for b in range(3):
        np.bitwise_or.at(out, (begin >> 3) + b, (value >> np.uint64(8 * b)).astype(np.uint8))
    return out[: int(ends[-1] + 7) // 8].tobytes()


def lzw_decode(stream: bytes, bits: int, expect: int) -> bytes:
    """Up to ``expect`` samples of an LZW code stream.

    A table entry is the string of a code and the first sample of the next one, which lie side by side in the output:
    so an entry is where its string begins there and its length, and no strings are stored.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    total = 8 * len(stream)
    out = bytearray()
    at = 0
    reach = 4200  # codes to read ahead; a stream may also go on with a full table
    while at < total and len(out) < expect:
        width = _width_at(np.arange(1, reach + 1), bits)
        begin = at + np.concatenate([[0], np.cumsum(width)[:-1]])
        fit = int(np.count_nonzero(begin + width <= total))
        width, begin = width[:fit], begin[:fit]
        byte = begin >> 3
        three = data[byte] | data[byte + 1] << np.uint32(8) | data[byte + 2] << np.uint32(16)
        codes = (three >> (begin & 7).astype(np.uint32)) & ((np.uint32(1) << width.astype(np.uint32)) - np.uint32(1))
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and fit == reach:
            reach = 2 * reach
            continue
        n = int(stop[0]) if len(stop) else fit
        run = codes[:n]
        if (run < clear).all():
            out += run.astype(np.uint8).tobytes()
        else:
            begins: list[int] = []
            sizes: list[int] = []
            place = len(out)
            first_entry = clear + 2
            for code in run.tolist():
                if code < clear:
                    out.append(code)
                    begins.append(place)
                    place += 1
                    sizes.append(2)
                    continue
                k = code - first_entry
                if k >= len(sizes):
                    raise ValueError("an LZW code comes before its entry")
                start, size = begins[k], sizes[k]
                if start + size > place:  # the entry that this very code completes
                    out += out[start:place]
                    out.append(out[start])
                else:
                    out += out[start : start + size]
                begins.append(place)
                place += size
                sizes.append(size + 1)
        if not len(stop) or codes[n] == end:
            break
        at = int(begin[n] + width[n])
    return bytes(out[:expect])


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[a : a + 255])]) + data[a : a + 255] for a in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF89a that stores ``payload``, whose length is a positive multiple of ``width``, as samples of its frames."""
    rows = len(payload) // width
    if not rows or len(payload) % width:
        raise ValueError(f"the payload must be a positive multiple of {width} bytes")
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, frame_rows):
        samples = payload[top * width : (top + frame_rows) * width]
        parts += [
            struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0),
            struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(samples) // width, 0, 8),
            _blocks(lzw_encode(samples)),
        ]
    return b"".join([*parts, b";"])


@dataclass
class Frame:
    """One frame: index samples in row order, the composed RGBA picture, delay in hundredths of a second."""

    left: int
    top: int
    samples: np.ndarray
    picture: np.ndarray
    delay: int
    disposal: int
    transparent: int | None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


def _lines(height: int) -> np.ndarray:
    """The order in which interlaced lines are stored."""
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes, compose: bool = True) -> Gif:
    """Decodes all frames. With ``compose`` each frame also has the picture that a viewer shows."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(size_bits: int) -> np.ndarray:
        nonlocal at
        n = 3 << (size_bits + 1)
        found = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
        return found

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += 1 + size
        at += 1
        return b"".join(parts)

    gif, shared = Gif(width, height), palette(flags & 7) if flags & 0x80 else None
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay, disposal, transparent = 0, 0, None
    try:
        while data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                label = data[at + 1]
                at += 2
                content = blocks()
                if label == 0xF9:
                    disposal, delay = content[0] >> 2 & 7, content[1] | content[2] << 8
                    transparent = content[3] if content[0] & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError("an unknown block")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = palette(flags & 7) if flags & 0x80 else shared
            bits = data[at]
            at += 1
            raw = lzw_decode(blocks(), bits, w * h)
            if len(raw) < w * h:
                raise ValueError("a frame has too few samples")
            samples = np.frombuffer(raw, dtype=np.uint8).reshape(h, w)
            if flags & 0x40:
                ordered = np.empty_like(samples)
                ordered[_lines(h)] = samples
                samples = ordered
            picture = canvas
            if compose:
                if own is None:
                    raise ValueError("a frame has no palette")
                before = canvas.copy() if disposal == 3 else None
                box = canvas[top : top + h, left : left + w]
                seen = samples[: box.shape[0], : box.shape[1]]
                full = np.full((256, 4), 255, dtype=np.uint8)
                full[: len(own), :3] = own
                colours = full[seen]
                if transparent is None:
                    box[:] = colours
                else:
                    solid = seen != transparent
                    box[solid] = colours[solid]
                picture = canvas.copy()
                if disposal == 2:
                    box[:] = 0
                elif disposal == 3:
                    canvas = before
            gif.frames.append(Frame(left, top, samples, picture, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF ends early") from e
    return gif


def colour_histogram(picture: np.ndarray) -> np.ndarray:
    """Counts of visible pixels in 64 colour cells, two bits of each of red, green and blue."""
    high = picture >> 6
    cell = (high[..., 0] << 4 | high[..., 1] << 2 | high[..., 2]).ravel()
    return np.bincount(cell[picture[..., 3].ravel() > 0], minlength=64)


def padded(raw: bytes, multiple: int = WIDTH) -> bytes:
    """``raw`` with spaces up to a positive multiple."""
    return raw + b" " * (-len(raw) % multiple if raw else multiple)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                raw = [bytes(v) for v in utf8_rows(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode_gif(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAME = {**dict.fromkeys(("frame", "left", "top", "width", "height", "delay_cs", "start_cs", "disposal"), "int"), "samples": "binary", "histogram": "array<long>"}


def timed_frames(data: bytes | None) -> Iterator[tuple]:
    """The values of ``FRAME`` for each frame of a GIF; none for null data."""
    time = 0
    for k, f in enumerate(decode_gif(data).frames if data is not None else []):
        height, width = f.samples.shape
        yield k, f.left, f.top, width, height, f.delay, time, f.disposal, f.samples.tobytes(), colour_histogram(f.picture).tolist()
        time += f.delay


def frame_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame of each GIF: position, size, delay, start time, samples and colour histogram."""
    types = {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([("doc_id", pa.int64()), *((c, types[t]) for c, t in FRAME.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(doc, *frame) for frame in timed_frames(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {t}" for c, t in FRAME.items()))


def text_digests(media: DataFrame) -> DataFrame:
    """Reads what ``store_texts`` made: digests of the payload and the file, a feature string, number, time and colours of the frames."""
    kinds = {**dict.fromkeys(("doc_id", "n_bytes", "payload_bytes"), "long"), "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "n_frames": "long", "duration_cs": "long", "histogram": "array<long>"}
    types = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if data is None:
                    rows.append((doc, n, *[None] * (len(kinds) - 2)))
                    continue
                frames = [dict(zip(FRAME, f, strict=True)) for f in timed_frames(data)]
                payload = b"".join(f["samples"] for f in frames)
                histogram = np.sum([f["histogram"] for f in frames], axis=0).tolist()
                time = sum(f["delay_cs"] for f in frames)
                feature = f"{len(frames)}x{WIDTH};{time}cs;" + ",".join(f"{k}:{c}" for k, c in enumerate(histogram) if c)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(frames), time, histogram))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=types[t]) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds.items()))


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores all texts as GIFs in a written table, reads that table back and returns the digests."""
    return text_digests(materialize(store_texts(docs), "media"))

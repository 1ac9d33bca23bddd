"""Media columns: GIF.

:func:`decode_gif` reads any GIF: LZW code streams, global and local palettes, interlacing,
frame timing, disposal and transparency. :func:`gif_frames` turns a table of files into
timed frames with colour-histogram columns. :func:`encode_gif` writes 8-bit samples as
frames; :func:`text_media` uses both to store payloads and read them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.arrow import column_of, map_batches, texts_of

#: Width of a stored frame, and its rows at most: longer payloads get more frames.
WIDTH, ROWS = 64, 1024
#: Hundredths of a second that a stored frame is shown.
DELAY = 4
#: A histogram counts each of red, green and blue in so many steps.
STEPS = 4
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3
MAX_CODE = 4096
#: A file whose header asks for more pixels than this gives an error, not a canvas.
MAX_PIXELS = 1 << 26
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


@lru_cache(8)
def code_widths(first: int) -> np.ndarray:
    """Bits of the codes after a clear code, for a first free code ``first``; all later ones have as many as the last."""
    free = first + np.maximum(0, np.arange(MAX_CODE + 1) - 1)
    least = int(first - 2).bit_length()
    return least + sum((free >= 1 << bits).astype(np.int64) for bits in range(least, 12))


def lzw_encode(data: bytes) -> bytes:
    """A GIF code stream for 8-bit samples, cleared whenever its table is full."""
    clear, done = 256, 257
    segments, codes = [], []
    table: dict[int, int] = {}
    free, current = clear + 2, data[0]
    find, put = table.get, codes.append
    for byte in data[1:]:
        key = current << 8 | byte
        known = find(key)
        if known is not None:
            current = known
            continue
        put(current)
        current = byte
        if free < MAX_CODE:
            table[key] = free
            free += 1
        else:
            put(clear)
            segments.append(codes)
            table, codes, free = {}, [], clear + 2
            find, put = table.get, codes.append
    codes += [current, done]
    segments.append(codes)
    values = np.concatenate([[clear], *segments]).astype("<u2")
    widths = np.concatenate([[9], *[code_widths(clear + 2)[: len(x)] for x in segments]])
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def last_of_chain(following: np.ndarray) -> np.ndarray:
    """Where the links i -> following[i] <= i end, by doubling their reach until nothing changes."""
    while True:
        further = following[following]
        if np.array_equal(further, following):
            return following
        following = further


def expand_codes(codes: np.ndarray, clear: int, room: int) -> np.ndarray:
    """The samples of the codes between two clear codes, up to the code that fills ``room``.

    A table entry is the stretch of one code and the sample after it, so a code is as long as
    its chain of entries, and each of its samples is a copy of an earlier one or stands for
    itself. Both kinds of links are followed for all codes at once.
    """
    entry = codes - clear - 2
    order = np.arange(len(codes))
    if (entry >= order).any():
        raise ValueError("a GIF code is not in its table")
    literal = entry < 0
    hop, size = np.where(literal, order, entry), (~literal).astype(np.int64)
    while (more := size[hop]).any():
        size, hop = size + more, hop[hop]
    size += 1
    ends = np.cumsum(size)
    starts = ends - size
    kept = int(np.searchsorted(starts, room))
    codes, literal, size, starts = codes[:kept], literal[:kept], size[:kept], starts[:kept]
    back = np.where(literal, 0, starts - starts[np.where(literal, 0, entry[:kept])])
    total = int(ends[kept - 1])
    source = np.arange(total, dtype=np.int32) - np.repeat(back.astype(np.int32), size)
    out = np.zeros(total, np.uint8)
    out[starts[literal]] = codes[literal]
    return out[last_of_chain(source)]


def lzw_decode(stream: bytes, least: int, size: int) -> bytes:
    """Samples of a GIF code stream whose smallest code size is ``least``; at most ``size`` of them."""
    clear, done = 1 << least, (1 << least) + 1
    table = code_widths(clear + 2)
    padded = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    found: list[np.ndarray] = []
    segment: list[np.ndarray] = []
    at, end, room, count, more = 0, 8 * len(stream), size, 0, True
    while more and room > 0:
        reach = min(MAX_CODE, (end - at) // (least + 1) + 1)
        widths = table[np.minimum(np.arange(count, count + reach), MAX_CODE)]
        starts = at + np.concatenate(([0], np.cumsum(widths)))
        usable = int(np.searchsorted(starts, end, side="right")) - 1
        begin, widths = starts[:usable], widths[:usable]
        byte = begin >> 3
        word = padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16
        codes = word >> (begin & 7) & (1 << widths) - 1
        stops = np.flatnonzero((codes == clear) | (codes == done))
        upto = int(stops[0]) if len(stops) else usable
        segment.append(codes[:upto])
        count += upto
        at = int(starts[upto])
        more = usable > 0
        if len(stops):
            at += int(widths[upto])
            more = codes[upto] == clear
        if (len(stops) or not more) and count:
            found.append(expand_codes(np.concatenate(segment), clear, room))
            room -= len(found[-1])
        if len(stops):
            segment, count = [], 0
    return np.concatenate(found)[:size].tobytes() if found else b""


@dataclass
class Frame:
    """One composed picture: RGBA pixels, and when it is shown; ``samples`` are its own indices."""

    pixels: np.ndarray
    start_ms: int
    duration_ms: int
    samples: np.ndarray


def sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def interlaced_rows(height: int) -> np.ndarray:
    """The order in which an interlaced picture stores its rows."""
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def screen_size(data: bytes) -> tuple[int, int]:
    """Width and height of a GIF's canvas; ValueError for what isn't one."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    return struct.unpack_from("<HH", data, 6)


def timed_frames(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """The composed frames of a GIF one after another; ValueError at what cannot be read."""
    screen_size(data)
    try:
        yield from _frames(data, max_pixels)
    except (IndexError, struct.error) as error:
        raise ValueError("a GIF ends too early") from error


def decode_gif(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, list[Frame]]:
    """Width, height and all composed frames of a GIF; ValueError for what isn't one."""
    return *screen_size(data), list(timed_frames(data, max_pixels))


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 128:
        return None, at
    size = 2 << (flags & 7)
    colours = np.frombuffer(data[at : at + 3 * size], np.uint8).reshape(-1, 3)
    return np.concatenate((colours, np.zeros((256 - len(colours), 3), np.uint8))), at + 3 * size


def _room_for(width: int, height: int, max_pixels: int) -> None:
    if width * height > max_pixels:
        raise ValueError(f"a picture of {width} x {height} is larger than {max_pixels} pixels")


def _frames(data: bytes, max_pixels: int) -> Iterator[Frame]:
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    _room_for(width, height, max_pixels)
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear_index, clock = 0, 0, -1, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = sub_blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, block[1] | block[2] << 8
                clear_index = block[3] if block[0] & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown GIF block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        _room_for(w, h, max_pixels)
        own, at = _palette(data, at + 10, flags)
        least = data[at]
        if not 1 <= least <= 8:
            raise ValueError("no samples have this code size")
        stream, at = sub_blocks(data, at + 1)
        samples = np.zeros(w * h, np.uint8)
        found = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
        samples[: len(found)] = found
        samples = samples.reshape(h, w)
        if flags & 64:
            plain = np.empty_like(samples)
            plain[interlaced_rows(h)] = samples
            samples = plain
        palette = own if own is not None else shared if shared is not None else GREYS
        before = canvas.copy() if disposal == PREVIOUS else None
        high, wide = max(0, min(h, height - top)), max(0, min(w, width - left))
        part, shown = canvas[top : top + high, left : left + wide], samples[:high, :wide]
        colours = np.dstack((palette[shown], np.full(shown.shape, 255, np.uint8)))
        part[...] = np.where((shown == clear_index)[..., None], part, colours)
        yield Frame(canvas.copy(), clock, 10 * delay, samples)
        clock += 10 * delay
        if disposal == BACKGROUND:
            part[...] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear_index = 0, 0, -1


def encode_gif(pictures: list[np.ndarray], palette: np.ndarray = GREYS, delay: int = DELAY) -> bytes:
    """A GIF of full-size frames; each is laid over the canvas and kept. Frames may be lower than the first."""
    height, width = max(p.shape[0] for p in pictures), max(p.shape[1] for p in pictures)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for picture in pictures:
        stream = lzw_encode(picture.tobytes())
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", KEEP << 2, delay, 0, 0))
        parts.append(struct.pack("<BHHHHB", 0x2C, 0, 0, picture.shape[1], picture.shape[0], 0) + b"\x08")
        for at in range(0, len(stream), 255):
            block = stream[at : at + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


def colour_histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels in STEPS ** 3 boxes of red, green and blue."""
    seen = pixels[pixels[..., 3] > 0].astype(np.int64) * STEPS >> 8
    return np.bincount((seen[:, 0] * STEPS + seen[:, 1]) * STEPS + seen[:, 2], minlength=STEPS**3)


def gif_frames(files: DataFrame, id_col: str = "media_id", data_col: str = "media", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(id, frame, start_ms, duration_ms, width, height, histogram, error): one row per timed frame.

    A null or broken file, or one whose header asks for more than ``max_pixels``, gives one row
    with an error and null columns. A file without pictures gives none; nor does an empty table.
    Repeated rows give repeated frames. Other columns may have any names. One frame's pixels are
    in memory at a time, whatever the length of a file.
    """
    schema = (
        "id string, frame int, start_ms long, duration_ms long, width int, height int, histogram array<long>, error string"
    )

    def make():
        def step(batch):
            rows = []
            for key, data in zip(column_of(batch, "id").to_pylist(), column_of(batch, "media").to_pylist(), strict=True):
                data = bytes(data or b"")
                try:
                    width, height = screen_size(data)
                    rows += [
                        (key, i, f.start_ms, f.duration_ms, width, height, colour_histogram(f.pixels).tolist(), None)
                        for i, f in enumerate(timed_frames(data, max_pixels))
                    ]
                except ValueError as error:
                    rows.append((key, None, None, None, None, None, None, str(error)))
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string())
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in schema.split(", ")])

        return step

    chosen = files.select(F.col(id_col).cast("string").alias("id"), F.col(data_col).alias("media"))
    return map_batches(chosen, make, schema)


def pictures_of(payload: bytes) -> list[np.ndarray]:
    """A payload as pictures of WIDTH samples a row and ROWS rows at most."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return [samples[at : at + ROWS] for at in range(0, len(samples), ROWS)]


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a GIF of its UTF-8 bytes, read back and described.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, frames): the payload is the text's bytes with zeros up to a positive multiple of 64.
    All but n_bytes and the media columns come from the decoded file. ``frames`` are its timed
    frames, each with the colour histogram of its own pixels; ``feature`` names their number, the
    shown time and the fullest boxes of all histograms. Null and empty texts are 64 zeros; equal
    texts give equal values, repeated rows included; a text of any length is stored whole, in more
    frames, of which one is in memory at a time. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """

    def make():
        def step(batch):
            rows, timed = zip(*map(describe, texts_of(batch)), strict=True)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
            return pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *columns, frames_column(timed)], names=names)

        return step

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, frames array<struct<start_ms: long, duration_ms: long, histogram: array<long>>>"
    )
    names = ["doc_id", *[part.split()[0] for part in schema.split(", ")[1:9]]]
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def frames_column(timed: list[list[tuple]]) -> pa.Array:
    """Lists of (start_ms, duration_ms, histogram) as an array of structs."""
    flat = [frame for frames in timed for frame in frames]
    boxes = pa.array(np.concatenate([f[2] for f in flat]).astype(np.int64))
    histograms = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * STEPS**3, boxes)
    parts = [pa.array([f[i] for f in flat], pa.int64()) for i in range(2)]
    structs = pa.StructArray.from_arrays([*parts, histograms], ["start_ms", "duration_ms", "histogram"])
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, timed)], dtype=np.int32), structs)


def describe(text: bytes) -> tuple[tuple, list[tuple]]:
    """The columns of :func:`text_media` for one text, and its timed frames."""
    media = encode_gif(pictures_of(text + bytes(64 - len(text) % 64 if len(text) % 64 or not text else 0)))
    width, height = screen_size(media)
    digest, size, tail, timed = hashlib.sha256(), 0, b"", []
    for frame in timed_frames(media):
        payload = frame.samples.tobytes()
        digest.update(payload)
        size, tail = size + len(payload), payload[-64:]
        # a lower frame leaves rows of the one before it on the canvas: they are counted once
        boxes = colour_histogram(frame.pixels[: frame.samples.shape[0], : frame.samples.shape[1]])
        timed.append((frame.start_ms, frame.duration_ms, boxes))
    boxes = sum(f[2] for f in timed)
    fullest = np.argsort(-boxes, kind="stable")[:4]
    shown = ",".join(f"{i}={boxes[i]}" for i in fullest if boxes[i])
    feature = f"{width}x{height}/{len(timed)}/{sum(f[1] for f in timed)}ms/{shown}"
    return (len(text), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature), timed

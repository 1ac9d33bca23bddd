from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from quarryline.llm import gif_media
from tests.llm.helpers import LONG, by_id, documents


def plain_codes(data: bytes, least: int, clears: bool) -> bytes:
    """LZW bit by bit: a table of strings, cleared when full or never again."""
    clear, done = 1 << least, (1 << least) + 1
    bits = []

    def put(code, width):
        bits.extend(code >> i & 1 for i in range(width))

    table, width = {bytes([i]): i for i in range(clear)}, least + 1
    free, current = clear + 2, b""
    put(clear, width)
    for byte in data:
        longer = current + bytes([byte])
        if longer in table:
            current = longer
            continue
        put(table[current], width)
        if free < 4096:
            table[longer] = free
            free += 1
            width = max(width, (free - 1).bit_length())
        elif clears:
            put(clear, width)
            table, width, free = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        current = bytes([byte])
    put(table[current], width)
    put(done, width if free == 4096 else max(width, free.bit_length()))
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


@pytest.mark.parametrize("clears", [True, False])
@pytest.mark.parametrize("least", [2, 3, 8])
def test_decodes_plain_streams(least, clears):
    random.seed(least)
    for size in (1, 2, 7, 300, 5000, 60_000):
        data = bytes(random.choices(range(1 << least), [3] + [1] * ((1 << least) - 1), k=size))
        assert gif_media.lzw_decode(plain_codes(data, least, clears), least, size) == data
        assert gif_media.lzw_decode(plain_codes(data, least, clears), least, max(1, size // 2)) == data[: max(1, size // 2)]


def test_round_trips():
    random.seed(1)
    for data in (b"\0" * 100_000, bytes(range(256)) * 64, random.randbytes(64 * 3000), b"ab" * 3200):
        assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, len(data)) == data
        pictures = gif_media.pictures_of(data[: len(data) // 64 * 64])
        _, _, frames = gif_media.decode_gif(gif_media.encode_gif(pictures))
        assert b"".join(f.samples.tobytes() for f in frames) == data[: len(data) // 64 * 64]


def image(samples, left=0, top=0, control=None, palette=None, interlaced=False) -> bytes:
    samples = np.array(samples, np.uint8)
    height, width = samples.shape
    own = b"" if palette is None else np.array(palette + [(0, 0, 0)] * (256 - len(palette)), np.uint8).tobytes()
    stored = samples[gif_media.interlaced_rows(height)] if interlaced else samples
    stream = gif_media.lzw_encode(stored.tobytes())
    blocks = b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255))
    flags = (0x87 if own else 0) | (0x40 if interlaced else 0)
    extension = b"" if control is None else b"\x21\xf9\x04" + struct.pack("<BHBB", control[0] << 2 | (control[2] is not None), control[1], control[2] or 0, 0)
    return extension + struct.pack("<BHHHHB", 0x2C, left, top, width, height, flags) + own + b"\x08" + blocks + b"\0"


RED, GREEN, BLUE = (255, 0, 0), (0, 255, 0), (0, 0, 255)


def whole(width, height, *images) -> bytes:
    shared = np.array([RED, GREEN, BLUE] + [(0, 0, 0)] * 253, np.uint8).tobytes()
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + shared + b"\x21\xfe\x03abc\0" + b"".join(images) + b"\x3b"


def test_disposal_transparency_palettes_and_times():
    data = whole(
        2, 2,
        image([[0, 0], [0, 0]], control=(1, 5, None)),
        image([[1, 2]], top=1, control=(2, 7, 2)),  # index 2 is clear; its area is emptied afterwards
        image([[2]], control=(3, 0, None), palette=[RED, RED, (9, 9, 9)]),  # own palette; undone afterwards
        image([[1]], left=1, control=(1, 1, None)),
    )
    width, height, frames = gif_media.decode_gif(data)
    assert (width, height) == (2, 2)
    shown = [[[tuple(map(int, p)) for p in row] for row in f.pixels] for f in frames]
    opaque = lambda c: (*c, 255)
    red, none = opaque(RED), (0, 0, 0, 0)
    assert shown[0] == [[red, red], [red, red]]
    assert shown[1] == [[red, red], [opaque(GREEN), red]]
    assert shown[2] == [[opaque((9, 9, 9)), red], [none, none]]
    assert shown[3] == [[red, opaque(GREEN)], [none, none]]
    assert [(f.start_ms, f.duration_ms) for f in frames] == [(0, 50), (50, 70), (120, 0), (120, 10)]


def test_interlaced_rows_and_frames_beyond_the_canvas():
    rows = [[i % 3] * 2 for i in range(11)]
    _, _, (frame,) = gif_media.decode_gif(whole(2, 11, image(rows, interlaced=True)))
    assert frame.samples.tolist() == rows
    _, _, (frame,) = gif_media.decode_gif(whole(2, 2, image([[0] * 5] * 5, left=1, top=1)))
    assert (frame.pixels[..., 3] > 0).tolist() == [[False, False], [False, True]]


def test_frames_table(spark):
    good = whole(2, 1, image([[0, 1]], control=(1, 3, None)), image([[2, 2]]))
    rows = [("a", bytearray(good)), ("b", None), ("c", bytearray(b"GIF89a")), ("d", bytearray(good[:-20])), ("e", bytearray(whole(1, 1)))]
    found = gif_media.gif_frames(spark.createDataFrame(rows, "media_id string, media binary").selectExpr("*", "1 AS frame", "2 AS error")).collect()
    assert [(r.id, r.frame, r.start_ms, r.width, r.error is None) for r in sorted(found, key=lambda r: (r.id, r.frame or 0))] == [
        ("a", 0, 0, 2, True), ("a", 1, 30, 2, True), ("b", None, None, None, False), ("c", None, None, None, False), ("d", None, None, None, False)
    ]
    assert {sum(r.histogram) for r in found if r.id == "a"} == {2}


def test_a_header_of_four_thousand_million_pixels_is_an_error(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    wide = whole(1, 1)[:-1] + struct.pack("<BHHHHB", 0x2C, 0, 0, 65535, 65535, 0) + b"\x08\0\x3b"
    rows = [("a", bytearray(huge)), ("b", bytearray(wide)), ("c", bytearray(whole(1, 1, image([[0]]))))]
    found = {r.id: r for r in gif_media.gif_frames(spark.createDataFrame(rows, "media_id string, media binary")).collect()}
    assert "larger" in found["a"].error and "larger" in found["b"].error and found["c"].error is None


def test_text_media(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 33), (5, LONG), (6, "a"), (6, "a"), (None, "a")]
    found = gif_media.text_media(documents(spark, rows, "media frame payload"))
    assert found.count() == len(rows)
    by = by_id(found)
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        row = by[doc_id]
        assert (row.n_bytes, row.payload_bytes) == (len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
        media = gif_media.encode_gif(gif_media.pictures_of(payload))
        assert (row.media_bytes, row.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        high = gif_media.ROWS * gif_media.WIDTH
        sizes = [min(high, len(payload) - at) for at in range(0, len(payload), high)]
        assert [(f.start_ms, f.duration_ms, sum(f.histogram)) for f in row.frames] == [(40 * i, 40, n) for i, n in enumerate(sizes)]
    assert tuple(by[1])[1:] == tuple(by[2])[1:] and tuple(by[6])[1:] == tuple(by[None])[1:]
    assert gif_media.text_media(documents(spark, [])).count() == 0


def test_feature_describes_all_frames():
    first = b"a" * gif_media.WIDTH * gif_media.ROWS
    features = set()
    for rest in (b" " * 70_000, "é".encode() * 35_000, b"a" * 70_000, b"a" * 65_536 + b" " * 4464):
        feature = gif_media.describe(first + rest)[0][-1]
        features.add(feature)
        payload = first + rest + bytes(-len(first + rest) % 64)
        boxes = np.bincount((np.frombuffer(payload, np.uint8).astype(int) * gif_media.STEPS >> 8) * (gif_media.STEPS**2 + gif_media.STEPS + 1))
        fullest = [i for i in np.argsort(-boxes, kind="stable")[:4] if boxes[i]]
        assert feature.split("/", 3)[3] == ",".join(f"{i}={boxes[i]}" for i in fullest)
    assert len(features) == 4

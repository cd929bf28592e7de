"""PNG files read and written, masks and frames, against pixels made by hand and plain loops."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbox.functions import pictures as p
from lumenbox.operators import rules


def png(raw, width, height, depth, colour, filters, extra=b"", interlace=0):
    """A file of bytes (height, stride), filtered row by row in plain loops."""
    unit = max(1, p.SAMPLES[colour] * depth // 8)
    out = bytearray()
    for y in range(height):
        out.append(filters[y])
        for x in range(len(raw[y])):
            left = int(raw[y][x - unit]) if x >= unit else 0
            up = int(raw[y - 1][x]) if y else 0
            corner = int(raw[y - 1][x - unit]) if y and x >= unit else 0
            guess = left + up - corner
            nearest = min((left, up, corner), key=lambda v: abs(guess - v))
            out.append((int(raw[y][x]) - [0, left, up, (left + up) // 2, nearest][filters[y]]) % 256)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    packed = zlib.compress(bytes(out))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace))
    return p.SIGNATURE + head + extra + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


def on_white(colour, alpha):
    return [(int(c) * int(alpha) + 255 * (255 - int(alpha)) + 127) // 255 for c in colour]


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
@pytest.mark.parametrize("depth", [8, 16])
def test_filters_and_alpha(colour, depth):
    rng = np.random.default_rng(colour + depth)
    w, h, n = 23, 17, p.SAMPLES[colour]
    raw = rng.integers(0, 256, (h, w * n * depth // 8))
    raw[5:9] = raw[4] // 2  # runs that filters follow
    got = p.decode_png(png(raw, w, h, depth, colour, [rng.integers(0, 5) for _ in range(h)]))
    samples = raw[:, :: depth // 8].reshape(h, w, n)
    for y in range(h):
        for x in range(w):
            s = samples[y, x].tolist()
            rgb = s[:3] if n >= 3 else s[:1] * 3
            assert got[y, x].tolist() == (on_white(rgb, s[-1]) if colour in (4, 6) else rgb)


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_palette(depth):
    rng = random.Random(depth)
    w, h = 11, 5
    index = [[rng.randrange(min(3, 1 << depth)) for _ in range(w)] for _ in range(h)]
    bits = ["".join(f"{i:0{depth}b}" for i in row) for row in index]
    raw = [[int(b[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(b), 8)] for b in bits]
    palette, alpha = [(10, 20, 30), (200, 0, 7), (1, 2, 3)], [255, 100]

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    extra = chunk(b"PLTE", bytes(c for x in palette for c in x)) + chunk(b"tRNS", bytes(alpha))
    got = p.decode_png(png(raw, w, h, depth, 3, [0, 1, 2, 3, 4], extra))
    assert got.tolist() == [[on_white(palette[i], [*alpha, 255][i]) for i in row] for row in index]


def test_what_is_no_picture():
    good = png([[1, 2, 3]] * 2, 1, 2, 8, 2, [0, 0])
    assert p.decode_png(good).shape == (2, 1, 3)
    for bad in (None, b"", b"GIF89a", good[:40], good[:-20], png([[1, 2, 3]], 1, 1, 8, 2, [0], interlace=1), png([[0]], 1, 1, 8, 3, [0])):
        assert p.decode_png(bad) is None


def test_round_trip_and_masks(spark):
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    assert (p.decode_png(p.encode_png(rgb)) == rgb).all()
    boxes = [(5.4, 3.6, 38.0, 30.2), (50.0, 35.0, 90.0, 90.0), (7.0, 7.0, 7.2, 9.0)]
    df = spark.createDataFrame([(1, bytearray(p.encode_png(rgb)), boxes), (2, None, boxes), (3, bytearray(b"x"), None)], "id long, content binary, boxes array<struct<x1: double, y1: double, x2: double, y2: double>>")
    for method in ("blur", "pixelate", "solid"):
        masks = F.transform("boxes", lambda b: rules.mask_pixels(b, F.lit(60), F.lit(40), method))
        rows = {r["id"]: r["png"] for r in df.select("id", p.apply_masks("content", masks, method).alias("png")).collect()}
        assert rows[2] is None and rows[3] is None
        got, inside = p.decode_png(bytes(rows[1])), np.zeros((40, 60), bool)
        for x1, y1, x2, y2 in ((5, 4, 38, 30), (50, 35, 60, 40)):
            part, w, h = rgb[y1:y2, x1:x2].astype(int), x2 - x1, y2 - y1
            radius = max(6, w // 8)
            n, m = max(1, w // 12), max(1, h // 12)
            for y in range(h):
                for x in range(w):
                    near = part[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
                    if method == "pixelate":
                        i, j = next(k for k in range(m) if y < (k + 1) * h // m), next(k for k in range(n) if x < (k + 1) * w // n)
                        near = part[i * h // m : (i + 1) * h // m, j * w // n : (j + 1) * w // n]
                    area = near.shape[0] * near.shape[1]
                    want = [0, 0, 0] if method == "solid" else [(2 * int(s) + area) // (2 * area) for s in near.sum(axis=(0, 1))]
                    assert got[y1 + y, x1 + x].tolist() == want
            inside[y1:y2, x1:x2] = True
        assert (got[~inside] == rgb[~inside]).all()


def test_pixels_and_frames(spark):
    rgb = np.full((20, 30, 3), 9, np.uint8)
    df = spark.createDataFrame([(bytearray(p.encode_png(rgb)), [(2.0, 3.0, 20.0, 16.0), (25.0, 1.0, 28.0, 4.0)], ["high", "none"]), (None, None, None)], "content binary, boxes array<struct<x1: double, y1: double, x2: double, y2: double>>, bands array<string>")
    r = [x for x in df.select(p.pixels("content").alias("p"), p.annotate("content", "boxes", "bands").alias("png")).collect() if x["png"] is not None]
    assert len(r) == 1 and (r[0]["p"]["w"], r[0]["p"]["h"], bytes(r[0]["p"]["rgb"])) == (30, 20, rgb.tobytes())
    want = rgb.copy()
    want[3:16, 2:20], want[6:13, 5:17], want[1:4, 25:28] = p.BAND_COLOURS["high"], 9, p.BAND_COLOURS["none"]
    assert (p.decode_png(bytes(r[0]["png"])) == want).all()

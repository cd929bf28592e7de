"""Pictures as arrays of pixels: PNG read and written, alpha flattened on white, regions masked, boxes drawn.

Functions of numpy arrays (height, width, 3) of bytes, and pandas UDFs of them over columns of PNG files. A file that is no
PNG, is cut short, or is interlaced has no pixels: null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: its signature, and the samples of a pixel by colour type
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PIXELS = "struct<w: int, h: int, rgb: binary>"
#: How wide the frame of a drawn box is, and what solid masks are filled with
FRAME, FILL = 3, 0


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += 12 + size


def unfiltered(rows: np.ndarray, filters: np.ndarray, unit: int) -> np.ndarray:
    """The bytes behind the five scanline filters; ``unit`` is how many bytes lie between a byte and its left neighbour.

    A byte needs its left, upper and upper left neighbours. All bytes on a slanted line (one unit further left in
    each row further down) are independent of one another, so each such line is done at once, whatever its rows' filters.
    """
    height, width = rows.shape
    units = -(-width // unit)
    out = np.zeros((height + 1, (units + 1) * unit), np.int32)  # a row of zeros above, a unit of zeros on the left
    out[1:, unit : unit + width] = rows
    out = out.reshape(height + 1, units + 1, unit)
    kind = filters.astype(np.int64)[:, None]
    for step in range(units + height - 1):
        r = np.arange(max(0, step - units + 1), min(height, step + 1))
        c = step - r + 1
        left, up, corner, k = out[r + 1, c - 1], out[r, c], out[r, c - 1], kind[r]
        guess = left + up - corner
        a, b, d = abs(guess - left), abs(guess - up), abs(guess - corner)
        nearest = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
        add = np.select([k == 1, k == 2, k == 3, k == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[r + 1, c] = (out[r + 1, c] + add) & 255
    return out[1:, 1:].reshape(height, units * unit)[:, :width].astype(np.uint8)


def decode_png(content: bytes | None) -> np.ndarray | None:
    """Pixels of a PNG file, on white where it is transparent; 16-bit samples by their upper bytes."""
    if not content or not content.startswith(SIGNATURE):
        return None
    header, palette, alpha, packed = None, None, None, []
    for kind, body in _chunks(content):
        if kind == b"IHDR" and len(body) == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None or header[6] or header[3] not in SAMPLES or not header[0] or not header[1]:
        return None
    width, height, depth, colour = header[:4]
    samples = SAMPLES[colour]
    stride = (width * samples * depth + 7) // 8
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error:
        return None
    if len(flat) < height * (stride + 1) or (colour == 3 and palette is None):
        return None
    lines = flat[: height * (stride + 1)].reshape(height, stride + 1)
    raw = unfiltered(lines[:, 1:], lines[:, 0], max(1, samples * depth // 8))
    if depth == 16:
        raw = raw[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(height, -1, depth)
        raw = bits @ (1 << np.arange(depth - 1, -1, -1))
        raw = raw[:, : width * samples] if colour == 3 else raw[:, : width * samples] * (255 // ((1 << depth) - 1))
    pixels = raw.reshape(height, width, samples).astype(np.int64)
    if colour == 3:
        opacity = np.full(len(palette), 255)
        if alpha is not None:
            opacity[: len(alpha)] = alpha[: len(palette)]
        index = np.minimum(pixels[:, :, 0], len(palette) - 1)
        pixels = np.concatenate([palette[index], opacity[index][:, :, None]], axis=2).astype(np.int64)
    colours = pixels[:, :, :1].repeat(3, axis=2) if samples < 3 and colour != 3 else pixels[:, :, :3]
    if colour in (3, 4, 6):
        a = pixels[:, :, -1:]
        colours = (colours * a + 255 * (255 - a) + 127) // 255
    return colours.astype(np.uint8)


def encode_png(rgb: np.ndarray) -> bytes:
    height, width, _ = rgb.shape
    lines = np.zeros((height, 1 + 3 * width), np.uint8)
    lines[:, 1:] = rgb.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _sums(rgb: np.ndarray) -> np.ndarray:
    """Summed-area table: the sum over rows below i and columns below j at [i, j]."""
    out = np.zeros((rgb.shape[0] + 1, rgb.shape[1] + 1, 3), np.int64)
    out[1:, 1:] = rgb.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    return out


def _means(table: np.ndarray, top: np.ndarray, bottom: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rounded means of the rectangles of each row range with each column range."""
    t, b, x, y = top[:, None], bottom[:, None], left[None, :], right[None, :]
    area = ((b - t) * (y - x))[:, :, None]
    return ((2 * (table[b, y] - table[t, y] - table[b, x] + table[t, x]) + area) // (2 * area)).astype(np.uint8)


def blurred(part: np.ndarray, radius: int) -> np.ndarray:
    """Each pixel the mean of those within ``radius`` each way, as far as the part goes."""
    h, w, _ = part.shape
    rows, columns = np.arange(h), np.arange(w)
    return _means(_sums(part), np.maximum(rows - radius, 0), np.minimum(rows + radius + 1, h), np.maximum(columns - radius, 0), np.minimum(columns + radius + 1, w))


def pixelated(part: np.ndarray, divisor: int = 12) -> np.ndarray:
    """A twelfth as many cells each way, at least one, each in the mean of its pixels."""
    h, w, _ = part.shape
    cells = [np.arange(n + 1) * side // n for side, n in ((h, max(1, h // divisor)), (w, max(1, w // divisor)))]
    small = _means(_sums(part), cells[0][:-1], cells[0][1:], cells[1][:-1], cells[1][1:])
    at = [np.searchsorted(c, np.arange(side), side="right") - 1 for c, side in zip(cells, (h, w), strict=True)]
    return small[at[0][:, None], at[1][None, :]]


def masked(rgb: np.ndarray, masks: list[tuple[int, int, int, int, int]], method: str) -> np.ndarray:
    """The picture with each mask (x1, y1, x2, y2, strength) applied in turn; nothing outside of them changes."""
    out = rgb.copy()
    for x1, y1, x2, y2, strength in masks:
        part = out[max(0, y1) : y2, max(0, x1) : x2]
        if part.size:
            part[:] = blurred(part, strength) if method == "blur" else pixelated(part) if method == "pixelate" else FILL
    return out


def framed(rgb: np.ndarray, boxes: list[tuple[float, float, float, float]], colours: list[tuple[int, int, int]], width: int = FRAME) -> np.ndarray:
    """The picture with the outlines of boxes drawn inside their rounded edges, later ones on top."""
    out = rgb.copy()
    h, w, _ = out.shape
    for (x1, y1, x2, y2), colour in zip(boxes, colours, strict=True):
        a, b, c, d = (int(v) for v in (np.clip(np.rint(x1), 0, w), np.clip(np.rint(y1), 0, h), np.clip(np.rint(x2), 0, w), np.clip(np.rint(y2), 0, h)))
        inner = (slice(b + width, max(b + width, d - width)), slice(a + width, max(a + width, c - width)))
        kept = out[inner].copy()
        out[b:d, a:c] = colour
        out[inner] = kept if kept.size else out[inner]
    return out


def _over_pictures(change: Callable[..., object], kind: str, *columns: Column | str) -> Column:
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame | pd.Series]:
        for batch in batches:
            rows = [change(*row) for row in zip(*batch, strict=True)]
            yield pd.DataFrame(rows, columns=["w", "h", "rgb"]) if kind == PIXELS else pd.Series(rows, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame if kind == PIXELS else pd.Series]}
    return F.pandas_udf(run, kind)(*columns)


def pixels(content: Column | str) -> Column:
    """struct<w, h, rgb> of PNG files; its fields are null where there are no pixels."""

    def one(png: bytes | None) -> tuple:
        rgb = decode_png(png)
        return (None, None, None) if rgb is None else (rgb.shape[1], rgb.shape[0], rgb.tobytes())

    return _over_pictures(lambda png, _: one(png), PIXELS, content, F.lit(0))


def apply_masks(content: Column | str, masks: Column | str, method: str = "blur") -> Column:
    """PNG files with an array of masks (struct<x1, y1, x2, y2, strength>) applied; null masks are passed over."""

    def one(png: bytes | None, rows: object) -> bytes | None:
        rgb = decode_png(png)
        wanted = [tuple(int(m[k]) for k in ("x1", "y1", "x2", "y2", "strength")) for m in (() if rows is None else rows) if m is not None]
        return None if rgb is None else encode_png(masked(rgb, wanted, method))

    return _over_pictures(one, "binary", content, masks)


#: The colours of frames by the band of a confidence
BAND_COLOURS = {"high": (34, 160, 84), "medium": (214, 150, 20), "low": (205, 50, 50), "none": (60, 110, 220)}


def annotate(content: Column | str, boxes: Column | str, bands: Column | str) -> Column:
    """PNG files with an array of boxes drawn, each in the colour of its band."""

    def one(png: bytes | None, places: object, names: object) -> bytes | None:
        rgb = decode_png(png)
        if rgb is None or places is None:
            return None if rgb is None else encode_png(rgb)
        return encode_png(framed(rgb, [tuple(p[k] for k in ("x1", "y1", "x2", "y2")) for p in places], [BAND_COLOURS[n] for n in names]))

    return _over_pictures(one, "binary", content, boxes, bands)


def blank(w: Column | str, h: Column | str) -> Column:
    """White PNG files of the given sizes."""
    return _over_pictures(lambda a, b: None if pd.isna(a) or pd.isna(b) else encode_png(np.full((int(b), int(a), 3), 255, np.uint8)), "binary", w, h)

"""Box and coordinate algebra as Column expressions.

A box is struct<x1, y1, x2, y2: double>; a transform struct<ox, oy, sx, sy: double> maps local pixels to the
original image. A null transform is the identity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"
TRANSFORM = "struct<ox: double, oy: double, sx: double, sy: double>"


def number(value: Column | float | int) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def make_box(x1, y1, x2, y2) -> Column:
    return F.struct(*[number(v).cast("double").alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def make_transform(ox, oy, sx, sy) -> Column:
    return F.struct(*[number(v).cast("double").alias(n) for v, n in ((ox, "ox"), (oy, "oy"), (sx, "sx"), (sy, "sy"))])


def transform_or_identity(tf: Column | None) -> Column:
    identity = make_transform(0, 0, 1, 1)
    return identity if tf is None else F.coalesce(tf, identity)


def to_original(tf: Column, box: Column) -> Column:
    t = transform_or_identity(tf)
    return make_box(t["ox"] + box["x1"] * t["sx"], t["oy"] + box["y1"] * t["sy"], t["ox"] + box["x2"] * t["sx"], t["oy"] + box["y2"] * t["sy"])


def from_original(tf: Column, box: Column) -> Column:
    """Inverse of to_original; a zero scale raises, as division does under ANSI mode."""
    t = transform_or_identity(tf)
    return make_box((box["x1"] - t["ox"]) / t["sx"], (box["y1"] - t["oy"]) / t["sy"], (box["x2"] - t["ox"]) / t["sx"], (box["y2"] - t["oy"]) / t["sy"])


def _scaled(box: Column, x: Column, y: Column) -> Column:
    return make_box(box["x1"] * x, box["y1"] * y, box["x2"] * x, box["y2"] * y)


def model_to_pixels(box: Column, w: Column, h: Column, mode: Column) -> Column:
    """`abs` coordinates stay, `rel1000` ones are thousandths of a side, any other mode is an error."""
    wrong = F.raise_error(F.concat(F.lit("unknown coordinate mode "), mode)).cast(BOX)
    relative = make_box(box["x1"] * w / 1000, box["y1"] * h / 1000, box["x2"] * w / 1000, box["y2"] * h / 1000)
    return F.when(mode == "abs", box).when(mode == "rel1000", relative).otherwise(wrong)


def pixels_to_model(box: Column, w: Column, h: Column, mode: Column) -> Column:
    """Inverse; here any mode but `abs` counts as relative."""
    return F.when(mode == "abs", box).otherwise(make_box(box["x1"] / w * 1000, box["y1"] / h * 1000, box["x2"] / w * 1000, box["y2"] / h * 1000))


def fit_dims(w: Column, h: Column, factor: Column, least: Column, most: Column) -> Column:
    """struct<w, h: int>: sides snapped to multiples of ``factor``, area led into [least, most].

    Growing is not clamped again, so the area may exceed ``most``.
    """
    w, h, factor = w.cast("double"), h.cast("double"), factor.cast("double")
    snap_w, snap_h = (F.greatest(factor, F.rint(side / factor) * factor) for side in (w, h))
    shrink, grow = F.sqrt(w * h / most), F.sqrt(least / (w * h))
    down = [F.greatest(factor, F.floor(side / shrink / factor) * factor) for side in (w, h)]
    up = [F.ceil(side * grow / factor) * factor for side in (w, h)]
    area = snap_w * snap_h
    pick = [F.when(area > most, d).when(area < least, u).otherwise(s).cast("int") for d, u, s in zip(down, up, (snap_w, snap_h), strict=True)]
    return F.struct(pick[0].alias("w"), pick[1].alias("h"))


def prepare(w: Column, h: Column, tf: Column, factor: Column, least: Column, most: Column, upscale_to: Column | None = None) -> Column:
    """struct<w, h, tf> of a view resized to fit; ``upscale_to`` raises the least area, up to ``most``."""
    low = least if upscale_to is None else F.when(F.coalesce(upscale_to, F.lit(0)) > 0, F.greatest(least, F.least(upscale_to, most))).otherwise(least)
    size, t = fit_dims(w, h, factor, low, most), transform_or_identity(tf)
    return F.struct(size["w"].alias("w"), size["h"].alias("h"), make_transform(t["ox"], t["oy"], t["sx"] * w / size["w"], t["sy"] * h / size["h"]).alias("tf"))


def clamp_box(box: Column, w: Column, h: Column) -> Column:
    def axis(a: Column, b: Column, side: Column) -> tuple[Column, Column]:
        side = number(side).cast("double")
        return F.least(F.greatest(F.least(a, b), F.lit(0.0)), side), F.least(F.greatest(F.greatest(a, b), F.lit(0.0)), side)

    (x1, x2), (y1, y2) = axis(box["x1"], box["x2"], w), axis(box["y1"], box["y2"], h)
    return make_box(x1, y1, x2, y2)


def crop(box: Column, w: Column, h: Column, tf: Column) -> Column:
    """struct<w, h, tf> of a crop: clamped, grown to whole pixels, at least one each way."""
    c, t = clamp_box(box, w, h), transform_or_identity(tf)
    x1, y1 = F.floor(c["x1"]), F.floor(c["y1"])
    x2, y2 = F.greatest(F.ceil(c["x2"]), x1 + 1), F.greatest(F.ceil(c["y2"]), y1 + 1)
    return F.struct((x2 - x1).cast("int").alias("w"), (y2 - y1).cast("int").alias("h"), make_transform(t["ox"] + x1 * t["sx"], t["oy"] + y1 * t["sy"], t["sx"], t["sy"]).alias("tf"))


def expand_box(box: Column, w: Column, h: Column, scale=1.0, pad=0.0, min_size=0.0) -> Column:
    """Grown about its centre, then clamped (so it may end up smaller than ``min_size`` at an edge)."""
    cx, cy = (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2
    half_w = F.greatest((box["x2"] - box["x1"]) * number(scale) + number(pad) * 2, number(min_size)) / 2
    half_h = F.greatest((box["y2"] - box["y1"]) * number(scale) + number(pad) * 2, number(min_size)) / 2
    return clamp_box(make_box(cx - half_w, cy - half_h, cx + half_w, cy + half_h), w, h)


def center(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x2"] - box["x1"]) * F.greatest(F.lit(0.0), box["y2"] - box["y1"])


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def coverage(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies in ``outer``; 0 for an empty box."""
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def point_in(x: Column, y: Column, box: Column, tolerance=0.0) -> Column:
    t = number(tolerance)
    return x.between(box["x1"] - t, box["x2"] + t) & y.between(box["y1"] - t, box["y2"] + t)


def rounded(box: Column, digits: int = 1) -> Column:
    return make_box(*[F.bround(box[k], digits) for k in ("x1", "y1", "x2", "y2")])


def tile_grid(w: Column, h: Column, cols: Column, rows: Column, overlap: float = 0.15) -> Column:
    """array<struct<r, c: int, region: box>>: overlapping tiles, row by row."""
    tw, th = w.cast("double") / cols, h.cast("double") / rows

    def cell(i: Column) -> Column:
        r, c = F.floor(i / cols), i % cols
        region = make_box(c * tw - tw * overlap, r * th - th * overlap, (c + 1) * tw + tw * overlap, (r + 1) * th + th * overlap)
        return F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), clamp_box(region, w, h).alias("region"))

    return F.transform(F.sequence(F.lit(0), (cols * rows - 1).cast("int")), cell)

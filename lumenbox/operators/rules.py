"""Decision rules of grounding, over candidates as rows. Null confidence means that the verifier abstained."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


@dataclass(frozen=True)
class GroundConfig:
    """Thresholds of the grounding rules."""

    zoom_scale: float = 3.0
    zoom_pad: float = 24.0
    zoom_min_size: float = 160.0
    zoom_skip_area_frac: float = 0.30
    refine_containment: float = 0.55
    verify: bool = True
    accept_threshold: float = 0.55
    max_new_tokens: int = 160


def accepted(found: Column, confidence: Column, threshold: float = 0.55) -> Column:
    """A hit counts if it is not doubted: no confidence at all, or enough of it."""
    return F.coalesce(found, F.lit(False)) & (confidence.isNull() | (confidence >= threshold))


def too_big(box: Column, w: Column, h: Column, fraction: float = 0.30) -> Column:
    return g.area(box) > w * h * fraction


def refine_accepts(candidate: Column, region: Column, containment: float = 0.55) -> Column:
    """Inside the crop it was asked about, and not the whole of it."""
    return (g.coverage(candidate, region) >= containment) & (g.area(candidate) / F.greatest(F.lit(1.0), g.area(region)) < 0.9)


def on_view(items: DataFrame, w: str = "w", h: str = "h", tf: str = "tf", mode: str = "mode") -> DataFrame:
    """Parsed ``items`` exploded, in pixels of the view, clamped; empty ones dropped unless points; box in original space."""
    # the optimizer filters by the size of a column that is exploded, which would parse each answer twice: so no column alone
    told = F.coalesce(F.col("items"), F.array().cast(items.schema["items"].dataType))
    return placed_on_view(items.select("*", F.posexplode(told).alias("pos", "item")).drop("items"), w, h, tf, mode)


def placed_on_view(rows: DataFrame, w: str = "w", h: str = "h", tf: str = "tf", mode: str = "mode") -> DataFrame:
    """on_view() of rows with an ``item`` each."""
    # corners in pixels are columns of their own, so that generated code stays small enough to be compiled
    pixels = g.model_to_pixels(F.col("item.box"), F.col(w), F.col(h), F.col(mode))
    rows = rows.withColumns({f"_{k}": F.least(F.greatest(pixels[k], F.lit(0.0)), F.col(h if k[0] == "y" else w).cast("double")) for k in ("x1", "y1", "x2", "y2")})
    low_high = [f(F.col(f"_{axis}1"), F.col(f"_{axis}2")) for f in (F.least, F.greatest) for axis in "xy"]
    wide = (F.col("_x1") != F.col("_x2")) & (F.col("_y1") != F.col("_y2"))
    rows = rows.where(wide | F.coalesce(F.col("item.point"), F.lit(False))).withColumn("view_box", g.make_box(*low_high))
    return rows.drop("_x1", "_y1", "_x2", "_y2").withColumn("box", g.to_original(F.col(tf), F.col("view_box")))


def first_accepted(candidates: DataFrame, keys: list[str], position: str, condition: Column, value: str) -> DataFrame:
    """Of each key the first candidate, by position, that meets the condition; no row where none does."""
    return candidates.where(condition).groupBy(*keys).agg(F.min_by(value, position).alias(value), F.min(position).alias(position))


def best_tile(candidates: DataFrame, keys: list[str], position: str = "pos", confidence: str = "confidence") -> DataFrame:
    """The tile candidate that wins a strict scan in order of position.

    The score is the confidence, or -1 without one. An incumbent of confidence 0 defends with -1, so a later
    candidate of confidence 0 replaces it.
    """
    queue = F.sort_array(F.collect_list(F.struct(position, confidence)))
    start = F.struct(F.lit(None).cast("long").alias("pos"), F.lit(None).cast("double").alias("confidence"))

    def meet(best: Column, x: Column) -> Column:
        defence = F.when(F.coalesce(best["confidence"], F.lit(0.0)) == 0, -1.0).otherwise(best["confidence"])
        wins = best["pos"].isNull() | (F.coalesce(x[confidence], F.lit(-1.0)) > defence)
        return F.when(wins, F.struct(x[position].cast("long").alias("pos"), x[confidence].cast("double").alias("confidence"))).otherwise(best)

    won = candidates.groupBy(*keys).agg(F.aggregate(queue, start, meet).alias("best"))  # a screen's tiles: a bounded few
    return won.select(*keys, F.col("best.pos").alias(position), F.col("best.confidence").alias(confidence))


def locate_choice(has_hit: Column, hit_confidence: Column, has_tile: Column, tile_confidence: Column, threshold: float = 0.55) -> Column:
    """'tile' if the first hit is missing or weak and the tile hit beats it, else 'hit' or null."""
    weak = ~has_hit | (hit_confidence.isNotNull() & (hit_confidence < threshold))
    beats = ~has_hit | (F.coalesce(tile_confidence, F.lit(0.0)) > F.coalesce(hit_confidence, F.lit(0.0)))
    return F.when(weak & has_tile & beats, "tile").when(has_hit, "hit")


def groundable(target: Column) -> Column:
    return target.isNotNull() & ~F.lower(target).isin("null", "none", "")


def resolved(target: Column, found: Column, confidence: Column, threshold: float = 0.55) -> Column:
    """True, false, or null where a step has nothing to ground."""
    return F.when(groundable(target), accepted(found, confidence, threshold))


def diff_side(canvas_box: Column, right_x0: Column, after_w: Column, after_h: Column) -> Column:
    """struct<side, box>: boxes right of ``right_x0`` are shifted and clamped to the second picture."""
    left = (canvas_box["x1"] + canvas_box["x2"]) / 2 < right_x0
    moved = g.make_box(canvas_box["x1"] - right_x0, canvas_box["y1"], canvas_box["x2"] - right_x0, canvas_box["y2"])
    return F.struct(F.when(left, "left").otherwise("right").alias("side"), F.when(left, canvas_box).otherwise(g.clamp_box(moved, after_w, after_h)).alias("box"))


def redact_kept(confidence: Column, threshold: float = 0.55) -> Column:
    return confidence.isNull() | (confidence >= threshold)


def mask_pixels(box: Column, w: Column, h: Column, method: str = "blur") -> Column:
    """struct<x1, y1, x2, y2, strength: int> of a mask in whole pixels, null where it is empty."""
    b = g.clamp_box(box, w, h)
    x1, y1, x2, y2 = (F.rint(b[k]).cast("int") for k in ("x1", "y1", "x2", "y2"))
    strength = {"blur": F.greatest(F.lit(6), F.floor((x2 - x1) / 8).cast("int")), "pixelate": F.greatest(F.lit(1), F.floor((x2 - x1) / 12).cast("int"))}.get(method, F.lit(0))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), strength.alias("strength")))


def hit_dict(box: Column, confidence: Column) -> Column:
    """Rounded box, click point at its centre, rounded confidence."""
    c = g.center(box)
    return F.struct(g.rounded(box).alias("box"), F.struct(F.bround(c["x"], 1).alias("x"), F.bround(c["y"], 1).alias("y")).alias("click"), F.bround(confidence, 4).alias("confidence"))

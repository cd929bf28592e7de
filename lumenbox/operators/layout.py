"""Order-dependent operators over the boxes of a screen: reading order and greedy de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g


def reading_order(items: DataFrame, screen: str = "screen_id", order: str = "ord", box: str = "box", carry: Sequence[str] = ()) -> DataFrame:
    """(screen, order, row, position, and the columns in ``carry``): rows top down, then left to right.

    Items sorted by vertical centre join the last row while their centre lies within half the upper-median
    height of the row's first item; rows are sorted by left edge. Both sorts are stable in ``order``. The
    items of one screen are folded in one array: a screen is bounded by what fits on it.
    """
    b = F.col(box)
    each = F.struct(((b["y1"] + b["y2"]) / 2).alias("cy"), F.col(order).cast("long").alias("k"), b["x1"].alias("x1"), F.greatest(F.lit(1.0), b["y2"] - b["y1"]).alias("high"))
    # what is carried need not have an order: items are sorted with their place in the list alone
    lists = items.groupBy(screen).agg(F.collect_list(F.struct(each.alias("by"), F.struct(*carry).alias("with")) if carry else each).alias("listed"))
    if carry:
        by = F.transform("listed", lambda x, i: F.struct(*[x["by"][c].alias(c) for c in ("cy", "k", "x1", "high")], i.alias("at")))
        screens = lists.select(screen, F.sort_array(by).alias("items"), F.transform("listed", lambda x: x["with"]).alias("with"))
    else:
        screens = lists.select(screen, F.sort_array("listed").alias("items"))
    at = ["at"] if carry else []
    heights = F.array_sort(F.transform("items", lambda i: i["high"]))
    tolerance = F.element_at(heights, (F.floor(F.size("items") / 2) + 1).cast("int")) * 0.5
    # the fold keeps the place and centre of each row's first item alone
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("anchor"), F.array().cast("array<int>").alias("starts"))

    def place(state: Column, item: Column) -> Column:
        opens = (state["i"] == 0) | (F.abs(item["cy"] - state["anchor"]) > F.col("tolerance"))
        return F.struct(
            (state["i"] + 1).alias("i"), F.when(opens, item["cy"]).otherwise(state["anchor"]).alias("anchor"),
            F.when(opens, F.array_append(state["starts"], state["i"])).otherwise(state["starts"]).alias("starts"),
        )

    folded = screens.withColumn("tolerance", tolerance).withColumn("starts", F.aggregate("items", start, place, lambda s: s["starts"]))

    def row(start: Column, r: Column) -> Column:
        end = F.coalesce(F.get("starts", r + 1), F.size("items"))
        across = F.array_sort(F.transform(F.slice("items", start + 1, end - start), lambda i: F.struct(*[i[c].alias(c) for c in ("x1", "cy", "k", *at)])))
        held = {"with": lambda i: F.get("with", i["at"])} if carry else {}
        return F.transform(across, lambda i: F.struct(r.alias("row"), i["k"].alias("k"), *[f(i).alias(c) for c, f in held.items()]))

    placed = folded.select(screen, F.posexplode(F.flatten(F.transform("starts", row))).alias("position", "i"))
    return placed.select(screen, F.col("i.k").alias(order), F.col("i.row").alias("row"), "position", *[F.col("i.with")[c].alias(c) for c in carry])


#: Sides of a grid's cells, as multiples of the mean sides of a screen's boxes
CELL = 2.0


def in_cells(items: DataFrame, screen: str = "screen_id", box: str = "box") -> DataFrame:
    """``items`` once for each cell of their screen's grid that their box reaches into, with `_cell` and `_home`.

    Cells follow the mean size of a screen's boxes, so that rows grow with the number of boxes however dense the
    screen is. `_home` marks one row of each item; an item without a box has that row alone, in no cell.
    """
    b, w = F.col(box), Window.partitionBy(screen)
    sides = {f"_{s}": F.greatest(F.lit(1.0), F.avg(F.abs(b[f"{s}2"] - b[f"{s}1"])).over(w)) * CELL for s in "xy"}

    def cells(s: str) -> Column:
        ends = [F.floor(f(b[f"{s}1"], b[f"{s}2"]) / F.col(f"_{s}")) for f in (F.least, F.greatest)]
        return F.sequence(*ends)

    out = items.withColumns(sides).withColumn("_first", F.struct(F.get(cells("x"), F.lit(0)).alias("x"), F.get(cells("y"), F.lit(0)).alias("y")))
    out = out.withColumn("_cx", F.explode_outer(cells("x"))).withColumn("_cy", F.explode_outer(cells("y")))
    cell = F.struct(F.col("_cx").alias("x"), F.col("_cy").alias("y"))
    return out.withColumn("_cell", cell).withColumn("_home", F.col("_cell").eqNullSafe(F.col("_first"))).drop("_cx", "_cy", "_first")


def meets_in_cell(a: Column, b: Column) -> Column:
    """Whether two boxes overlap, and the corner of their overlap lies in this row's cell: true in one cell of each such pair."""
    touch = (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])
    corner = [F.floor(F.greatest(a[f"{s}1"], b[f"{s}1"]) / F.col(f"_{s}")) == F.col("_cell")[s] for s in "xy"]
    return touch & corner[0] & corner[1]


def dedupe_text(lines: DataFrame, screen: str = "screen_id", order: str = "ord", box: str = "box", text: str = "text", threshold: float = 0.6, same_text: float = 0.2) -> DataFrame:
    """Rows of ``lines`` that greedy suppression keeps: longer texts first, then by ``order``.

    A line goes if its overlap with a kept line is above ``threshold``, or above ``same_text`` where both
    say the same. A line meets the lines ahead of it in the cells of a grid; each screen then folds its
    few conflicting lines, the others are kept at once. All of it happens behind one exchange by screen. A null
    text has no length and comes last; a line without a box meets none and is kept.
    """
    length = F.coalesce(F.length(text), F.lit(0))
    placed = in_cells(lines, screen, box).withColumn("_rank", -length)
    before = Window.partitionBy(screen, "_cell").orderBy("_rank", order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.collect_list(F.struct(F.col(order).alias("k"), F.col(box).alias("box"), F.col(text).alias("text"))).over(before)

    def clash(other: Column) -> Column:
        overlap = g.iou(F.col(box), other["box"])
        same = (F.col(text) != "") & (F.col(text) == other["text"]) & (overlap > same_text)
        return meets_in_cell(F.col(box), other["box"]) & ((overlap > threshold) | F.coalesce(same, F.lit(False)))

    met = placed.withColumn("_before", F.transform(F.filter(ahead, clash), lambda o: o["k"]))
    conflict = F.when(F.size("_before") > 0, F.struct(F.col("_rank").alias("rank"), F.col(order).alias("k"), F.col("_before").alias("before")))
    screens = met.groupBy(screen).agg(F.sort_array(F.collect_list(conflict)).alias("queue"), F.collect_list(F.when(F.col("_home"), F.struct(*lines.columns))).alias("rows"))
    # a line without a conflict ahead of it is kept: only dropped lines need to be remembered
    none = F.array().cast(f"array<{lines.schema[order].dataType.simpleString()}>")
    dropped = F.aggregate("queue", none, lambda gone, x: F.when(F.size(F.array_except(x["before"], gone)) > 0, F.array_append(gone, x["k"])).otherwise(gone))
    kept = screens.withColumn("gone", dropped).select(F.inline(F.filter("rows", lambda r: ~F.array_contains(F.col("gone"), r[order]))))
    return kept

"""Synthetic screens: element boxes and texts from a seed, laid out by a declared width model.

Text widths are modelled (a fixed share of the font size for each letter), so layouts do not depend on fonts.
Choices come from hashes of (seed, place), so every screen is made on its own, in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Vocabularies, themes and scales
NOUNS = ["Report", "Invoice", "Budget", "Roadmap", "Notes", "Contract", "Summary", "Backup", "Archive", "Draft", "Proposal", "Minutes"]
MENUS = ["File", "Edit", "View", "Insert", "Format", "Tools", "Window", "Help"]
ACTIONS = ["Save", "Cancel", "Export", "Delete", "Share", "Rename", "Duplicate", "Publish", "Archive", "Upload", "Refresh", "Settings"]
SIDEBAR = ["Inbox", "Starred", "Drafts", "Sent", "Archive", "Trash", "Spam", "All files"]
TABS = ["Overview", "Details", "History", "Comments", "Sharing"]
FIELDS = ["Title", "Owner", "Due date", "Tags", "Description"]
THEMES = ["light", "dark"]
SCALES = (1.0, 0.75, 0.55)
LETTER = 0.56  # width of a letter as a share of the font size

ELEMENT = "struct<box: struct<x1: double, y1: double, x2: double, y2: double>, role: string, text: string, theme_role: string, height: int>"


def _draw(seed: Column, what: str, n: int) -> Column:
    """A number below n."""
    return F.pmod(F.xxhash64(seed, F.lit(what)), F.lit(n)).cast("int")


def _sample(seed: Column, what: str, names: list[str], low: int, high: int) -> Column:
    """Between low and high different names, in an order of their own."""
    keyed = F.array(*[F.struct(F.xxhash64(seed, F.lit(what), F.lit(n)).alias("h"), F.lit(n).alias("n")) for n in names])
    return F.slice(F.transform(F.array_sort(keyed), lambda e: e["n"]), F.lit(1), low + _draw(seed, what + "#", high - low + 1))


def _px(v: float, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(scale * v).cast("int"))


def _row(names: Column, x: Column, gap: Column, size: Column) -> Column:
    """array<struct<n, x, w>>: names side by side, each ``gap`` behind the one before."""
    start = F.struct(x.cast("double").alias("x"), F.array().cast("array<struct<n: string, x: double, w: double>>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        w = F.rint(F.length(n) * size * LETTER).cast("double")
        return F.struct((s["x"] + w + gap).alias("x"), F.array_append(s["out"], F.struct(n.alias("n"), s["x"].alias("x"), w.alias("w"))).alias("out"))

    return F.aggregate(names, start, step, lambda s: s["out"])


def _element(x1, y1, x2, y2, role: str, text: Column, theme_role: Column, height: Column) -> Column:
    box = F.struct(*[v.cast("double").alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])
    return F.struct(box.alias("box"), F.lit(role).alias("role"), text.alias("text"), theme_role.alias("theme_role"), height.cast("int").alias("height"))


def screens(spark: SparkSession, n: int, width: int = 1280, height: int = 800, seed0: int = 1000) -> DataFrame:
    """(id, seed, theme, scale, size, title, all_elements, ground_truth): n screens, one seed and scale after another.

    ground_truth holds the elements whose description is unique on their screen.
    """
    scale = F.element_at(F.array(*[F.lit(s) for s in SCALES]), (F.col("id") % len(SCALES) + 1).cast("int"))
    base = spark.range(n).withColumn("seed", F.col("id") + seed0).withColumn("scale", scale)
    seed, s, plain, zero = F.col("seed"), F.col("scale"), F.lit("plain"), F.lit(0)
    bar, side = _px(30, s), _px(200, s)
    pad = _px(6, s)
    menus = F.transform(_row(_sample(seed, "menu", MENUS, 4, 6), _px(16, s), _px(22, s), _px(13, s)), lambda m: _element(m["x"] - pad, zero, m["x"] + m["w"] + pad, bar, "menu", m["n"], plain, bar))
    rows = F.transform(
        _sample(seed, "side", SIDEBAR, 4, 6),
        lambda name, i: _element(_px(10, s), bar + _px(20, s) + i * _px(38, s), side - _px(10, s), bar + _px(20, s) + i * _px(38, s) + _px(30, s), "nav_item", name, plain, _px(30, s)),
    )
    tx, ty = side + _px(32, s), bar + _px(28, s)
    y_tabs = ty + _px(44, s)
    tabs = F.transform(
        _row(_sample(seed, "tab", TABS, 2, 4), tx, _px(28, s), _px(14, s)),
        lambda m: _element(m["x"] - _px(8, s), y_tabs - _px(6, s), m["x"] + m["w"] + _px(8, s), y_tabs + _px(24, s), "tab", m["n"], plain, _px(30, s)),
    )
    y_field = y_tabs + _px(52, s) + _px(18, s)
    fields = F.transform(
        _sample(seed, "field", FIELDS, 2, 3),
        lambda name, i: _element(tx, y_field + i * _px(66, s), tx + _px(340, s), y_field + i * _px(66, s) + _px(30, s), "field", name, plain, _px(30, s)),
    )
    by, right = F.lit(height) - _px(56, s), F.lit(width) - _px(32, s)
    buttons = F.transform(
        _row(_sample(seed, "button", ACTIONS, 2, 4), F.lit(0), _px(12, s) + _px(34, s), _px(14, s)),  # distances from the right edge
        lambda m, i: _element(
            right - m["x"] - m["w"] - _px(34, s), by, right - m["x"], by + _px(34, s), "button", m["n"],
            F.when(i == 0, "primary").when(m["n"] == "Delete", "danger").otherwise("secondary"), _px(34, s),
        ),
    )
    made = base.select(
        "id", "seed", F.element_at(F.array(*[F.lit(x) for x in THEMES]), _draw(seed, "theme", 2) + 1).alias("theme"), "scale",
        F.array(F.lit(width), F.lit(height)).alias("size"),
        F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in NOUNS]), _draw(seed, "noun", len(NOUNS)) + 1), (2020 + _draw(seed, "year", 7)).cast("string")).alias("title"),
        F.concat(menus, rows, tabs, fields, buttons).alias("all_elements"),
    )
    described = made.withColumn("all_elements", F.transform("all_elements", lambda e: e.withField("box_kind", t.box_kind(e["role"])).withField("descriptor", t.descriptor(e["role"], e["text"], e["theme_role"]))))
    names = F.transform("all_elements", lambda e: e["descriptor"])
    once = F.filter("all_elements", lambda e: F.size(F.filter(F.col("names"), lambda x: x == e["descriptor"])) == 1)
    return described.withColumn("names", names).withColumn("ground_truth", once).drop("names")


def elements(built: DataFrame, column: str = "ground_truth") -> DataFrame:
    """One row for each element: (screen_id, ord, theme, scale, box, role, text, theme_role, height, box_kind, descriptor)."""
    return built.select(F.col("id").alias("screen_id"), "theme", "scale", F.posexplode(column).alias("ord", "e")).select("screen_id", "ord", "theme", "scale", "e.*")

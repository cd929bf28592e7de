"""Queries over the adapters, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import parsing, text
from ..operators import audit, containment, datagen, inference, layout, metrics, planning, report, rules, tasks
from ..sources import registry
from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
W, H = 360, 210  # canvas of the box adapter


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _flat(box: Column, prefix: str = "") -> list[Column]:
    return [box[k].alias(prefix + k) for k in ("x1", "y1", "x2", "y2")]


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)


# ---- box and coordinate algebra -------------------------------------------------------------------------------
_TF = "(p % 7) * 10 AS ox, (s % 5) * 4 AS oy, CAST(1 + n % 3 AS DOUBLE) / 2 AS sx, CAST(1 + s % 4 AS DOUBLE) / 4 AS sy"


def _tf() -> Column:
    return g.make_transform(F.col("p") % 7 * 10, F.col("s") % 5 * 4, (1 + F.col("n") % 3).cast("double") / 2, (1 + F.col("s") % 4).cast("double") / 4)


@query(_with(a.BOXES) + f" SELECT screen_id, ord, ox + x1 * sx AS x1, oy + y1 * sy AS y1, ox + x2 * sx AS x2, oy + y2 * sy AS y2 FROM (SELECT *, {_TF} FROM boxes)")
def b01_to_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.boxes(spark, sf_dir).select("screen_id", "ord", *_flat(g.to_original(_tf(), F.col("box"))))


@query(_with(a.BOXES) + f" SELECT screen_id, ord, (x1 - ox) / sx AS x1, (y1 - oy) / sy AS y1, (x2 - ox) / sx AS x2, (y2 - oy) / sy AS y2 FROM (SELECT *, {_TF} FROM boxes)")
def b02_from_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.boxes(spark, sf_dir).select("screen_id", "ord", *_flat(g.from_original(_tf(), F.col("box"))))


def _modes(absolute: str, relative: str) -> str:
    return ", ".join(f"CASE WHEN p % 2 = 0 THEN {k} ELSE {relative.format(k=k, side=side)} END AS {absolute}{k}" for k, side in (("x1", W), ("y1", H), ("x2", W), ("y2", H)))


@query(_with(a.BOXES) + f" SELECT screen_id, ord, {_modes('px_', '{k} * {side} / 1000')}, {_modes('model_', '{k} / {side} * 1000')} FROM boxes")
def b03_coordinate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("p") % 2 == 0, "abs").otherwise("rel1000")
    px, model = (f(F.col("box"), F.lit(W), F.lit(H), mode) for f in (g.model_to_pixels, g.pixels_to_model))
    return a.boxes(spark, sf_dir).select("screen_id", "ord", *_flat(px, "px_"), *_flat(model, "model_"))


_FIT = """, sizes AS (SELECT screen_id, ord, CAST(40 + p * 13 % 3000 AS DOUBLE) AS w, CAST(30 + s * 17 % 2000 AS DOUBLE) AS h FROM boxes),
snapped AS (SELECT *, greatest(28, round_even(w / 28, 0) * 28) AS sw, greatest(28, round_even(h / 28, 0) * 28) AS sh, sqrt(w * h / 1003520) AS shrink, sqrt(200704 / (w * h)) AS grow, sqrt(600000 / (w * h)) AS more FROM sizes),
fitted AS (SELECT *, CAST(CASE WHEN sw * sh > 1003520 THEN greatest(28, floor(w / shrink / 28) * 28) WHEN sw * sh < 200704 THEN ceil(w * grow / 28) * 28 ELSE sw END AS INTEGER) AS fw,
           CAST(CASE WHEN sw * sh > 1003520 THEN greatest(28, floor(h / shrink / 28) * 28) WHEN sw * sh < 200704 THEN ceil(h * grow / 28) * 28 ELSE sh END AS INTEGER) AS fh,
           CAST(CASE WHEN sw * sh > 1003520 THEN greatest(28, floor(w / shrink / 28) * 28) WHEN sw * sh < 600000 THEN ceil(w * more / 28) * 28 ELSE sw END AS INTEGER) AS uw,
           CAST(CASE WHEN sw * sh > 1003520 THEN greatest(28, floor(h / shrink / 28) * 28) WHEN sw * sh < 600000 THEN ceil(h * more / 28) * 28 ELSE sh END AS INTEGER) AS uh FROM snapped)"""


@query(_with(a.BOXES) + _FIT + " SELECT screen_id, ord, fw, fh, w / fw AS sx, h / fh AS sy, uw, uh, w / uw AS usx FROM fitted")
def b06_fit_and_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (40 + F.col("p") * 13 % 3000).cast("double"), (30 + F.col("s") * 17 % 2000).cast("double")
    view = g.prepare(w, h, F.lit(None).cast(g.TRANSFORM), F.lit(28), F.lit(200704), F.lit(1003520))
    larger = g.prepare(w, h, F.lit(None).cast(g.TRANSFORM), F.lit(28), F.lit(200704), F.lit(1003520), F.lit(600000))
    views = a.boxes(spark, sf_dir).withColumn("v", view).withColumn("u", larger)
    return views.select("screen_id", "ord", F.col("v.w").alias("fw"), F.col("v.h").alias("fh"), F.col("v.tf.sx").alias("sx"), F.col("v.tf.sy").alias("sy"), F.col("u.w").alias("uw"), F.col("u.h").alias("uh"), F.col("u.tf.sx").alias("usx"))


@query(
    _with(a.BOXES)
    + """, cut AS (SELECT screen_id, ord, floor(least(x1 * 0.9, 200)) AS cx, floor(least(y1 * 0.9, 100)) AS cy,
        greatest(ceil(least(x2 * 0.9, 200)), floor(least(x1 * 0.9, 200)) + 1) AS dx, greatest(ceil(least(y2 * 0.9, 100)), floor(least(y1 * 0.9, 100)) + 1) AS dy FROM boxes)
    SELECT screen_id, ord, CAST(dx - cx AS INTEGER) AS w, CAST(dy - cy AS INTEGER) AS h, 5 + cx * 2 AS ox, 7 + cy * 2 AS oy FROM cut"""
)
def b08_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    smaller = g.make_box(b["x1"] * 0.9, b["y1"] * 0.9, b["x2"] * 0.9, b["y2"] * 0.9)
    c = g.crop(smaller, F.lit(200), F.lit(100), g.make_transform(5, 7, 2, 2))
    return a.boxes(spark, sf_dir).withColumn("c", c).select("screen_id", "ord", "c.w", "c.h", F.col("c.tf.ox").alias("ox"), F.col("c.tf.oy").alias("oy"))


@query(
    _with(a.BOXES)
    + f""", grown AS (SELECT screen_id, ord, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest((x2 - x1) * 1.6 + 24, 96) / 2 AS hw, greatest((y2 - y1) * 1.6 + 24, 96) / 2 AS hh FROM boxes)
    SELECT screen_id, ord, least(greatest(cx - hw, 0), {W}) AS x1, least(greatest(cy - hh, 0), {H}) AS y1, least(greatest(cx + hw, 0), {W}) AS x2, least(greatest(cy + hh, 0), {H}) AS y2 FROM grown"""
)
def b10_expand_and_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.boxes(spark, sf_dir).select("screen_id", "ord", *_flat(g.expand_box(F.col("box"), F.lit(W), F.lit(H), 1.6, 12.0, 96.0)))


_PAIRS = """, pairs AS (SELECT * FROM (SELECT screen_id, ord, x1 AS ax1, y1 AS ay1, x2 AS ax2, y2 AS ay2, lead(x1) OVER n AS bx1, lead(y1) OVER n AS by1, lead(x2) OVER n AS bx2, lead(y2) OVER n AS by2
  FROM boxes WINDOW n AS (PARTITION BY screen_id ORDER BY ord)) WHERE bx1 IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box with the next one of its screen."""
    after = F.lead("box").over(Window.partitionBy("screen_id").orderBy("ord"))
    return a.boxes(spark, sf_dir).select("screen_id", "ord", "box", after.alias("other")).where("other IS NOT NULL")



@query(
    _with(a.BOXES)
    + _PAIRS
    + """, m AS (SELECT *, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS inter, (ax2 - ax1) * (ay2 - ay1) AS aa, (bx2 - bx1) * (by2 - by1) AS ba FROM pairs)
    SELECT screen_id, ord, aa AS area, inter / (aa + ba - inter) AS iou, inter / aa AS coverage, (ax1 + ax2) / 2 AS cx, (ay1 + ay2) / 2 AS cy,
           (ax1 + ax2) / 2 BETWEEN bx1 - 2 AND bx2 + 2 AND (ay1 + ay2) / 2 BETWEEN by1 - 2 AND by2 + 2 AS inside FROM m"""
)
def b13_pair_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, centre, overlap, coverage and containment of neighbours in order."""
    x, y = F.col("box"), F.col("other")
    c = g.center(x)
    return _pairs(spark, sf_dir).select("screen_id", "ord", g.area(x).alias("area"), g.iou(x, y).alias("iou"), g.coverage(x, y).alias("coverage"), c["x"].alias("cx"), c["y"].alias("cy"), g.point_in(c["x"], c["y"], y, 2.0).alias("inside"))


@query(
    _with(a.BOXES)
    + """ SELECT screen_id, ord, round_even(x1 + 0.25, 1) AS x1, round_even((x1 + x2) / 2 + 0.25, 1) AS click_x, round_even((y1 + y2) / 2, 1) AS click_y, round_even(p / 7000, 4) AS confidence FROM boxes"""
)
def b16_hit_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    moved = g.make_box(b["x1"] + 0.25, b["y1"], b["x2"] + 0.25, b["y2"])
    return a.boxes(spark, sf_dir).withColumn("h", rules.hit_dict(moved, F.col("p") / 7000)).select("screen_id", "ord", F.col("h.box.x1").alias("x1"), F.col("h.click.x").alias("click_x"), F.col("h.click.y").alias("click_y"), F.col("h.confidence").alias("confidence"))


@query(
    """WITH s AS (SELECT vec_id, CAST(300 + vec_id % 900 AS DOUBLE) AS w, CAST(200 + vec_id % 700 AS DOUBLE) AS h FROM embeddings), t AS (SELECT *, unnest(range(6)) AS i FROM s)
    SELECT vec_id, CAST(i // 3 AS INTEGER) AS r, CAST(i % 3 AS INTEGER) AS c, greatest(0, (i % 3) * (w / 3) - w / 3 * 0.15::DOUBLE) AS x1, greatest(0, (i // 3) * (h / 2) - h / 2 * 0.15::DOUBLE) AS y1,
           least(w, (i % 3 + 1) * (w / 3) + w / 3 * 0.15::DOUBLE) AS x2, least(h, (i // 3 + 1) * (h / 2) + h / 2 * 0.15::DOUBLE) AS y2 FROM t"""
)
def b17_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "embeddings").select("vec_id", (300 + F.col("vec_id") % 900).cast("double").alias("w"), (200 + F.col("vec_id") % 700).cast("double").alias("h"))
    tiles = e.select("vec_id", F.explode(g.tile_grid(F.col("w"), F.col("h"), F.lit(3), F.lit(2))).alias("t"))
    return tiles.select("vec_id", "t.r", "t.c", *_flat(F.col("t.region")))


# ---- text to structure ----------------------------------------------------------------------------------------
@query(_with(a.ANSWERS) + " SELECT screen_id, ord, pos, x1, y1, x2, y2, label, text, point FROM items")
def t06_parse_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of answers in eight shapes."""
    items = a.answers(spark, sf_dir).select("screen_id", "ord", F.posexplode(parsing.parse_boxes("answer")).alias("pos", "i"))
    return items.select("screen_id", "ord", "pos", *_flat(F.col("i.box")), "i.label", "i.text", "i.point")


@query(_with(a.ANSWERS) + r" SELECT screen_id, ord, list_filter(regexp_extract_all(answer, '\{[^{}]*\}'), lambda x: json_valid(x)) AS objects FROM answers")
def t02_salvage_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.answers(spark, sf_dir).select("screen_id", "ord", text.salvage_objects(F.col("answer")).alias("objects"))


@query(
    r"""WITH f AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations),
    m AS (SELECT conv_id, turn, regexp_matches(t, '(^|[^\p{L}\p{N}_])(yes|true|correct|no est|les?)([^\p{L}\p{N}_]|$)') AS y0,
                 regexp_matches(t, '(^|[^\p{L}\p{N}_])(yes|true|correct)([^\p{L}\p{N}_]|$)') AS y, regexp_matches(t, '(^|[^\p{L}\p{N}_])(no|false|incorrect)([^\p{L}\p{N}_]|$)') AS n FROM f)
    SELECT conv_id, turn, CASE WHEN y <> n THEN y END AS answer, CASE WHEN y <> n THEN CASE WHEN y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS p_yes FROM m"""
)
def t07_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", text.parse_yes_no(F.col("text")).alias("answer"), text.yes_probability(F.col("text")).alias("p_yes"))


@query(
    _with(a.BOXES)
    + r""", said AS (SELECT screen_id, ord, CASE ord % 3 WHEN 0 THEN 'Plan:' || chr(10) || '1. Open ' || text || chr(10) || ' 2) Then ' || text || '  ' || chr(10) WHEN 1 THEN '- Click ' || text ELSE text END AS answer FROM boxes)
    SELECT screen_id, ord, list_transform(list_filter(string_split(answer, chr(10)), lambda l: regexp_matches(l, '^\s*(\d+[.)]|[-*])\s+.*\S')), lambda l: regexp_extract(l, '^\s*(?:\d+[.)]|[-*])\s+(.*\S)', 1)) AS steps FROM said"""
)
def t08_step_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    answer = (
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Plan:\n1. Open "), t, F.lit("\n 2) Then "), t, F.lit("  \n")))
        .when(F.col("ord") % 3 == 1, F.concat(F.lit("- Click "), t))
        .otherwise(t)
    )
    return a.boxes(spark, sf_dir).select("screen_id", "ord", text.step_lines(answer).alias("steps"))


@query(r"SELECT item_id, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS norm FROM benchmark")
def t11_ocr_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "benchmark").select("item_id", text.normalise_ocr(F.col("text")).alias("norm"))


@query("SELECT event_id, ['email addresses', 'email addresses, API keys, access tokens, passwords, or secret strings', 'email addresses, API keys, access tokens, passwords, or secret strings, government ID numbers such as SSN or passport numbers'][event_id % 8 % 3 + 1] AS kinds FROM events")
def t13_kind_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.slice(F.array(F.lit("email"), F.lit("key"), F.lit("id")), F.lit(1), (1 + F.col("event_id") % 8 % 3).cast("int"))
    return a.table(spark, sf_dir, "events").select("event_id", text.kinds_text(kinds).alias("kinds"))


_DESCRIPTOR = """CASE role WHEN 'button' THEN replace('the ' || CASE theme_role WHEN 'primary' THEN 'blue ' WHEN 'danger' THEN 'red ' ELSE '' END || text || ' button', '  ', ' ')
  WHEN 'menu' THEN 'the "' || text || '" menu in the menu bar' WHEN 'nav_item' THEN 'the "' || text || '" item in the sidebar' WHEN 'field' THEN 'the "' || text || '" input field'
  WHEN 'tab' THEN 'the "' || text || '" tab' ELSE 'the ' || text || ' element' END"""
_ELEMENTS = f""", elements AS (SELECT *, {_DESCRIPTOR} AS descriptor, CASE WHEN role IN ('button', 'field') THEN 'tight' ELSE 'region' END AS box_kind
  FROM (SELECT screen_id, ord, text, ['button', 'menu', 'nav_item', 'field', 'tab', 'chip'][q % 6 + 1] AS role, ['primary', 'danger', 'secondary'][s % 3 + 1] AS theme_role FROM boxes))"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    def nth(values: tuple[str, ...], k: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))

    b = a.boxes(spark, sf_dir).withColumn("role", nth(("button", "menu", "nav_item", "field", "tab", "chip"), F.col("q") % 6)).withColumn("theme_role", nth(("primary", "danger", "secondary"), F.col("s") % 3))
    return b.select("screen_id", "ord", "box", "text", "role", text.descriptor(F.col("role"), F.col("text"), F.col("theme_role")).alias("descriptor"), text.box_kind(F.col("role")).alias("box_kind"))


@query(_with(a.BOXES) + _ELEMENTS + " SELECT screen_id, ord, descriptor, box_kind FROM elements")
def t14_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select("screen_id", "ord", "descriptor", "box_kind")


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped, base64(encode(url)) AS url64 FROM pages")
def t15_escape_and_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"), text.plain_base64(F.encode("url", "UTF-8")).alias("url64"))


@query(
    _with(a.TRIALS)
    + """ SELECT variant, screen_id, ord, left(CASE WHEN ord % 3 = 0 THEN '#' || ord ELSE target END || CASE WHEN confidence IS NULL THEN '' ELSE ' ' || printf('%.2f', round_even(confidence, 2)) END, 60) AS caption,
    CASE WHEN confidence IS NULL THEN 'none' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM trials"""
)
def t16_caption_and_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("ord") % 3 != 0, F.col("target")).otherwise("")
    none = F.lit(None).cast("string")
    return a.trials(spark, sf_dir).select("variant", "screen_id", "ord", text.item_caption(label, none, none, F.col("ord"), F.col("confidence")).alias("caption"), text.confidence_band(F.col("confidence")).alias("band"))


# ---- filters and predicates -----------------------------------------------------------------------------------
@query(
    _with(a.ANSWERS)
    + f""", c AS (SELECT screen_id, ord, pos, point, least(greatest(x1, 0), {W}) AS x1, least(greatest(y1, 0), {H}) AS y1, least(greatest(x2, 0), {W}) AS x2, least(greatest(y2, 0), {H}) AS y2 FROM items)
    SELECT screen_id, ord, pos, 10 + 2 * x1 AS x1, 20 + 2 * y1 AS y1, 10 + 2 * x2 AS x2, 20 + 2 * y2 AS y2 FROM c WHERE point OR (x2 > x1 AND y2 > y1)"""
)
def f01_boxes_on_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers parsed, mapped through coordinate mode and view, clamped, and put into original space."""
    rows = a.answers(spark, sf_dir).select("screen_id", "ord", F.lit(W).alias("w"), F.lit(H).alias("h"), F.lit("abs").alias("mode"), g.make_transform(10, 20, 2, 2).alias("tf"), parsing.parse_boxes("answer").alias("items"))
    seen = rules.on_view(rows)
    return seen.select("screen_id", "ord", "pos", *_flat(F.col("box")))


@query(
    _with(a.BOXES)
    + _PAIRS
    + """, m AS (SELECT screen_id, ord, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS inter, (ax2 - ax1) * (ay2 - ay1) AS aa, (bx2 - bx1) * (by2 - by1) AS ba FROM pairs)
    SELECT screen_id, ord, inter / aa >= 0.55 AND aa / greatest(1, ba) < 0.9 AS accepts, aa > 3000 * 0.3 AS too_big FROM m"""
)
def f03_refine_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("screen_id", "ord", rules.refine_accepts(F.col("box"), F.col("other")).alias("accepts"), rules.too_big(F.col("box"), F.lit(60), F.lit(50)).alias("too_big"))


@query(_with(a.TRIALS) + " SELECT variant, screen_id, ord, found AND (confidence IS NULL OR confidence >= 0.55) AS accepted, confidence IS NULL OR confidence >= 0.55 AS kept FROM trials")
def f04_accept_and_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return a.trials(spark, sf_dir).select("variant", "screen_id", "ord", rules.accepted(F.col("found"), c).alias("accepted"), rules.redact_kept(c).alias("kept"))


@query(_with(a.TRIALS) + ", g AS (SELECT *, CASE ord % 4 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE target END AS t FROM trials) SELECT variant, screen_id, ord, CASE WHEN t IS NOT NULL AND lower(t) NOT IN ('null', 'none', '') THEN found AND (confidence IS NULL OR confidence >= 0.55) END AS resolved FROM g")
def f12_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("ord") % 4 == 1, "None").when(F.col("ord") % 4 > 1, F.col("target"))
    return a.trials(spark, sf_dir).select("variant", "screen_id", "ord", rules.resolved(target, F.col("found"), F.col("confidence")).alias("resolved"))


@query(
    _with(a.BOXES)
    + """, s AS (SELECT *, (x1 + x2) / 2 < 196 AS is_left FROM boxes) SELECT screen_id, ord, CASE WHEN is_left THEN 'left' ELSE 'right' END AS side, CASE WHEN is_left THEN x1 ELSE least(greatest(x1 - 196, 0), 150) END AS x1,
    CASE WHEN is_left THEN y1 ELSE least(greatest(y1, 0), 160) END AS y1, CASE WHEN is_left THEN x2 ELSE least(greatest(x2 - 196, 0), 150) END AS x2, CASE WHEN is_left THEN y2 ELSE least(greatest(y2, 0), 160) END AS y2 FROM s"""
)
def f13_diff_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = rules.diff_side(F.col("box"), F.lit(180) + 16, F.lit(150), F.lit(160))
    return a.boxes(spark, sf_dir).withColumn("d", side).select("screen_id", "ord", "d.side", *_flat(F.col("d.box")))


@query(
    _with(a.BOXES)
    + """, m AS (SELECT screen_id, ord, CAST(round_even(least(x1, 200), 0) AS INTEGER) AS x1, CAST(round_even(least(y1, 100), 0) AS INTEGER) AS y1, CAST(round_even(least(x2, 200), 0) AS INTEGER) AS x2, CAST(round_even(least(y2, 100), 0) AS INTEGER) AS y2 FROM boxes)
    SELECT screen_id, ord, x1, y1, x2, y2, CAST(greatest(6, (x2 - x1) // 8) AS INTEGER) AS strength FROM m WHERE x2 > x1 AND y2 > y1"""
)
def u08_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = a.boxes(spark, sf_dir).withColumn("m", rules.mask_pixels(F.col("box"), F.lit(200), F.lit(100), "blur"))
    return m.where("m IS NOT NULL").select("screen_id", "ord", "m.*")


# ---- join-shaped ----------------------------------------------------------------------------------------------
_VARIANTS = "(VALUES ('coarse', false, false), ('coarse+verify', false, true), ('refine', true, false), ('full', true, true)) AS v(variant, refine, verify)"


@query(_with(a.BOXES) + _ELEMENTS + ", once AS (SELECT screen_id, descriptor FROM elements GROUP BY ALL HAVING count(*) = 1), picked AS (SELECT e.screen_id, e.ord, e.descriptor, row_number() OVER (PARTITION BY e.screen_id ORDER BY md5('7:' || e.screen_id || ':' || e.ord), e.ord) AS pick FROM elements e JOIN once USING (screen_id, descriptor)) SELECT screen_id, ord, descriptor, CAST(pick AS INTEGER) AS pick, variant, refine, verify FROM picked, " + _VARIANTS + " WHERE pick <= 3")
def j01_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique targets, three sampled for each screen, in every variant."""
    unique = planning.unique_targets(_elements(spark, sf_dir).select("screen_id", "ord", "descriptor"))
    return planning.plan(planning.pick_targets(unique, 3, 7)).select("screen_id", "ord", "descriptor", "pick", "variant", "refine", "verify")


PHRASES = ["the help icon", "the search field", "the zoom control", "the bell in the header", "the print dialog", "the undo arrow", "the slider handle"]
_EL_TEXT = ", el AS (SELECT screen_id, ['print', 'search', 'avatar', 'zoom', 'Slider', 'Bell', 'x'][(screen_id * 3 + p % 3) % 7 + 1] AS text FROM boxes)"


@query(
    _with(a.BOXES)
    + _EL_TEXT
    + ", ph AS (SELECT unnest("
    + repr(PHRASES)
    + """) AS phrase), w AS (SELECT phrase, unnest(string_split(lower(phrase), ' ')) AS word FROM ph), hit AS (SELECT DISTINCT screen_id, phrase FROM el JOIN w ON lower(el.text) = w.word AND length(w.word) > 3)
    SELECT s.screen_id, ph.phrase FROM (SELECT DISTINCT screen_id FROM el) s, ph WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.screen_id = s.screen_id AND hit.phrase = ph.phrase)"""
)
def j02_absent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("print", "search", "avatar", "zoom", "Slider", "Bell", "x")])
    el = a.boxes(spark, sf_dir).select("screen_id", F.element_at(words, ((F.col("screen_id") * 3 + F.col("p") % 3) % 7 + 1).cast("int")).alias("text"))
    phrases = spark.sql("SELECT explode(array(" + ", ".join(repr(p) for p in PHRASES) + ")) AS phrase")
    return planning.absent_phrases(phrases, el, el)


@query(
    """WITH w AS (SELECT conv_id, turn, list_transform(string_split(lower(coalesce(text, '')), ' '), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) AS words FROM conversations),
    p AS (SELECT conv_id, turn, list_filter(words, lambda x: x <> '') AS want, list_distinct(list_filter(words[10:], lambda x: x <> '')) AS got FROM w),
    m AS (SELECT *, len(list_filter(want, lambda x: len(list_filter(got, lambda y: y = x OR (length(x) > 3 AND contains(y, x)))) > 0)) AS found FROM p)
    SELECT conv_id, turn, CAST(found AS INTEGER) AS found, CAST(len(want) AS INTEGER) AS expected, CAST(len(got) AS INTEGER) AS read, CASE WHEN len(want) > 0 THEN round_even(found / len(want), 4) ELSE 0.0 END AS recall, CAST(greatest(0, len(got) - found) AS INTEGER) AS spurious FROM m"""
)
def j03_ocr_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a text expected against those read from the tenth on, with equality or containment."""
    words = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), text.normalise_ocr)
    score = parsing.let(words, lambda w: metrics.ocr_score(F.slice(w, F.lit(10), F.greatest(F.lit(0), F.size(w) - 9)), w))
    return a.table(spark, sf_dir, "conversations").withColumn("s", score).select("conv_id", "turn", "s.found", "s.expected", "s.read", "s.recall", "s.spurious")


_LINES = r"""lines AS (SELECT item_id, n, lower(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g')) AS line FROM (
      SELECT item_id, unnest(string_split(text, '.')) AS line, unnest(range(len(string_split(text, '.')))) AS n FROM benchmark)),
    pieces AS (SELECT item_id, n, line FROM lines UNION ALL SELECT item_id, n + 1000, left(line, 9) FROM lines UNION ALL SELECT item_id, n + 2000, left(line, 2) FROM lines),
    read AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS text FROM documents)"""


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sentences of the benchmark, whole and cut to 9 and 2 characters, and the documents: both normalised."""
    lines = a.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("n", "line"))
    lines = lines.select("item_id", F.col("n").cast("long").alias("n"), text.normalise_ocr(F.col("line")).alias("line"))
    pieces = lines.unionByName(lines.select("item_id", F.col("n") + 1000, F.left("line", F.lit(9)).alias("line")).toDF("item_id", "n", "line"))
    pieces = pieces.unionByName(lines.select("item_id", F.col("n") + 2000, F.left("line", F.lit(2))).toDF("item_id", "n", "line"))
    return pieces, a.table(spark, sf_dir, "documents").select("doc_id", text.normalise_ocr(F.col("text")).alias("text"))


@query(
    _with(_LINES)
    + """, held AS (SELECT line, (SELECT count(*) FROM read WHERE read.text = w.line OR (length(w.line) > 3 AND contains(read.text, w.line))) AS texts FROM (SELECT DISTINCT line FROM pieces WHERE line <> '') w)
    SELECT item_id, n, line, coalesce(texts, 0) AS texts FROM pieces LEFT JOIN held USING (line)"""
)
def j03_corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each line of the benchmark, by containment of the normalised texts."""
    return containment.corpus_lines(*_corpus(spark, sf_dir), "doc_id").select("item_id", "n", "line", "texts")


@query(
    _with(_LINES)
    + """, held AS (SELECT line, (SELECT count(*) FROM read WHERE read.text = w.line OR (length(w.line) > 3 AND contains(read.text, w.line))) AS texts FROM (SELECT DISTINCT line FROM pieces WHERE line <> '') w),
    s AS (SELECT count(*) AS expected, CAST(count_if(texts > 0) AS BIGINT) AS found FROM pieces JOIN held USING (line)), r AS (SELECT count(DISTINCT text) AS n FROM read WHERE text <> '')
    SELECT round_even(found / expected, 4) AS recall, found, expected, r.n AS "read", greatest(0, r.n - found) AS spurious FROM s, r"""
)
def a06_corpus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.corpus_score(*_corpus(spark, sf_dir), "doc_id")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'qwen2.5-vl-3b' WHEN 1 THEN 'qwen2-vl-2b' WHEN 2 THEN 'qwen2.5-vl-7b' ELSE 'qwen2-vl-2b' END AS spec, CASE event_id % 4 WHEN 0 THEN 'abs' WHEN 2 THEN 'abs' ELSE 'rel1000' END AS coord_mode FROM events")
def j05_model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("qwen2.5-vl-3b", "qwen2-vl-2b", "Qwen/Qwen2.5-VL-7B-Instruct", "Qwen/Qwen2-VL-2B-Instruct")])
    asked = a.table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("model"))
    return registry.lookup(asked).select("event_id", F.col("spec.key").alias("spec"), F.col("spec.coord_mode").alias("coord_mode"))


# ---- aggregates -----------------------------------------------------------------------------------------------
@query(_with(a.TRIALS) + " SELECT variant, screen_id, ord, iou, click_hit, centre_error_px, area_ratio FROM trials")
def a01_score_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.trials(spark, sf_dir).select("variant", "screen_id", "ord", "iou", "click_hit", "centre_error_px", "area_ratio")


_AGGREGATES = """count(*) AS n, round_even(count_if(found) / count(*), 4) AS found_rate, round_even(count_if(found AND click_hit) / count(*), 4) AS click_accuracy,
  CASE WHEN count_if(found) > 0 THEN round_even(count_if(found AND click_hit) / count_if(found), 4) ELSE 0.0 END AS click_accuracy_when_found,
  coalesce(round_even(avg(iou) FILTER (found), 4), 0.0) AS iou_mean, coalesce(round_even(median(iou) FILTER (found), 4), 0.0) AS iou_median,
  round_even(count_if(found AND iou >= 0.5) / count(*), 4) AS iou_at_50, round_even(count_if(found AND iou >= 0.75) / count(*), 4) AS iou_at_75,
  count_if(found AND box_kind = 'tight') AS tight_n, round_even(avg(iou) FILTER (found AND box_kind = 'tight'), 4) AS tight_iou_mean,
  round_even(count_if(found AND box_kind = 'tight' AND iou >= 0.5) / nullif(count_if(found AND box_kind = 'tight'), 0), 4) AS tight_iou_at_50,
  round_even(count_if(found AND box_kind = 'tight' AND iou >= 0.75) / nullif(count_if(found AND box_kind = 'tight'), 0), 4) AS tight_iou_at_75,
  round_even(median(centre_error_px) FILTER (found), 1) AS centre_error_px_median, round_even(avg(latency_s), 2) AS latency_s_mean, round_even(median(latency_s), 2) AS latency_s_median,
  round_even(list_sort(list(latency_s))[least(count(*) - 1, CAST(floor(count(*) * 0.9) AS BIGINT)) + 1], 2) AS latency_s_p90"""


@query(_with(a.TRIALS) + f" SELECT variant, {_AGGREGATES} FROM trials GROUP BY variant")
def a02_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aggregate_trials(a.trials(spark, sf_dir), "variant")


@query(_with(a.TRIALS) + f" SELECT coalesce(CAST(nullif(role, 'menu') AS VARCHAR), 'None') AS group_key, {_AGGREGATES} FROM trials GROUP BY 1")
def a03_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_group(a.trials(spark, sf_dir).withColumn("k", F.nullif("role", F.lit("menu"))), "k")


@query(_with(a.TRIALS) + f" SELECT variant, CAST(scale AS VARCHAR) AS by_scale, role AS by_role, box_kind AS by_box_kind, {_AGGREGATES} FROM trials GROUP BY GROUPING SETS ((variant), (variant, scale), (variant, role), (variant, box_kind))")
def a04_summary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_sets(a.trials(spark, sf_dir))


@query(
    _with(a.TRIALS)
    + """, k AS (SELECT * FROM trials WHERE confidence IS NOT NULL), th AS (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]) AS threshold)
    SELECT variant, threshold, count_if(confidence >= threshold) AS acted_on, count(*) - count_if(confidence >= threshold) AS abstained, round_even(count_if(confidence >= threshold) / count(*), 4) AS coverage,
    CASE WHEN count_if(confidence >= threshold) > 0 THEN round_even(count_if(confidence >= threshold AND coalesce(click_hit, false)) / count_if(confidence >= threshold), 4) ELSE 0.0 END AS precision FROM k, th GROUP BY variant, threshold"""
)
def a05_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confidence_analysis(a.trials(spark, sf_dir), "variant")


@query(_with(a.CALLS) + " SELECT backend, count(*) AS calls, round_even(sum(latency_s), 3) AS total_latency_s, round_even(avg(latency_s), 3) AS mean_call_s, round_even(max(latency_s), 3) AS max_call_s, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(new_tokens) AS BIGINT) AS new_tokens, CASE WHEN sum(latency_s) > 0 THEN round_even(sum(new_tokens) / sum(latency_s), 2) ELSE 0.0 END AS decode_tokens_per_s FROM calls WHERE call_no > 0 GROUP BY backend")
def a07_call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backend statistics without the warm-up call."""
    return metrics.call_stats(planning.without_warm_up(a.calls(spark, sf_dir)), "backend")


@query(
    _with(a.CALLS)
    + """ SELECT backend, count(*) AS n, round_even(avg(latency_s), 3) AS wall_s_mean, round_even(list_sort(list(latency_s))[count(*) // 2 + 1], 3) AS wall_s_median,
    round_even(list_sort(list(latency_s))[least(count(*) - 1, CAST(floor(count(*) * 0.9) AS BIGINT)) + 1], 3) AS wall_s_p90, round_even(max(latency_s), 3) AS wall_s_max, round_even(max(rss_peak_bytes) / 1000000, 1) AS rss_peak_mb_max FROM calls GROUP BY backend"""
)
def a08_resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.resource_summary(a.calls(spark, sf_dir), "backend")


@query(_with(a.TENSORS) + " SELECT model, CAST(sum(n) AS BIGINT) AS total, sum(n) <= 6000000000 AS within_budget, CAST(6000000000 - sum(n) AS BIGINT) AS headroom FROM counted GROUP BY model")
def a11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(a.tensor_rows(spark, sf_dir)).select("model", "total", "within_budget", "headroom")


@query(_with(a.TENSORS) + " SELECT model, component, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY model, component")
def a11_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(a.tensor_rows(spark, sf_dir)).select("model", F.explode("components").alias("component", "n"))


@query(_with(a.TENSORS) + " SELECT model, dtype, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY model, dtype")
def a11_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(a.tensor_rows(spark, sf_dir)).select("model", F.explode("dtypes").alias("dtype", "n"))


@query(_with(a.TENSORS) + " SELECT CAST(sum(n) AS BIGINT) AS path_total_parameters, round_even(sum(n) / 1e9, 4) AS path_total_parameters_b, sum(n) <= 6000000000 AS within_budget, CAST(6000000000 - sum(n) AS BIGINT) AS headroom FROM counted")
def a12_audit_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_pipeline(audit.audit(a.tensor_rows(spark, sf_dir)))


@query(_with(a.TENSORS) + ", t AS (SELECT model, CAST(sum(n) AS BIGINT) AS total FROM counted GROUP BY model) SELECT model, total // 100 AS delta, round_even((total // 100) / total, 6) AS relative_delta, (total // 100) / total <= 0.005 AS agrees FROM t")
def a13_verify_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime = F.col("total") + F.expr("total div 100")
    return audit.audit(a.tensor_rows(spark, sf_dir)).withColumn("v", audit.verify_runtime(F.col("total"), runtime)).select("model", "v.*")


@query(_with(a.TRIALS) + " SELECT variant, count(*) AS n, count_if(found) AS boxes_returned, count_if(found AND (confidence IS NULL OR confidence >= 0.55)) AS would_act, round_even((count(*) - count_if(found AND (confidence IS NULL OR confidence >= 0.55))) / count(*), 4) AS rejection_rate FROM trials GROUP BY variant")
def a15_absent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.trials(spark, sf_dir).withColumn("returned_box", F.col("found")).withColumn("would_act", rules.accepted(F.col("found"), F.col("confidence")))
    return metrics.absent_summary(t, "variant")


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS m FROM embeddings), s AS (SELECT vec_id, m[1] + m[2] + m[3] + m[4] AS y, m[5] + m[6] + m[7] + m[8] AS n, list_sum(m) AS t FROM e) SELECT vec_id, CASE WHEN (y + n) / t >= 1e-6 THEN round(y / (y + n), 9) END AS p_yes FROM s")
def a18_yes_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "embeddings").select("vec_id", F.round(metrics.yes_share(F.col("embedding"), [0, 1, 2, 3], [4, 5, 6, 7]), 9).alias("p_yes"))


# ---- order-dependent ------------------------------------------------------------------------------------------
def _nms(source: str) -> str:
    """CTEs that end in ``kept``: the rows of ``source`` (screen_id, ord, box, text) that greedy suppression keeps."""
    return f""", ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY -length(text), ord) AS rk FROM {source}),
  clash AS MATERIALIZED (SELECT l.screen_id, l.rk, list(k.rk) AS before FROM ranked l JOIN ranked k ON l.screen_id = k.screen_id AND k.rk < l.rk
    WHERE {a.iou_sql("l.", "k.")} > 0.6 OR (l.text <> '' AND l.text = k.text AND {a.iou_sql("l.", "k.")} > 0.2) GROUP BY 1, 2),
  q AS MATERIALIZED (SELECT r.*, coalesce(c.before, []) AS before FROM ranked r LEFT JOIN clash c USING (screen_id, rk)),
  step AS (SELECT screen_id, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM (SELECT DISTINCT screen_id FROM ranked)
    UNION ALL SELECT s.screen_id, s.rk + 1, CASE WHEN list_has_any(s.kept, q.before) THEN s.kept ELSE list_append(s.kept, q.rk) END FROM step s JOIN q ON q.screen_id = s.screen_id AND q.rk = s.rk + 1),
  last AS (SELECT screen_id, arg_max(kept, rk) AS kept FROM step GROUP BY 1),
  kept AS MATERIALIZED (SELECT q.* FROM q JOIN last USING (screen_id) WHERE list_contains(last.kept, q.rk))"""


def _ordered(source: str) -> str:
    """CTEs that end in ``placed``: the rows of ``source`` with their row and position in reading order."""
    return f""", tall AS MATERIALIZED (SELECT screen_id, list_sort(list(greatest(1.0, y2 - y1)))[count(*) // 2 + 1] * 0.5 AS tol FROM {source} GROUP BY 1),
  down AS MATERIALIZED (SELECT s.*, t.tol, (y1 + y2) / 2 AS cy, row_number() OVER (PARTITION BY screen_id ORDER BY (y1 + y2) / 2, ord) AS nth FROM {source} s JOIN tall t USING (screen_id)),
  walk AS (SELECT screen_id, nth, 0 AS "row", cy AS anchor FROM down WHERE nth = 1
    UNION ALL SELECT d.screen_id, d.nth, CASE WHEN abs(d.cy - w.anchor) <= d.tol THEN w."row" ELSE w."row" + 1 END, CASE WHEN abs(d.cy - w.anchor) <= d.tol THEN w.anchor ELSE d.cy END
      FROM walk w JOIN down d ON d.screen_id = w.screen_id AND d.nth = w.nth + 1),
  placed AS (SELECT d.*, w."row", CAST(row_number() OVER (PARTITION BY d.screen_id ORDER BY w."row", d.x1, d.cy, d.ord) - 1 AS INTEGER) AS position FROM down d JOIN walk w USING (screen_id, nth))"""


@query("WITH RECURSIVE " + a.BOXES.lstrip() + _ordered("boxes") + ' SELECT screen_id, ord, "row", position FROM placed')
def w01_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows top down, then left to right."""
    return layout.reading_order(a.boxes(spark, sf_dir).select("screen_id", "ord", "box"))


@query("WITH RECURSIVE " + a.BOXES.lstrip() + _nms("boxes") + " SELECT screen_id, ord FROM kept")
def w02_dedupe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dedupe_text(a.boxes(spark, sf_dir).select("screen_id", "ord", "box", "text")).select("screen_id", "ord")


@query(_with(a.TRIALS) + " SELECT variant, screen_id, min(ord) AS ord FROM trials WHERE found AND confidence >= 0.9 GROUP BY variant, screen_id")
def w03_first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.trials(spark, sf_dir).withColumn("hit", F.col("ord"))
    return rules.first_accepted(t, ["variant", "screen_id"], "ord", F.col("found") & (F.col("confidence") >= 0.9), "hit").select("variant", "screen_id", "ord")


@query(
    "WITH RECURSIVE "
    + a.TRIALS.lstrip()
    + """, t AS MATERIALIZED (SELECT screen_id, ord, confidence, row_number() OVER (PARTITION BY screen_id ORDER BY ord) AS n FROM trials),
    walk AS (SELECT screen_id, n, ord AS pos, confidence FROM t WHERE n = 1
      UNION ALL SELECT t.screen_id, t.n, CASE WHEN coalesce(t.confidence, -1) > CASE WHEN coalesce(w.confidence, 0) = 0 THEN -1 ELSE w.confidence END THEN t.ord ELSE w.pos END,
        CASE WHEN coalesce(t.confidence, -1) > CASE WHEN coalesce(w.confidence, 0) = 0 THEN -1 ELSE w.confidence END THEN t.confidence ELSE w.confidence END
        FROM walk w JOIN t ON t.screen_id = w.screen_id AND t.n = w.n + 1)
    SELECT screen_id, arg_max(pos, n) AS pos, max_by(struct_pack(c := confidence), n).c AS confidence FROM walk GROUP BY 1"""
)
def w04_best_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of a strict scan in order."""
    t = a.trials(spark, sf_dir).withColumn("pos", F.col("ord"))
    return rules.best_tile(t, ["screen_id"])


@query(_with(a.TRIALS) + ", t AS (SELECT *, ord % 3 <> 0 AS has_tile, CASE WHEN ord % 5 <> 0 THEN (ord % 10) / 10 END AS tc FROM trials) SELECT variant, screen_id, ord, CASE WHEN (NOT found OR (confidence IS NOT NULL AND confidence < 0.55)) AND has_tile AND (NOT found OR coalesce(tc, 0) > coalesce(confidence, 0)) THEN 'tile' WHEN found THEN 'hit' END AS choice FROM t")
def w05_locate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile = F.when(F.col("ord") % 5 != 0, (F.col("ord") % 10) / 10)
    return a.trials(spark, sf_dir).select("variant", "screen_id", "ord", rules.locate_choice(F.col("found"), F.col("confidence"), F.col("ord") % 3 != 0, tile).alias("choice"))


# ---- generation, pipelines, reports ---------------------------------------------------------------------------
@query()
def g01_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many screens as there are pages, flattened to elements."""
    n = a.table(spark, sf_dir, "pages").count()
    e = datagen.elements(datagen.screens(spark, n))
    return e.select("screen_id", "ord", "theme", "scale", *_flat(F.col("box")), "role", "text", "theme_role", "height", "box_kind", "descriptor")


@query(
    "WITH RECURSIVE "
    + a.BOXES.lstrip()
    + f", seen AS (SELECT screen_id, ord, least(x1, {W}) AS x1, least(y1, {H}) AS y1, least(x2, {W}) AS x2, least(y2, {H}) AS y2, trim(text) AS text FROM boxes WHERE length(trim(text)) >= 1)"
    + _nms("seen")
    + _ordered("kept")
    + " SELECT screen_id, position, round_even(x1, 1) AS x1, round_even(y1, 1) AS y1, round_even(x2, 1) AS x2, round_even(y2, 1) AS y2, text FROM placed"
)
def u07_ocr_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers to lines of text: parsed, cleaned, de-duplicated, in reading order."""
    said = a.answers(spark, sf_dir).groupBy("screen_id").agg(F.sort_array(F.collect_list(F.struct("ord", "box", "text"))).alias("l"))
    lines = F.transform("l", lambda x: F.struct(F.array(*[x["box"][k] for k in ("x1", "y1", "x2", "y2")]).alias("bbox_2d"), x["text"].alias("text")))
    view = F.struct(F.lit(W).alias("w"), F.lit(H).alias("h"), g.make_transform(0, 0, 1, 1).alias("tf"))
    told = said.select("screen_id", F.to_json(lines).alias("answer"), view.alias("view"), F.lit("abs").alias("mode"))
    out = inference.ocr(told)
    return out.select("screen_id", "position", *_flat(F.col("box")), "text")


@query(
    _with(a.TRIALS)
    + """, d AS (SELECT variant, screen_id, list({'label': target, 'c': confidence, 'x1': px1, 'y1': py1, 'x2': px2, 'y2': py2} ORDER BY ord) AS items FROM (SELECT *, text AS target FROM moved) GROUP BY 1, 2)
    SELECT variant, screen_id, array_to_string([ '<tr><td>' || left(i.label, 180) || '</td><td>' || concat_ws(', ', CAST(round_even(i.x1, 0) AS BIGINT), CAST(round_even(i.y1, 0) AS BIGINT), CAST(round_even(i.x2, 0) AS BIGINT), CAST(round_even(i.y2, 0) AS BIGINT)) || '</td><td><span class=''' ||
      CASE WHEN i.c IS NULL THEN 'none' WHEN i.c >= 0.75 THEN 'high' WHEN i.c >= 0.5 THEN 'medium' ELSE 'low' END || '''>' || coalesce(CAST(round_even(i.c, 2) AS VARCHAR), '-') || '</span></td></tr>' FOR i IN items], '') AS rows FROM d"""
)
def k04_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.trials(spark, sf_dir)
    item = F.struct("ord", F.col("target").alias("label"), F.col("pred_box").alias("box"), "confidence")
    return t.groupBy("variant", "screen_id").agg(F.sort_array(F.collect_list(item)).alias("items")).select("variant", "screen_id", report.detection_rows(F.col("items")).alias("rows"))


# ---- tiles, runs and tasks ------------------------------------------------------------------------------------
@query(
    _with(a.BOXES)
    + f""", t AS (SELECT *, unnest(range(4)) AS i FROM boxes), r AS (SELECT *, greatest(0, i % 2 * {W / 2} - {W / 2} * 0.15::DOUBLE) AS rx1, greatest(0, i // 2 * {H / 2} - {H / 2} * 0.15::DOUBLE) AS ry1,
      least({W}, (i % 2 + 1) * {W / 2} + {W / 2} * 0.15::DOUBLE) AS rx2, least({H}, (i // 2 + 1) * {H / 2} + {H / 2} * 0.15::DOUBLE) AS ry2 FROM t),
    c AS (SELECT *, greatest(0, least(x2, rx2) - greatest(x1, rx1)) * greatest(0, least(y2, ry2) - greatest(y1, ry1)) / ((x2 - x1) * (y2 - y1)) AS share FROM r)
    SELECT screen_id, ord, CAST(i // 2 AS INTEGER) AS r, CAST(i % 2 AS INTEGER) AS c, share >= 0.55 AS searched, share >= 0.6 AS "read" FROM c WHERE share > 0"""
)
def f06_tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tiles of a 2 by 2 grid hold enough of a box to search, and to read it."""
    cut = a.boxes(spark, sf_dir).withColumn("t", F.explode(g.tile_grid(F.lit(W), F.lit(H), F.lit(2), F.lit(2), tasks.SEARCH_OVERLAP)))
    seen = cut.where(g.coverage(F.col("box"), F.col("t.region")) > 0)
    return seen.select("screen_id", "ord", "t.r", "t.c", tasks.covered(F.col("box"), F.col("t.region"), tasks.SEARCH_COVERAGE).alias("searched"), tasks.covered(F.col("box"), F.col("t.region"), tasks.READ_COVERAGE).alias("read"))


@query(_with(a.TRIALS) + " SELECT variant, screen_id, ord, found, iou, click_hit, CASE WHEN found THEN confidence END AS confidence FROM trials")
def j06_pair_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with its hit, if there is one."""
    t = a.trials(spark, sf_dir)
    hits = t.where("found").select("variant", "screen_id", "ord", F.col("pred_box").alias("box"), "confidence", F.lit(False).alias("refined"))
    rows = metrics.pair_with_truth(hits, t.select("variant", "screen_id", "ord", "true_box"), ("variant", "screen_id", "ord"))
    return rows.select("variant", "screen_id", "ord", "found", "iou", "click_hit", "confidence")


@query(
    SQL["j02_absent_phrases"].replace("SELECT s.screen_id, ph.phrase FROM", ", pool AS (SELECT s.screen_id, ph.phrase FROM")
    + "), k AS (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY md5('977:' || screen_id || ':' || phrase), phrase) AS pick FROM pool) SELECT screen_id, phrase, CAST(pick AS INTEGER) AS pick FROM k WHERE pick <= 2"
)
def l02_distractor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.pick_absent(QUERIES["j02_absent_phrases"](spark, sf_dir), 2).select("screen_id", "phrase", "pick")


@query(_with(a.CALLS) + " SELECT backend, arg_min(rss_peak_bytes, call_no) AS rss_start_bytes, max(rss_peak_bytes) AS rss_peak_bytes, max(rss_peak_bytes) - arg_min(rss_peak_bytes, call_no) AS rss_delta_bytes, count(*) AS samples FROM calls GROUP BY backend")
def a17_peak_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.peak_memory(a.calls(spark, sf_dir).select("backend", F.col("call_no").alias("at"), F.col("rss_peak_bytes").alias("rss_bytes")), "backend")


@query(_with(a.TENSORS) + " SELECT model, CAST(sum(CASE WHEN shaped THEN numel ELSE 1 END) AS BIGINT) AS parameters, CAST(sum(2 * CASE WHEN shaped THEN numel ELSE 1 END) AS BIGINT) AS bytes FROM tensors GROUP BY model")
def a20_live_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.parameter_totals(a.tensor_rows(spark, sf_dir).withColumn("itemsize", F.lit(2)), "model")


@query(
    _with(a.BOXES)
    + """, said AS (SELECT screen_id || ':' || ord AS screen_id, CASE ord % 3 WHEN 0 THEN ['Open ' || text, 'Then ' || text] WHEN 1 THEN ['Click ' || text] ELSE [] END AS steps, text, ord FROM boxes),
    u AS (SELECT screen_id, unnest(steps) AS instruction, unnest(range(1, len(steps) + 1)) AS n, text, ord FROM said) SELECT screen_id, CAST(n AS INTEGER) AS n, instruction, CASE WHEN ord % 3 = 1 THEN text END AS target FROM u"""
)
def u07_guide_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as numbered lines and as JSON, to numbered steps."""
    t = F.col("text")
    answer = (
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Plan:\n1. Open "), t, F.lit("\n 2) Then "), t, F.lit("  \n")))
        .when(F.col("ord") % 3 == 1, F.to_json(F.array(F.struct(F.concat(F.lit("Click "), t).alias("instruction"), t.alias("target")))))
        .otherwise(t)
    )
    return inference.guide(a.boxes(spark, sf_dir).select(F.concat_ws(":", "screen_id", "ord").alias("screen_id"), answer.alias("answer")))


@query(
    _with(a.ANSWERS)
    + f""", c AS (SELECT screen_id || ':' || ord AS screen_id, pos, label, least(greatest(x1, 0), {W}) AS x1, least(greatest(y1, 0), {H}) AS y1, least(greatest(x2, 0), {W}) AS x2, least(greatest(y2, 0), {H}) AS y2 FROM items),
    s AS (SELECT *, (x1 + x2) / 2 < 196 AS l FROM c) SELECT screen_id, pos, CASE WHEN l THEN 'left' ELSE 'right' END AS side, label AS description, CASE WHEN l THEN x1 ELSE least(greatest(x1 - 196, 0), 150) END AS x1,
    CASE WHEN l THEN y1 ELSE least(y1, 160) END AS y1, CASE WHEN l THEN x2 ELSE least(greatest(x2 - 196, 0), 150) END AS x2, CASE WHEN l THEN y2 ELSE least(y2, 160) END AS y2, x1 AS canvas_x1 FROM s"""
)
def u07_diff_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on two pictures side by side, each told for its own picture."""
    view = F.struct(F.lit(W).alias("w"), F.lit(H).alias("h"), g.make_transform(0, 0, 1, 1).alias("tf"))
    told = a.answers(spark, sf_dir).select(F.concat_ws(":", "screen_id", "ord").alias("screen_id"), "answer", view.alias("view"), F.lit("abs").alias("mode"), F.lit(180).alias("before_w"), F.lit(150).alias("after_w"), F.lit(160).alias("after_h"))
    return inference.diff(told).select("screen_id", "pos", "side", F.coalesce("description", F.lit("")).alias("description"), *_flat(F.col("box")), F.col("canvas_box.x1").alias("canvas_x1"))


@query(
    _with(a.TRIALS)
    + f""", b AS (SELECT screen_id, ord, role, confidence, greatest(px1 - 3, 0) AS x1, greatest(py1 - 3, 0) AS y1, least(px2 + 3, {W}) AS x2, least(py2 + 3, {H}) AS y2 FROM moved)
    SELECT screen_id || ':' || ord AS screen_id, role AS kind, confidence IS NULL OR confidence >= 0.55 AS kept, round_even(x1, 1) AS x1, round_even(y1, 1) AS y1, round_even(x2, 1) AS x2, round_even(y2, 1) AS y2 FROM b"""
)
def u07_redact_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their kind, grown by a margin; doubted ones are not kept."""
    t = a.trials(spark, sf_dir)
    label = F.concat(F.lit(" "), F.upper("role"))
    found = t.select(F.concat_ws(":", "screen_id", "ord").alias("screen_id"), F.lit(W).alias("w"), F.lit(H).alias("h"), F.col("pred_box").alias("box"), label.alias("label"), F.col("target").alias("text"), "confidence")
    return inference.redact(found).select("screen_id", "kind", "kept", *_flat(F.col("box")))


@query(
    "WITH RECURSIVE "
    + a.BOXES.lstrip()
    + f", seen AS (SELECT screen_id, ord, least(x1, {W}) AS x1, least(y1, {H}) AS y1, least(x2, {W}) AS x2, least(y2, {H}) AS y2, text FROM boxes WHERE ord < 20 AND x1 < {W} AND y1 < {H})"
    + _ordered("seen")
    + " SELECT screen_id, position, ord, round_even(x1, 1) AS x1, round_even(y1, 1) AS y1, text AS label FROM placed"
)
def w07_ground_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of an answer: the first 20 as the model gives them, then in reading order."""
    said = a.answers(spark, sf_dir).groupBy("screen_id").agg(F.sort_array(F.collect_list(F.struct("ord", "box", "text"))).alias("l"))
    places = F.transform("l", lambda x: F.struct(F.array(*[x["box"][k] for k in ("x1", "y1", "x2", "y2")]).alias("bbox_2d"), x["text"].alias("label")))
    view = F.struct(F.lit(W).alias("w"), F.lit(H).alias("h"), g.make_transform(0, 0, 1, 1).alias("tf"))
    out = inference.ground_all(said.select("screen_id", F.to_json(places).alias("answer"), view.alias("view"), F.lit("abs").alias("mode")))
    box = g.rounded(F.col("box"))
    return out.select("screen_id", "position", "ord", box["x1"].alias("x1"), box["y1"].alias("y1"), F.col("item.label").alias("label"))


@query(
    _with(a.TRIALS)
    + """, r AS (SELECT screen_id, CASE ord % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE found AND (confidence IS NULL OR confidence >= 0.55) END AS resolved FROM trials)
    SELECT screen_id, CAST(count_if(resolved) AS BIGINT) AS resolved, count(resolved) AS groundable FROM r GROUP BY screen_id"""
)
def a14_guide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of screens: resolved, and those that name something to resolve."""
    target = F.when(F.col("ord") % 4 == 0, None).when(F.col("ord") % 4 == 1, "None").otherwise(F.col("target"))
    return inference.guide_counts(a.trials(spark, sf_dir).select("screen_id", rules.resolved(target, F.col("found"), F.col("confidence")).alias("resolved")))


@query(
    _with(a.CALLS)
    + """ SELECT backend, call_no, CASE WHEN latency_s > 0 THEN new_tokens / latency_s ELSE 0.0 END AS tokens_per_s FROM calls"""
)
def u01_tokens_per_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.calls(spark, sf_dir).select("backend", "call_no", inference.tokens_per_s(F.col("new_tokens"), F.col("latency_s")).alias("tokens_per_s"))


@query("SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM conversations")
def u01_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.word_count(F.col("text")).alias("words"))

"""Deterministic views of the driver's tables as boxes, trials, tensors, calls and so on, each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..operators import metrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each line item; 30 orders make a screen."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x, y = ((p * 37 + n * 101) % 300).cast("double"), ((s * 53 + n * 17) % 180).cast("double")
    screen = F.floor(F.col("l_orderkey") / 30)
    return joined.select(
        screen.alias("screen_id"),
        (F.row_number().over(Window.partitionBy(screen).orderBy(*keys)) - 1).cast("long").alias("ord"),
        g.make_box(x, y, x + 20 + p % 60, y + 10 + s % 20).alias("box"),
        F.col("p_name").alias("text"),
        p.alias("p"), s.alias("s"), n.cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"),
        F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("theme"),
    )


BOXES = """
boxes AS (
  SELECT screen_id, row_number() OVER (PARTITION BY screen_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ord,
         x1, y1, x1 + 20 + p % 60 AS x2, y1 + 10 + s % 20 AS y2, p_name AS text, p, s, n, q, l_returnflag AS variant, l_linestatus AS theme
  FROM (SELECT *, l_orderkey // 30 AS screen_id, CAST((l_partkey * 37 + l_linenumber * 101) % 300 AS DOUBLE) AS x1,
               CAST((l_suppkey * 53 + l_linenumber * 17) % 180 AS DOUBLE) AS y1, l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q
        FROM lineitem JOIN part ON l_partkey = p_partkey)
)"""

ROLES = ("button", "menu", "nav_item", "field", "tab")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials over the boxes: the prediction is the box moved by a few pixels; scores where something was found."""
    b = boxes(spark, sf_dir)
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("q") % 5 + 1).cast("int"))
    scale = F.element_at(F.array(F.lit(1.0), F.lit(0.75), F.lit(0.55)), (F.col("screen_id") % 3 + 1).cast("int"))
    dx, dy = (F.col("q") % 9 - 4).cast("double"), (F.col("q") % 5 - 2).cast("double")
    t = F.col("box")
    rows = b.select(
        "variant", "screen_id", "ord", scale.alias("scale"), "theme", role.alias("role"), F.col("text").alias("target"),
        F.when(role.isin("button", "field"), "tight").otherwise("region").alias("box_kind"),
        (F.col("p") % 10 != 0).alias("found"),
        F.when(F.col("s") % 11 != 0, ((F.col("p") * 7 + F.col("n") * 13) % 101).cast("double") / 100).alias("confidence"),
        (((F.col("p") + F.col("s") * 3) % 2000).cast("double") / 100).alias("latency_s"),
        t.alias("true_box"), g.make_box(t["x1"] + dx, t["y1"] + dy, t["x2"] + dx, t["y2"] + dy).alias("pred_box"),
    )
    return metrics.with_scores(rows, found="found")


def iou_sql(a: str, b: str) -> str:
    inter = f"greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    union = f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - {inter})"
    return f"(CASE WHEN {union} > 0 THEN ({inter}) / {union} ELSE 0.0 END)"


TRIALS = (
    BOXES
    + """, moved AS (
  SELECT *, x1 + q % 9 - 4 AS px1, x2 + q % 9 - 4 AS px2, y1 + q % 5 - 2 AS py1, y2 + q % 5 - 2 AS py2,
         ['button', 'menu', 'nav_item', 'field', 'tab'][q % 5 + 1] AS role, [1.0::DOUBLE, 0.75::DOUBLE, 0.55::DOUBLE][screen_id % 3 + 1] AS scale,
         p % 10 <> 0 AS found, CASE WHEN s % 11 <> 0 THEN CAST((p * 7 + n * 13) % 101 AS DOUBLE) / 100 END AS confidence,
         CAST((p + s * 3) % 2000 AS DOUBLE) / 100 AS latency_s
  FROM boxes
), trials AS (
  SELECT variant, screen_id, ord, scale, theme, role, text AS target, CASE WHEN role IN ('button', 'field') THEN 'tight' ELSE 'region' END AS box_kind, found, confidence, latency_s,
         CASE WHEN found THEN round_even(iou, 4) END AS iou,
         CASE WHEN found THEN cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2 END AS click_hit,
         CASE WHEN found THEN round_even(sqrt((cx - tx) * (cx - tx) + (cy - ty) * (cy - ty)), 1) END AS centre_error_px,
         CASE WHEN found THEN round_even((px2 - px1) * (py2 - py1) / greatest(1, (x2 - x1) * (y2 - y1)), 3) END AS area_ratio
  FROM (SELECT *, (px1 + px2) / 2 AS cx, (py1 + py2) / 2 AS cy, (x1 + x2) / 2 AS tx, (y1 + y2) / 2 AS ty, """
    + "greatest(0, least(px2, x2) - greatest(px1, x1)) * greatest(0, least(py2, y2) - greatest(py1, y1)) AS inter,"
    + " inter / ((px2 - px1) * (py2 - py1) + (x2 - x1) * (y2 - y1) - inter) AS iou FROM moved)\n)"
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in eight shapes, one for each box."""
    b = F.col("box")
    nums = F.concat_ws(", ", *[b[k].cast("long").cast("string") for k in ("x1", "y1", "x2", "y2")])
    label = F.concat(F.lit('"label": "'), F.col("text"), F.lit('"'))
    obj = F.concat(F.lit('{"bbox_2d": ['), nums, F.lit("], "), label, F.lit("}"))
    shapes = [
        F.concat(F.lit("["), obj, F.lit("]")),
        F.concat(F.lit("Sure:\n```json\n["), obj, F.lit("]\n```")),
        F.concat(F.lit('{"items": [{"bounding_box": ['), nums, F.lit('], "name": "'), F.col("text"), F.lit('"}]}')),
        F.concat(F.lit("["), obj, F.lit(', {"bbox_2d": [1, 2')),
        F.concat(F.lit('[{"box": [['), b["x1"].cast("long").cast("string"), F.lit(", "), b["y1"].cast("long").cast("string"), F.lit("], ["), b["x2"].cast("long").cast("string"), F.lit(", "), b["y2"].cast("long").cast("string"), F.lit("]]}]")),
        F.concat(F.lit("It is at ("), nums, F.lit(").")),
        F.concat(F.lit('{"point": ['), b["x1"].cast("long").cast("string"), F.lit(", "), b["y1"].cast("long").cast("string"), F.lit("]}")),
        F.concat(F.lit("no idea about "), F.col("text")),
    ]
    shape = F.col("ord") % 8
    chosen = F.when(shape == 0, shapes[0])
    for k, s in enumerate(shapes[1:], 1):
        chosen = chosen.when(shape == k, s)
    return boxes(spark, sf_dir).select("screen_id", "ord", "box", "text", chosen.alias("answer"))


ANSWERS = (
    BOXES
    + """, told AS (
  SELECT *, concat_ws(', ', CAST(x1 AS BIGINT), CAST(y1 AS BIGINT), CAST(x2 AS BIGINT), CAST(y2 AS BIGINT)) AS nums, '"label": "' || text || '"' AS label FROM boxes
), answers AS (
  SELECT screen_id, ord, text, CASE ord % 8
    WHEN 0 THEN '[{"bbox_2d": [' || nums || '], ' || label || '}]'
    WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '[{"bbox_2d": [' || nums || '], ' || label || '}]' || chr(10) || '```'
    WHEN 2 THEN '{"items": [{"bounding_box": [' || nums || '], "name": "' || text || '"}]}'
    WHEN 3 THEN '[{"bbox_2d": [' || nums || '], ' || label || '}, {"bbox_2d": [1, 2'
    WHEN 4 THEN '[{"box": [[' || CAST(x1 AS BIGINT) || ', ' || CAST(y1 AS BIGINT) || '], [' || CAST(x2 AS BIGINT) || ', ' || CAST(y2 AS BIGINT) || ']]}]'
    WHEN 5 THEN 'It is at (' || nums || ').'
    WHEN 6 THEN '{"point": [' || CAST(x1 AS BIGINT) || ', ' || CAST(y1 AS BIGINT) || ']}'
    ELSE 'no idea about ' || text END AS answer FROM told
), items AS (
  SELECT screen_id, ord, 0 AS pos, CASE WHEN k = 6 THEN x1 - 1 ELSE x1 END AS x1, CASE WHEN k = 6 THEN y1 - 1 ELSE y1 END AS y1,
         CASE WHEN k = 6 THEN x1 + 1 ELSE x2 END AS x2, CASE WHEN k = 6 THEN y1 + 1 ELSE y2 END AS y2,
         CASE WHEN k < 4 THEN text ELSE '' END AS label, '' AS text, k = 6 AS point
  FROM (SELECT *, ord % 8 AS k FROM boxes) WHERE k <> 7
)"""
)


def tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tensors of five models; names repeat over files."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stem = F.element_at(F.array(*[F.lit(x) for x in STEMS]), (k % len(STEMS) + 1).cast("int"))
    return part.select(
        F.concat(F.lit("model"), (k % 5).cast("string")).alias("model"),
        F.concat(F.lit("shard"), (F.floor(k / 5) % 8).cast("string")).alias("file"), k.alias("pos"),
        F.concat(stem, F.lit("."), (k % 701).cast("string")).alias("name"), F.col("p_brand").alias("dtype"),
        F.when(k % 17 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("p_size").cast("long"), k % 50 + 1)).alias("shape"),
    )


STEMS = ["visual.blocks", "visual.merger", "model.embed_tokens", "model.layers", "lm_head", "spare", "language_model.embed_tokens"]
TENSORS = f"""
tensors AS (
  SELECT 'model' || (p_partkey % 5) AS model, 'shard' || ((p_partkey // 5) % 8) AS file, p_partkey AS pos,
         {STEMS}[p_partkey % {len(STEMS)} + 1] || '.' || (p_partkey % 701) AS name, p_brand AS dtype,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * (p_partkey % 50 + 1) END AS numel, p_partkey % 17 <> 0 AS shaped
  FROM part
), counted AS (
  SELECT model, name, arg_min(dtype, (file, pos)) AS dtype, arg_min(numel, (file, pos)) AS n,
         CASE WHEN name LIKE '%visual.blocks%' THEN 'vision encoder' WHEN name LIKE '%visual.merger%' THEN 'vision-language projector'
              WHEN name LIKE '%embed_tokens%' THEN 'token embeddings' WHEN name LIKE '%model.layers%' OR name LIKE '%language_model%' THEN 'language backbone'
              WHEN name LIKE '%lm_head%' THEN 'output head' ELSE 'other' END AS component
  FROM tensors WHERE shaped GROUP BY model, name
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of model calls and as resource samples."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("backend"), F.col("event_id").alias("call_no"), F.col("value").alias("latency_s"),
        (F.col("event_id") % 1500).alias("prompt_tokens"), F.coalesce(k, F.lit(0)).alias("new_tokens"),
        F.col("value").alias("wall_s"), (F.col("user_id") * 1_000_003).alias("rss_peak_bytes"),
    )


CALLS = """
calls AS (
  SELECT event_type AS backend, event_id AS call_no, value AS latency_s, event_id % 1500 AS prompt_tokens,
         coalesce(try_cast(props ->> '$.k' AS BIGINT), 0) AS new_tokens, user_id * 1000003 AS rss_peak_bytes
  FROM events
)"""

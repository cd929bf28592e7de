"""Tasks over many screens at once: tile search, locate, find, describe, ask, tiled reading, benchmark and distractor runs.

Requests are rows (screen_id, w, h, target, mode); model calls go through a backend, and ``save`` writes a frame to a
table and reads it back, so no call is made twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import parsing, text
from . import inference, layout, metrics, planning, rules

Save = Callable[[DataFrame], DataFrame]
KEYS = ["screen_id", "target"]
#: Share of a box that its tile must cover, for search and for reading; overlap of tiles for either
SEARCH_COVERAGE, READ_COVERAGE = 0.55, 0.6
SEARCH_OVERLAP, READ_OVERLAP = 0.15, 0.08
FACTOR, LEAST, MOST = 28, 256 * 28 * 28, 1280 * 28 * 28


def tiles(screens: DataFrame, cols: int, rows: int, overlap: float) -> DataFrame:
    """Screens (w, h) exploded into tiles: r, c, region, and the view of the tile enlarged to the full pixel budget."""
    cut = screens.withColumn("t", F.explode(g.tile_grid(F.col("w"), F.col("h"), F.lit(cols), F.lit(rows), overlap))).select("*", "t.*").drop("t")
    cut = cut.withColumn("cut", g.crop(F.col("region"), F.col("w"), F.col("h"), F.lit(None).cast(g.TRANSFORM)))
    view = g.prepare(F.col("cut.w"), F.col("cut.h"), F.col("cut.tf"), F.lit(FACTOR), F.lit(LEAST), F.lit(MOST), F.lit(MOST))
    return cut.withColumn("view", view).drop("cut")


def covered(box: Column, region: Column, least: float) -> Column:
    """Whether a tile holds enough of a box found in it."""
    return g.coverage(box, region) >= least


def search_tiles(requests: DataFrame, backend: inference.Backend, save: Save, cols: int = 2, rows: int = 2) -> DataFrame:
    """(screen_id, target, box, label, confidence, stage, trace): the best verified candidate of all tiles, by a strict scan in order."""
    asked = tiles(requests, cols, rows, SEARCH_OVERLAP).withColumn("prompt", inference.prompt(inference.REFINE_PROMPT, F.col("target")))
    found = inference.boxes_on(save(backend(asked))).where(covered(F.col("box"), F.col("region"), SEARCH_COVERAGE))
    place = F.struct("r", "c", "pos")
    found = found.select(*KEYS, "w", "h", "mode", "r", "c", place.alias("place"), "box", F.col("item.label").alias("label"))
    around = g.expand_box(F.col("box"), F.col("w"), F.col("h"), 1.6, 12.0, 96.0)
    cut = found.withColumn("cut", g.crop(around, F.col("w"), F.col("h"), F.lit(None).cast(g.TRANSFORM)))
    view = g.prepare(F.col("cut.w"), F.col("cut.h"), F.col("cut.tf"), F.lit(FACTOR), F.lit(LEAST), F.lit(MOST), F.lit(2 * LEAST))
    told = save(backend(cut.withColumn("view", view).drop("cut").withColumn("prompt", inference.prompt(inference.VERIFY_PROMPT, F.col("target")))))
    scored = told.withColumn("confidence", text.yes_probability(F.col("answer")))
    # the rank of a candidate among those of its request: tiles and candidates of a screen are a bounded few
    queue = F.sort_array(F.collect_list(F.struct("place", "confidence", "box", "label")))
    listed = scored.groupBy(*KEYS).agg(queue.alias("q")).select(*KEYS, F.posexplode("q").alias("pos", "x")).select(*KEYS, F.col("pos").cast("long").alias("pos"), "x.*")
    won = rules.best_tile(listed, KEYS).select(*KEYS, "pos")
    stage = F.format_string("tile[%d,%d]", F.col("place.r"), F.col("place.c"))
    trace = F.array(inference.step(stage, F.col("box"), None, F.col("confidence")))
    return listed.join(won, [*KEYS, "pos"]).select(*KEYS, "box", "label", "confidence", stage.alias("stage"), trace.alias("trace"))


def locate(requests: DataFrame, backend: inference.Backend, save: Save, config: rules.GroundConfig = rules.GroundConfig(), fallback_tiles: bool = True) -> DataFrame:
    """Coarse, zoom and verify; where that finds nothing, or nothing that convinces, the better of it and a tile search."""
    hit = save(inference.ground(requests, backend, save, config).withColumn("tiled", F.lit(False)))
    if not fallback_tiles:
        return hit
    sure = hit.where(F.col("confidence").isNull() | (F.col("confidence") >= config.accept_threshold)).select(*KEYS)
    other = search_tiles(requests.join(sure, KEYS, "left_anti"), backend, save).withColumn("refined", F.lit(True)).withColumn("tiled", F.lit(True))
    names = ["box", "label", "refined", "stage", "confidence", "tiled", "trace"]
    both = hit.select(*KEYS, F.struct(*names).alias("hit")).join(other.select(*KEYS, F.struct(*names).alias("tile")), KEYS, "full")
    choice = rules.locate_choice(F.col("hit").isNotNull(), F.col("hit.confidence"), F.col("tile").isNotNull(), F.col("tile.confidence"), config.accept_threshold)
    best = both.withColumn("best", F.when(choice == "tile", F.col("tile")).otherwise(F.col("hit")))
    # a tile that wins goes on from what the first stages did
    trace = F.when(choice == "tile", F.concat(F.coalesce(F.col("hit.trace"), F.array().cast(f"array<{inference.STEP}>")), F.col("tile.trace"))).otherwise(F.col("hit.trace"))
    return best.select(*KEYS, *[F.col(f"best.{c}") for c in names[:-1]], trace.alias("trace"))


def find(requests: DataFrame, backend: inference.Backend, save: Save, config: rules.GroundConfig = rules.GroundConfig(), fallback_tiles: bool = True) -> DataFrame:
    """(screen_id, target, found, accepted, count, hit, label, stage, tiled, trace), one row per request."""
    hits = locate(requests, backend, save, config, fallback_tiles)
    rows = requests.select(*KEYS).join(hits, KEYS, "left").withColumn("found", F.col("box").isNotNull())
    accepted = rules.accepted(F.col("found"), F.col("confidence"), config.accept_threshold)
    hit = F.when(F.col("found"), rules.hit_dict(F.col("box"), F.col("confidence")))
    return rows.select(*KEYS, "found", accepted.alias("accepted"), F.col("found").cast("int").alias("count"), hit.alias("hit"), "label", "stage", "tiled", "trace")


def find_all(requests: DataFrame, backend: inference.Backend, save: Save, max_items: int = 20) -> DataFrame:
    """(screen_id, target, position, hit, label), a row for each match in reading order; matches are neither refined nor verified."""
    asked = inference.base_view(requests).withColumn("request", F.struct(*KEYS)).withColumn("prompt", inference.prompt(inference.ALL_PROMPT, F.col("target")))
    hits = inference.ground_all(save(backend(asked)), max_items, key="request")
    label = text.first_truthy(F.col("item.label"), F.col("item.text"), F.col("target"))
    return hits.select("request.*", "position", rules.hit_dict(F.col("box"), F.lit(None).cast("double")).alias("hit"), label.alias("label"))


def guide(screens: DataFrame, backend: inference.Backend, save: Save, config: rules.GroundConfig = rules.GroundConfig(), max_steps: int = 6) -> DataFrame:
    """Screens (screen_id, w, h, goal, mode) to (screen_id, n, instruction, target, resolved, hit, label).

    Steps are numbered as the answer gives them; those that name an element are grounded, once for each element of a screen.
    """
    told = save(backend(inference.base_view(screens).withColumn("prompt", inference.prompt(inference.GUIDE_PROMPT, F.col("goal")))))
    steps = save(inference.guide(told.select("screen_id", "answer"), max_steps))
    wanted = steps.where(rules.groundable(F.col("target"))).select(*KEYS).distinct()
    hits = inference.ground(wanted.join(screens.select("screen_id", "w", "h", "mode"), "screen_id"), backend, save, config)
    found = F.col("box").isNotNull()
    rows = steps.join(hits.select(*KEYS, "box", "label", "confidence"), KEYS, "left")
    resolved = rules.resolved(F.col("target"), found, F.col("confidence"), config.accept_threshold)
    return rows.select("screen_id", "n", "instruction", "target", resolved.alias("resolved"), F.when(found, rules.hit_dict(F.col("box"), F.col("confidence"))).alias("hit"), "label")


def redact(screens: DataFrame, backend: inference.Backend, save: Save, kinds: tuple[str, ...] = ("email", "phone", "name"), pad: float = 3.0, method: str = "blur", config: rules.GroundConfig = rules.GroundConfig()) -> DataFrame:
    """Screens (screen_id, w, h, mode) to findings (screen_id, box, kind, text, confidence, kept, mask), each verified by a call of its own."""
    wanted = text.kinds_text(F.array(*[F.lit(k) for k in kinds]))
    told = save(backend(inference.base_view(screens).withColumn("prompt", inference.prompt(inference.REDACT_PROMPT, wanted))))
    found = inference.boxes_on(told).select("screen_id", "w", "h", "mode", "pos", "box", F.col("item.label").alias("label"), F.col("item.text").alias("text"))
    named = text.first_truthy(F.col("text"), F.col("label"))
    around = g.expand_box(F.col("box"), F.col("w"), F.col("h"), 1.6, 12.0, 96.0)
    cut = save(found).withColumn("cut", g.crop(around, F.col("w"), F.col("h"), F.lit(None).cast(g.TRANSFORM)))
    view = g.prepare(F.col("cut.w"), F.col("cut.h"), F.col("cut.tf"), F.lit(FACTOR), F.lit(LEAST), F.lit(MOST), F.lit(LEAST))
    checked = save(backend(cut.withColumn("view", view).drop("cut").withColumn("prompt", inference.prompt(inference.VERIFY_PROMPT, named))))
    return inference.redact(checked.withColumn("confidence", text.yes_probability(F.col("answer"))), pad, method, config.accept_threshold)


def ocr(screens: DataFrame, backend: inference.Backend, save: Save, cols: int = 2, rows: int = 2, min_chars: int = 1) -> DataFrame:
    """Screens (screen_id, w, h, mode) to lines (screen_id, position, box, text): a call for each tile, read as one."""
    cut = tiles(screens, cols, rows, READ_OVERLAP)
    return read_tiles(save(backend(cut.withColumn("prompt", F.lit(inference.READ_PROMPT)))), min_chars)


def diff(pairs: DataFrame, backend: inference.Backend, save: Save, gap: int = 16) -> DataFrame:
    """Pairs (screen_id, before_w, before_h, after_w, after_h, mode) to changes (screen_id, pos, side, box, canvas_box, description)."""
    canvas = pairs.withColumn("w", F.col("before_w") + gap + F.col("after_w")).withColumn("h", F.greatest("before_h", "after_h"))
    return inference.diff(save(backend(inference.base_view(canvas).withColumn("prompt", F.lit(inference.DIFF_PROMPT)))), gap)


def describe(screens: DataFrame, backend: inference.Backend, question: str = "Describe this screenshot as JSON.") -> DataFrame:
    """(screen_id, view, result, raw): the object that the answer holds, as JSON."""
    told = backend(inference.base_view(screens).withColumn("prompt", F.lit(question)))
    return told.select("screen_id", "view", parsing.describe_json("answer").alias("result"), F.col("answer").alias("raw"))


def ask(screens: DataFrame, backend: inference.Backend) -> DataFrame:
    """(screen_id, question, answer) for screens with a question each."""
    return backend(inference.base_view(screens).withColumn("prompt", F.col("question"))).select("screen_id", "question", "answer")


def read_tiles(answers: DataFrame, min_chars: int = 1) -> DataFrame:
    """Lines of tiles' answers (with region and view), as far as their tile covers them, like one reading of the screen."""
    seen = inference.boxes_on(answers).where(covered(F.col("box"), F.col("region"), READ_COVERAGE))
    order = F.struct("r", "c", "pos")
    lines = seen.select("screen_id", order.alias("place"), "box", text.clean_line(F.col("item.text"), F.col("item.label")).alias("text")).where(F.length("text") >= min_chars)
    queue = lines.groupBy("screen_id").agg(F.sort_array(F.collect_list(F.struct("place", "box", "text"))).alias("q"))  # the lines of one screen
    numbered = queue.select("screen_id", F.posexplode("q").alias("ord", "x")).select("screen_id", F.col("ord").cast("long").alias("ord"), "x.box", "x.text")
    kept = layout.dedupe_text(numbered)
    return layout.reading_order(kept, carry=["box", "text"]).select("screen_id", "position", g.rounded(F.col("box")).alias("box"), "text")


def bench(targets: DataFrame, backend: inference.Backend, save: Save, config: rules.GroundConfig = rules.GroundConfig()) -> DataFrame:
    """Trial rows of every variant over targets (screen_id, w, h, target, mode, true_box, and what describes them)."""
    plan = planning.plan(targets)
    hits = None
    for name, refine, verify in planning.VARIANTS:
        found = inference.ground(targets.select(*KEYS, "w", "h", "mode"), backend, save, config, refine, verify).withColumn("variant", F.lit(name))
        hits = found if hits is None else hits.unionByName(found)
    return metrics.pair_with_truth(hits, plan.drop("refine", "verify"))


def bench_payload(trials: DataFrame) -> DataFrame:
    """(variant, summary, confidence): nested summaries per variant; confidence only where something is acted on."""
    sets = metrics.summary_sets(trials)
    kinds = {"scale": "by_scale", "role": "by_role", "box_kind": "by_box_kind"}
    overall = sets.where(" AND ".join(f"{c} IS NULL" for c in kinds.values())).drop(*kinds.values())
    out = overall.select("variant", F.struct(*[c for c in overall.columns if c != "variant"]).alias("overall"))
    values = [c for c in overall.columns if c != "variant"]
    for key, column in kinds.items():
        each = sets.where(F.col(column).isNotNull()).groupBy("variant").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column).alias("key"), F.struct(*values).alias("value"))))).alias(f"by_{key}"))
        out = out.join(each, "variant", "left")
    known = metrics.confidence_analysis(trials, "variant").groupBy("variant").agg(F.sort_array(F.collect_list(F.struct("threshold", "acted_on", "abstained", "coverage", "precision"))).alias("confidence"))
    acted = known.where(F.exists("confidence", lambda c: c["acted_on"] > 0))
    return out.join(acted, "variant", "left").select("variant", F.struct("overall", "by_scale", "by_role", "by_box_kind").alias("summary"), "confidence")


def pick_absent(pool: DataFrame, per_screen: int = 1, seed: int = 0) -> DataFrame:
    """Up to ``per_screen`` absent phrases of each screen, in a reproducible random order of its own."""
    return planning.pick_targets(pool, per_screen, seed + 977, "screen_id", "phrase")


def distractors(absent: DataFrame, backend: inference.Backend, save: Save, config: rules.GroundConfig = rules.GroundConfig()) -> DataFrame:
    """(screen_id, target, returned_box, would_act, confidence) of requests for what is not there: coarse and verified."""
    hits = inference.ground(absent, backend, save, config, refine=False, verify=True).select(*KEYS, "confidence", F.lit(True).alias("hit"))
    rows = absent.select(*KEYS).join(hits, KEYS, "left").withColumn("returned_box", F.col("hit").isNotNull())
    return rows.select(*KEYS, "returned_box", rules.accepted(F.col("returned_box"), F.col("confidence"), config.accept_threshold).alias("would_act"), "confidence")

"""Model calls as an external column producer, and the staged grounding pipelines around them.

A backend turns rows of (request_id, image, prompt) into rows with an answer. The expensive call sits behind
real filters and its output is written to a table before it is used twice, so no call is made again.
The replay backend looks recorded answers up: an equi-join, deterministic, for tests and re-scoring.
"""

from __future__ import annotations

import resource
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import parsing, text
from . import layout, rules

Backend = Callable[[DataFrame], DataFrame]
ANSWER = "answer string, prompt_tokens long, new_tokens long, latency_s double"

#: Prompt templates
GROUND_PROMPT = 'Locate "{target}" in this screenshot.'
REFINE_PROMPT = 'Locate "{target}" in this enlarged part of a screenshot.'
VERIFY_PROMPT = 'Is this "{target}"? Answer Yes or No.'
ALL_PROMPT = 'Locate every "{target}" in this screenshot, as a JSON list.'
READ_PROMPT = "Read all text in this picture, as a JSON list of lines with their boxes."
GUIDE_PROMPT = 'List the steps to "{target}", as a JSON list with the element of each.'
DIFF_PROMPT = "Two screenshots stand side by side. List what differs, as a JSON list with boxes."
REDACT_PROMPT = "Locate all {target} in this screenshot, as a JSON list with the kind of each."


def prompt(template: str, target: Column) -> Column:
    before, after = template.split("{target}")
    return F.concat(F.lit(before), target, F.lit(after))


def batch_backend(load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], memory: bool = False) -> Backend:
    """A backend from a loader: the model is loaded once per Python worker and called with whole batches.

    The function it returns maps (image, prompt) rows to columns answer, prompt_tokens, new_tokens, latency_s. With
    ``memory``, rows also have the worker's peak so far, rss_peak_bytes.
    """

    def run(requests: DataFrame) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema) + ", " + ANSWER + (", rss_peak_bytes long" if memory else "")

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                if len(batch):
                    told = pd.concat([batch.reset_index(drop=True), model(batch).reset_index(drop=True)], axis=1)
                    yield told.assign(rss_peak_bytes=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024) if memory else told

        return requests.mapInPandas(call, schema)

    return run


def replay_backend(recorded: DataFrame, keys: tuple[str, ...] = ("screen_id", "prompt")) -> Backend:
    """Answers from a table of (keys..., answer, prompt_tokens, new_tokens, latency_s); unknown requests get none."""

    def run(requests: DataFrame) -> DataFrame:
        return requests.join(recorded.select(*keys, "answer", "prompt_tokens", "new_tokens", "latency_s"), list(keys), "left")

    return run


class Measured:
    """A backend whose calls are counted as they are made, in the same pass that makes them.

    Every frame of answers is observed: calls, latency, tokens and peak memory come to the driver as one row when the
    frame is computed, whatever its size. ``totals()`` adds up the frames that were; one that never is computed would wait.
    The frames themselves, as saved, are the log of calls.
    """

    def __init__(self, backend: Backend) -> None:
        self.backend = backend
        self.seen: list[Observation] = []

    def __call__(self, requests: DataFrame) -> DataFrame:
        out, one = self.backend(requests), Observation()
        self.seen.append(one)
        made = F.col("answer").isNotNull()
        peak = F.max("rss_peak_bytes") if "rss_peak_bytes" in out.columns else F.max(F.lit(None).cast("long"))
        sums = [F.sum(F.when(made, F.col(c))).alias(c) for c in ("latency_s", "prompt_tokens", "new_tokens")]
        return out.observe(one, F.count_if(made).alias("calls"), *sums, F.max(F.when(made, F.col("latency_s"))).alias("max_call_s"), peak.alias("rss_peak_bytes"))

    def totals(self) -> dict[str, float | int | None]:
        """As call_stats() over all calls, with the peak of memory; rates are 0 without latency."""
        rows = [o.get for o in self.seen]
        added = {k: sum(r[k] or 0 for r in rows) for k in ("calls", "latency_s", "prompt_tokens", "new_tokens")}
        most = {k: max((r[k] for r in rows if r[k] is not None), default=None) for k in ("max_call_s", "rss_peak_bytes")}
        spent = added["latency_s"]
        return added | most | {"mean_call_s": spent / added["calls"] if added["calls"] else None, "decode_tokens_per_s": added["new_tokens"] / spent if spent > 0 else 0.0}


def choose_backend(key: str, available: dict[str, Backend], order: tuple[str, ...] = ("mlx", "hf", "replay")) -> Backend:
    """`auto` takes the first that is available; an unknown name is an error."""
    if key == "auto":
        key = next((k for k in order if k in available), "")
    if key not in available:
        raise KeyError(f"unknown backend; available: {', '.join(sorted(available))}")
    return available[key]


def tokens_per_s(new_tokens: Column, latency_s: Column) -> Column:
    return F.when(latency_s > 0, new_tokens / latency_s).otherwise(0.0)


def base_view(screens: DataFrame, factor: int = 28, least: int = 256 * 28 * 28, most: int = 1280 * 28 * 28) -> DataFrame:
    """Screens (screen_id, w, h) with the view (w, h, tf) the model sees."""
    return screens.withColumn("view", g.prepare(F.col("w"), F.col("h"), F.lit(None).cast(g.TRANSFORM), F.lit(factor), F.lit(least), F.lit(most)))


def boxes_on(answers: DataFrame) -> DataFrame:
    """Parsed boxes of answers over their view: rows (..., pos, item, view_box, box)."""
    seen = told_items(answers).select("*", F.col("view.w").alias("view_w"), F.col("view.h").alias("view_h"), F.col("view.tf").alias("view_tf"))
    return rules.placed_on_view(seen, "view_w", "view_h", "view_tf", "mode").drop("view_w", "view_h", "view_tf")


def told_items(answers: DataFrame) -> DataFrame:
    """``answers`` with pos and item, a row for each box.

    What is parsed is a column for each step, so that it is computed once. The array of boxes is no column of its own: a
    filter by its size, which the optimizer infers for a column that is exploded, would parse each answer twice.
    """
    found = parsing.with_value(answers, "answer", "_value")
    return found.select(*[F.col(c) for c in answers.columns], F.posexplode(parsing.boxes_of("_value", "answer")).alias("pos", "item"))


#: A hit's trace: what each stage did, in order
STEP = f"struct<stage: string, box: {g.BOX}, region: {g.BOX}, confidence: double>"


def step(stage: Column, box: Column | None = None, region: Column | None = None, confidence: Column | None = None) -> Column:
    """One entry of a trace: the box a stage came to (null: none), the region it looked at, and how sure it was."""
    named = {"stage": stage, "box": box, "region": region, "confidence": confidence}
    return F.struct(*[(F.lit(None) if v is None else v).alias(k) for k, v in named.items()]).cast(STEP)


def ground(requests: DataFrame, backend: Backend, save: Callable[[DataFrame], DataFrame], config: rules.GroundConfig = rules.GroundConfig(), refine: bool = True, verify: bool | None = None, factor: int = 28, least: int = 256 * 28 * 28, most: int = 1280 * 28 * 28) -> DataFrame:
    """Coarse, zoom and verify for requests (screen_id, w, h, target, mode); one row for each target found.

    ``save`` writes a frame to a table and reads it back; it is called after every stage of model calls.
    Returns (screen_id, target, box, label, refined, stage, confidence, trace); the trace has an entry for each stage in order.
    """
    verify = config.verify if verify is None else verify
    seen = base_view(requests, factor, least, most)
    asked = seen.withColumn("prompt", prompt(GROUND_PROMPT, F.col("target")))
    coarse = boxes_on(save(backend(asked)))
    keys = ["screen_id", "target"]
    first = coarse.groupBy(*keys).agg(F.min_by(F.struct("w", "h", "mode", "box", F.col("item.label").alias("label")), "pos").alias("c")).select(*keys, "c.*")
    hits = save(first)
    out = hits.select(*keys, "w", "h", "mode", "box", "label", F.lit(False).alias("refined"), F.lit("coarse").alias("stage"), F.array(step(F.lit("coarse"), F.col("box"))).alias("trace"))
    if refine:
        w, h = F.col("w"), F.col("h")
        region = g.expand_box(F.col("box"), w, h, config.zoom_scale, config.zoom_pad, config.zoom_min_size)
        small = hits.where(~rules.too_big(F.col("box"), w, h, config.zoom_skip_area_frac)).withColumn("region", region)
        cut = small.withColumn("cut", g.crop(F.col("region"), w, h, F.lit(None).cast(g.TRANSFORM)))
        view = g.prepare(F.col("cut.w"), F.col("cut.h"), F.col("cut.tf"), F.lit(factor), F.lit(least), F.lit(most), F.lit(most))
        zoomed = save(backend(cut.withColumn("view", view).withColumn("prompt", prompt(REFINE_PROMPT, F.col("target"))).drop("box", "label", "cut")))
        found = boxes_on(zoomed)
        good = rules.refine_accepts(F.col("box"), F.col("region"), config.refine_containment)
        picked = rules.first_accepted(found.withColumn("hit", F.struct("box", F.col("item.label").alias("label"))), keys, "pos", good, "hit")
        large = rules.too_big(F.col("box"), w, h, config.zoom_skip_area_frac)
        looked = step(F.when(large, "zoom skipped").otherwise("zoom"), F.col("better"), F.when(~large, region))
        out = out.join(picked.select(*keys, F.col("hit.box").alias("better"), F.col("hit.label").alias("named")), keys, "left").select(
            *keys, "w", "h", "mode", F.coalesce("better", "box").alias("box"), F.coalesce(text.non_empty(F.col("named")), "label").alias("label"),
            F.col("better").isNotNull().alias("refined"), F.when(F.col("better").isNotNull(), "refined").otherwise("coarse").alias("stage"),
            F.array_append("trace", looked).alias("trace"),
        )
    if verify:
        out = save(out)
        region = g.expand_box(F.col("box"), F.col("w"), F.col("h"), 1.6, 12.0, 96.0)
        cut = g.crop(region, F.col("w"), F.col("h"), F.lit(None).cast(g.TRANSFORM))
        asked = out.withColumn("cut", cut).withColumn("view", g.prepare(F.col("cut.w"), F.col("cut.h"), F.col("cut.tf"), F.lit(factor), F.lit(least), F.lit(most), F.lit(least)))
        told = backend(asked.drop("cut").withColumn("prompt", prompt(VERIFY_PROMPT, F.col("target"))))
        sure = told.withColumn("confidence", text.yes_probability(F.col("answer")))
        checked = step(F.lit("verify"), F.col("box"), region, F.col("confidence"))
        return sure.select(*keys, "box", "label", "refined", "stage", "confidence", F.array_append("trace", checked).alias("trace"))
    return out.select(*keys, "box", "label", "refined", "stage", F.lit(None).cast("double").alias("confidence"), "trace")


def ground_all(answers: DataFrame, max_items: int = 20, key: str = "screen_id") -> DataFrame:
    """Every box of an answer, cut to ``max_items`` in the model's order, then in reading order; ``key`` tells answers apart."""
    some = boxes_on(answers).where(F.col("pos") < max_items).withColumn("ord", F.col("pos").cast("long"))
    return layout.reading_order(some, screen=key, carry=[c for c in some.columns if c not in (key, "ord")])


def ocr(answers: DataFrame, min_chars: int = 1) -> DataFrame:
    """(screen_id, position, box, text): lines of answers, cleaned, de-duplicated, in reading order."""
    lines = boxes_on(answers).select("screen_id", F.col("pos").cast("long").alias("ord"), "box", text.clean_line(F.col("item.text"), F.col("item.label")).alias("text"))
    kept = layout.dedupe_text(lines.where(F.length("text") >= min_chars))
    placed = layout.reading_order(kept, carry=["box", "text"])
    return placed.select("screen_id", "position", g.rounded(F.col("box")).alias("box"), "text")


def guide(answers: DataFrame, max_steps: int = 6) -> DataFrame:
    """(screen_id, n, instruction, target): steps numbered from 1."""
    told = parsing.with_value(answers.select("screen_id", "answer"), "answer", "_value")
    steps = told.select("screen_id", F.posexplode(parsing.steps_of("_value", "answer")).alias("pos", "step"))
    return steps.where(F.col("pos") < max_steps).select("screen_id", (F.col("pos") + 1).alias("n"), "step.instruction", "step.target")


def guide_counts(steps: DataFrame) -> DataFrame:
    """Steps resolved and groundable per screen; a null counts as neither."""
    return steps.groupBy("screen_id").agg(F.count_if("resolved").alias("resolved"), F.count("resolved").alias("groundable"))


def diff(answers: DataFrame, gap: int = 16) -> DataFrame:
    """Changes between two pictures side by side: (screen_id, pos, side, box, canvas_box, description)."""
    seen = told_items(answers)
    pixels = g.clamp_box(g.model_to_pixels(F.col("item.box"), F.col("view.w"), F.col("view.h"), F.col("mode")), F.col("view.w"), F.col("view.h"))
    canvas = seen.withColumn("canvas_box", g.to_original(F.col("view.tf"), pixels))
    side = rules.diff_side(F.col("canvas_box"), F.col("before_w") + gap, F.col("after_w"), F.col("after_h"))
    return canvas.withColumn("s", side).select(
        "screen_id", "pos", "s.side", g.rounded(F.col("s.box")).alias("box"), g.rounded(F.col("canvas_box")).alias("canvas_box"),
        text.first_truthy(F.col("item.label"), F.col("item.text")).alias("description"),
    )


def redact(found: DataFrame, pad: float = 3.0, method: str = "blur", threshold: float = 0.55) -> DataFrame:
    """Findings (screen_id, w, h, box, label, text, confidence) with kept flag, kind and mask."""
    grown = g.rounded(g.expand_box(F.col("box"), F.col("w"), F.col("h"), 1.0, pad))
    return found.withColumn("box", grown).select(
        "screen_id", "box", text.kind_of(F.col("label")).alias("kind"), "text", F.bround("confidence", 4).alias("confidence"),
        rules.redact_kept(F.col("confidence"), threshold).alias("kept"), rules.mask_pixels(F.col("box"), F.col("w"), F.col("h"), method).alias("mask"),
    )

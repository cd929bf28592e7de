"""Scores and aggregates of trials. Means and shares are rounded at the very end, half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import parsing
from .selection import at_share, beside, lower_middle, select_ranks, upper_middle, value_counts

THRESHOLDS = (0.0, 0.5, 0.75, 0.9)


def score_one(pred: Column, true: Column) -> Column:
    """struct<iou, click_hit, centre_error_px, area_ratio>."""
    p, t = g.center(pred), g.center(true)
    distance = F.sqrt((p["x"] - t["x"]) * (p["x"] - t["x"]) + (p["y"] - t["y"]) * (p["y"] - t["y"]))
    return F.struct(
        F.bround(g.iou(pred, true), 4).alias("iou"),
        g.point_in(p["x"], p["y"], true).alias("click_hit"),
        F.bround(distance, 1).alias("centre_error_px"),
        F.bround(g.area(pred) / F.greatest(F.lit(1.0), g.area(true)), 3).alias("area_ratio"),
    )


def with_scores(rows: DataFrame, pred: str = "pred_box", true: str = "true_box", found: str | None = None) -> DataFrame:
    """``rows`` with the fields of score_one() as columns, null where ``found`` is a false column.

    The same values in steps: sides, areas and centres are columns of their own first, so that generated code stays
    small enough to be compiled and computes each once.
    """
    p, t = F.col(pred), F.col(true)
    sides = {f"_{k}{axis}": (b[f"{axis}2"] - b[f"{axis}1"]) for k, b in (("p", p), ("t", t)) for axis in "xy"}
    sides |= {f"_o{axis}": F.greatest(F.lit(0.0), F.least(p[f"{axis}2"], t[f"{axis}2"]) - F.greatest(p[f"{axis}1"], t[f"{axis}1"])) for axis in "xy"}
    sides |= {f"_{k}{axis}": (b[f"{axis}1"] + b[f"{axis}2"]) / 2 for k, b in (("c", p), ("d", t)) for axis in "xy"}
    areas = {
        "_overlap": F.col("_ox") * F.col("_oy"),
        **{f"_{k}": F.greatest(F.lit(0.0), F.col(f"_{k}x")) * F.greatest(F.lit(0.0), F.col(f"_{k}y")) for k in "pt"},
        "click_hit": g.point_in(F.col("_cx"), F.col("_cy"), t),
        "centre_error_px": F.sqrt((F.col("_cx") - F.col("_dx")) * (F.col("_cx") - F.col("_dx")) + (F.col("_cy") - F.col("_dy")) * (F.col("_cy") - F.col("_dy"))),
    }
    shares = {"_union": F.col("_p") + F.col("_t") - F.col("_overlap"), "area_ratio": F.col("_p") / F.greatest(F.lit(1.0), F.col("_t"))}
    out = rows.withColumns(sides).withColumns(areas).withColumns(shares)
    out = out.withColumn("iou", F.when(F.col("_union") > 0, F.col("_overlap") / F.col("_union")).otherwise(0.0))
    rounded = {"iou": F.bround("iou", 4), "click_hit": F.col("click_hit"), "centre_error_px": F.bround("centre_error_px", 1), "area_ratio": F.bround("area_ratio", 3)}
    scores = rounded if found is None else {k: F.when(F.col(found), v) for k, v in rounded.items()}
    return out.select(*[F.col(c) for c in rows.columns], *[v.alias(k) for k, v in scores.items()])


#: Measures of a trial, by their numbers in value_counts()
ALL, FOUND, TIGHT, CENTRE, OUTCOME = range(5)
#: Order statistics of trials: the measure, and the rank
TRIAL_RANKS = {
    "iou_low": (FOUND, lower_middle), "iou_high": (FOUND, upper_middle),
    "centre_low": (CENTRE, lower_middle), "centre_high": (CENTRE, upper_middle),
    "latency_low": (ALL, lower_middle), "latency_high": (ALL, upper_middle), "latency_p90": (ALL, at_share(0.9)),
}


def trial_counts(trials: DataFrame, *keys: str) -> DataFrame:
    """Trials (found, click_hit, iou, centre_error_px, latency_s, box_kind) as counts of distinct values, in one pass.

    The last measure has the outcome in a few whole numbers: 1 if found, 2 more if hit, 4 more if tight.
    """
    found = F.coalesce(F.col("found"), F.lit(False))
    tight = found & (F.coalesce(F.col("box_kind"), F.lit("region")) == "tight")
    hit = found & F.coalesce(F.col("click_hit"), F.lit(False))
    outcome = found.cast("int") + 2 * hit.cast("int") + 4 * tight.cast("int")
    measures = [F.col("latency_s"), F.when(found, F.col("iou")), F.when(tight, F.col("iou")), F.when(found, F.col("centre_error_px")), outcome]
    return value_counts(trials, list(keys), measures)


def aggregate_counts(counts: DataFrame, *keys: str) -> DataFrame:
    """All aggregates of trials from their counts."""
    m, v, c = F.col("m"), F.col("v"), F.col("c")

    def total(measure: int, what: Column = c, where: Column | None = None) -> Column:
        condition = m == measure if where is None else (m == measure) & where
        return F.coalesce(F.sum(F.when(condition, what)), F.lit(0))

    def mean(measure: int) -> Column:
        return F.try_divide(F.sum(F.when(m == measure, v * c)), total(measure))

    bits = F.when(m == OUTCOME, v).cast("int")
    plain = counts.groupBy(*keys).agg(
        total(OUTCOME).alias("n"),
        total(OUTCOME, where=bits.bitwiseAND(1) > 0).alias("n_found"),
        total(OUTCOME, where=bits.bitwiseAND(2) > 0).alias("hits"),
        total(OUTCOME, where=bits.bitwiseAND(4) > 0).alias("tight_n"),
        *[total(k, where=v >= at).alias(f"{name}_{round(at * 100)}") for k, name in ((FOUND, "iou"), (TIGHT, "tight")) for at in (0.5, 0.75)],
        mean(FOUND).alias("iou"), mean(TIGHT).alias("tight"), mean(ALL).alias("latency"),
    )
    both = beside(plain, select_ranks(counts, list(keys), TRIAL_RANKS), list(keys))
    n, n_found, n_tight = F.col("n"), F.col("n_found"), F.col("tight_n")

    def middle(name: str) -> Column:
        return 0.5 * F.col(f"{name}_low") + 0.5 * F.col(f"{name}_high")

    return both.select(
        *keys,
        n,
        F.bround(F.try_divide(n_found, n), 4).alias("found_rate"),
        F.bround(F.try_divide("hits", n), 4).alias("click_accuracy"),
        F.coalesce(F.bround(F.try_divide("hits", n_found), 4), F.lit(0.0)).alias("click_accuracy_when_found"),
        F.coalesce(F.bround("iou", 4), F.lit(0.0)).alias("iou_mean"),
        F.coalesce(F.bround(middle("iou"), 4), F.lit(0.0)).alias("iou_median"),
        F.bround(F.try_divide("iou_50", n), 4).alias("iou_at_50"),
        F.bround(F.try_divide("iou_75", n), 4).alias("iou_at_75"),
        n_tight,
        F.bround("tight", 4).alias("tight_iou_mean"),
        F.bround(F.try_divide("tight_50", n_tight), 4).alias("tight_iou_at_50"),
        F.bround(F.try_divide("tight_75", n_tight), 4).alias("tight_iou_at_75"),
        F.bround(middle("centre"), 1).alias("centre_error_px_median"),
        F.bround("latency", 2).alias("latency_s_mean"),
        F.bround(middle("latency"), 2).alias("latency_s_median"),
        F.bround("latency_p90", 2).alias("latency_s_p90"),
    )


def aggregate_trials(trials: DataFrame, *keys: str) -> DataFrame:
    return aggregate_counts(trial_counts(trials, *keys), *keys)


def by_group(trials: DataFrame, key: str, *within: str) -> DataFrame:
    """Per value of a key as text; a null key is the text None."""
    return aggregate_trials(trials.withColumn("group_key", F.coalesce(F.col(key).cast("string"), F.lit("None"))), *within, "group_key")


def summary_sets(trials: DataFrame, first: str = "variant", others: tuple[str, ...] = ("scale", "role", "box_kind")) -> DataFrame:
    """Overall and by each other key, per variant, as grouping sets of one pass; a null key is the text None."""
    columns = [f"by_{k}" for k in (first, *others)]
    named = trials.withColumns({f"by_{k}": F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in (first, *others)})
    sets = [[columns[0]], *[[columns[0], c] for c in columns[1:]]]
    # values are counted once in the finest groups; the four groupings add those counts up
    finest = trial_counts(named, *columns)
    counts = finest.groupingSets([[F.col(c) for c in (*s, "m", "v")] for s in sets], *[F.col(c) for c in (*columns, "m", "v")]).agg(F.sum("c").alias("c"))
    return aggregate_counts(counts, *columns).withColumnRenamed(columns[0], first)


def confidence_analysis(trials: DataFrame, *keys: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold how much is acted on, and how precisely; trials without a confidence are left out."""
    known = trials.where("confidence IS NOT NULL")
    aggs = []
    for k, t in enumerate(thresholds):
        acted = F.col("confidence") >= t
        aggs += [F.count_if(acted).alias(f"a{k}"), F.count_if(acted & F.coalesce(F.col("click_hit"), F.lit(False))).alias(f"h{k}")]
    counts = known.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)
    each = F.array(*[F.struct(F.lit(t).cast("double").alias("threshold"), F.col(f"a{k}").alias("acted"), F.col(f"h{k}").alias("hits")) for k, t in enumerate(thresholds)])
    rows = counts.select(*keys, "n", F.explode(each).alias("e"))
    acted, hits = F.col("e.acted"), F.col("e.hits")
    return rows.select(
        *keys,
        F.col("e.threshold").alias("threshold"),
        acted.alias("acted_on"),
        (F.col("n") - acted).alias("abstained"),
        F.coalesce(F.bround(F.try_divide(acted, F.col("n")), 4), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.bround(F.try_divide(hits, acted), 4), F.lit(0.0)).alias("precision"),
    )


def ocr_score(pred: Column, true: Column) -> Column:
    """struct<recall, found, expected, read, spurious> of two arrays of normalised lines: a set read, a bag expected.

    Each side is computed once. Sets tell which lines are read as they are; only distinct lines that are not are looked for
    within others, in the one text of all that is read (a separator is in no normalised line, and lines that hold it are
    looked for one by one). Lines that are lost are counted in one pass over the sorted lines.
    """
    got, want = (F.filter(x, lambda line: line != "") for x in (F.array_distinct(pred), true))

    def lost(read: Column, expected: Column) -> Column:
        missing = F.array_except(expected, read)

        def within(all_read: Column) -> Column:
            held = lambda w: F.when(F.contains(w, F.lit("\n")), F.exists(read, lambda x: F.contains(x, w))).otherwise(F.contains(all_read, w))
            return F.filter(missing, lambda w: (F.length(w) <= 3) | ~held(w))

        return parsing.let(F.array_join(read, "\n"), within)

    def counted(expected: Column, gone: Column) -> Column:
        """How many entries of a bag are in a set: each entry of the set stands before those of the bag that equal it."""
        both = F.array_sort(F.concat(F.transform(gone, lambda w: F.struct(w.alias("w"), F.lit(0).alias("k"))), F.transform(expected, lambda w: F.struct(w.alias("w"), F.lit(1).alias("k")))))
        start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"))
        step = lambda s, x: F.struct(F.when(x["k"] == 0, x["w"]).otherwise(s["w"]).alias("w"), (s["n"] + ((x["k"] == 1) & x["w"].eqNullSafe(s["w"])).cast("int")).alias("n"))
        return F.when(F.size(gone) == 0, 0).otherwise(F.aggregate(both, start, step, lambda s: s["n"]))

    def score(read: Column, expected: Column, n_lost: Column) -> Column:
        found = F.size(expected) - n_lost
        return F.struct(
            F.coalesce(F.bround(F.try_divide(found, F.size(expected)), 4), F.lit(0.0)).alias("recall"),
            found.alias("found"), F.size(expected).alias("expected"), F.size(read).alias("read"),
            F.greatest(F.lit(0), F.size(read) - found).alias("spurious"),
        )

    return parsing.let(
        F.struct(got.alias("read"), want.alias("expected")),
        lambda s: parsing.let(lost(F.coalesce(s["read"], F.array().cast("array<string>")), s["expected"]), lambda gone: parsing.let(counted(s["expected"], gone), lambda n: score(s["read"], s["expected"], n))),
    )


def call_stats(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, latency and tokens of a backend's log."""
    latency = F.sum("latency_s")
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.bround(latency, 3).alias("total_latency_s"),
        F.bround(F.avg("latency_s"), 3).alias("mean_call_s"),
        F.bround(F.max("latency_s"), 3).alias("max_call_s"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("new_tokens").alias("new_tokens"),
        F.when(latency > 0, F.bround(F.sum("new_tokens") / latency, 2)).otherwise(0.0).alias("decode_tokens_per_s"),
    )


def resource_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """Wall time and memory of samples; the median is the upper one, not a mean of two."""
    plain = samples.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.bround(F.avg("wall_s"), 3).alias("wall_s_mean"),
        F.bround(F.max("wall_s"), 3).alias("wall_s_max"),
        F.bround(F.max("rss_peak_bytes") / 1_000_000, 1).alias("rss_peak_mb_max"),
    )
    ranks = select_ranks(value_counts(samples, list(keys), [F.col("wall_s")]), list(keys), {"_middle": (0, upper_middle), "_p90": (0, at_share(0.9))})
    rounded = [F.bround("_middle", 3).alias("wall_s_median"), F.bround("_p90", 3).alias("wall_s_p90")]
    return beside(plain, ranks, list(keys)).select(*keys, "n", "wall_s_mean", *rounded, "wall_s_max", "rss_peak_mb_max")


def absent_summary(trials: DataFrame, *keys: str) -> DataFrame:
    """How often something was returned, and acted on, for targets that are not there."""
    n = F.count("*")
    return trials.groupBy(*keys).agg(
        n.alias("n"), F.count_if("returned_box").alias("boxes_returned"), F.count_if("would_act").alias("would_act"),
        F.coalesce(F.bround(F.try_divide(n - F.count_if("would_act"), n), 4), F.lit(0.0)).alias("rejection_rate"),
    )


def yes_share(logits: Column, yes: list[int], no: list[int]) -> Column:
    """Yes against no from a whole softmax; null if both have less than a millionth of the mass. Ids count from 0."""
    top = F.array_max(logits)

    def mass(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))

    y, o = (mass(F.array(*[F.get(logits, F.lit(i)) for i in ids])) for ids in (yes, no))
    share = (y + o) / mass(logits)
    return F.when(share >= 1e-6, y / (y + o))


def pair_with_truth(hits: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("variant", "screen_id", "target")) -> DataFrame:
    """Trial rows: every target that was asked for, with its hit if there is one; scores are null where nothing was found.

    ``targets``: (keys..., true_box, and what else describes a target); ``hits``: (keys..., box, confidence, refined).
    """
    found = hits.select(*keys, F.col("box").alias("pred_box"), "confidence", "refined", F.lit(True).alias("found"))
    rows = targets.join(found, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False))).withColumn("refined", F.coalesce("refined", F.lit(False)))
    return with_scores(rows, found="found")


def peak_memory(samples: DataFrame, *keys: str) -> DataFrame:
    """Per run of (keys..., at, rss_bytes) samples: start, peak over all of them, and what the run added."""
    start, peak = F.min_by("rss_bytes", "at"), F.max("rss_bytes")
    return samples.groupBy(*keys).agg(start.alias("rss_start_bytes"), peak.alias("rss_peak_bytes"), (peak - start).alias("rss_delta_bytes"), F.count("*").alias("samples"))


def parameter_totals(tensors: DataFrame, *keys: str) -> DataFrame:
    """Parameters and bytes of live tensors (keys..., shape, itemsize)."""
    numel = F.aggregate("shape", F.lit(1).cast("long"), lambda n, d: n * d)
    return tensors.groupBy(*keys).agg(F.sum(numel).alias("parameters"), F.sum(numel * F.col("itemsize")).alias("bytes"))

"""Parameter audit from checkpoint headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAM_BUDGET = 6_000_000_000

#: Parts of tensor names by component; the first component that matches wins
COMPONENT_PARTS = [
    ("vision encoder", ("visual.blocks", "vision_tower", "vision_model", "visual.patch_embed", "visual.rotary", "vision_encoder")),
    ("vision-language projector", ("visual.merger", "multi_modal_projector", "mm_projector", "connector", "perceiver", "resampler", "modality_projection")),
    ("token embeddings", ("embed_tokens", "wte", "word_embeddings")),
    ("language backbone", ("model.layers", "language_model", "model.norm", "transformer.h")),
    ("output head", ("lm_head", "score", "classifier")),
]


def classify(name: Column) -> Column:
    out = None
    for component, parts in COMPONENT_PARTS:
        match = name.rlike("|".join(p.replace(".", r"\.") for p in parts))
        out = F.when(match, component) if out is None else out.when(match, component)
    return out.otherwise("other")


def count_of(shape: Column) -> Column:
    """Product of the dimensions."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda p, d: p * d)


def header_length(content: Column) -> Column:
    """The little-endian 64-bit length that opens a header; by hex pairs, as reversing binary reads it as text."""
    pairs = F.regexp_extract_all(F.hex(F.substring(content, 1, 8)), F.lit(".."), F.lit(0))
    return F.conv(F.concat_ws("", F.reverse(pairs)), 16, 10).cast("decimal(20,0)")


def parse_header(content: Column) -> Column:
    """map name -> struct<dtype, shape> of a header's JSON; an error if it is cut short or its length makes no sense."""
    size = F.octet_length(content)
    length = F.when(size >= 8, header_length(content))
    wrong = length.isNull() | (length <= 0) | (length + 8 > size)
    body = F.substring(content, F.lit(9), F.least(F.coalesce(length, F.lit(0)), F.lit(2**31 - 1)).cast("int")).cast("string")
    parsed = F.from_json(body, "map<string, struct<dtype: string, shape: array<bigint>>>")
    return F.when(wrong, F.raise_error(F.lit("header is too short or its length is wrong")).cast("map<string, struct<dtype: string, shape: array<bigint>>>")).otherwise(parsed)


def tensors(headers: DataFrame) -> DataFrame:
    """(model, file, pos, name, dtype, shape) from (model, file, content)."""
    return headers.select("model", "file", F.posexplode(F.map_entries(parse_header(F.col("content")))).alias("pos", "e")).select("model", "file", "pos", F.col("e.key").alias("name"), F.col("e.value.dtype").alias("dtype"), F.col("e.value.shape").alias("shape"))


def distinct_tensors(rows: DataFrame) -> DataFrame:
    """Real tensors, each name once: its first place, files in order."""
    real = rows.where((F.col("name") != "__metadata__") & F.col("shape").isNotNull() & (F.size("shape") > 0))
    first = real.groupBy("model", "name").agg(F.min(F.struct("file", "pos", "dtype", "shape")).alias("t"))
    return first.select("model", "name", F.col("t.file").alias("file"), F.col("t.pos").alias("pos"), F.col("t.dtype").alias("dtype"), F.col("t.shape").alias("shape"))


def audit(rows: DataFrame) -> DataFrame:
    """(model, total, components, dtypes, within_budget, headroom); maps are ordered by count, greatest first."""
    counted = distinct_tensors(rows).select("model", classify(F.col("name")).alias("component"), "dtype", count_of(F.col("shape")).alias("n"))
    parts = counted.groupBy("model", "component", "dtype").agg(F.sum("n").alias("n"))
    # few rows for each model by now: components and dtypes are closed sets
    comp = parts.groupBy("model", "component").agg(F.sum("n").alias("n"))
    kinds = parts.groupBy("model", "dtype").agg(F.sum("n").alias("n"))

    def as_map(df: DataFrame, key: str, name: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(key).alias("k"), "n")))
        return df.groupBy("model").agg(F.sum("n").alias("total"), F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["k"], e["n"]))).alias(name))

    both = as_map(comp, "component", "components").join(as_map(kinds, "dtype", "dtypes").drop("total"), "model")
    return both.select("model", "total", "components", "dtypes", (F.col("total") <= PARAM_BUDGET).alias("within_budget"), (PARAM_BUDGET - F.col("total")).alias("headroom"))


def notes(tied: Column, has_head: Column, components: Column) -> Column:
    """Remarks of a report: shared output head, parameters without a component, what is counted."""
    return F.filter(
        F.array(
            F.when(F.coalesce(tied, F.lit(False)) & ~has_head, "The output head shares the token embeddings' weights and is not stored; it is counted once, with them."),
            F.when(F.map_contains_key(components, "other"), F.concat(F.format_number(F.try_element_at(components, F.lit("other")), 0), F.lit(" parameters match no component; the total includes them."))),
            F.lit("Counted from tensor shapes: all stored parameters, whatever their precision or use at inference."),
        ),
        lambda n: n.isNotNull(),
    )


def tied_flag(config: Column) -> Column:
    """`tie_word_embeddings` of a configuration's JSON, else that of its text part, else null."""
    return F.coalesce(F.get_json_object(config, "$.tie_word_embeddings"), F.get_json_object(config, "$.text_config.tie_word_embeddings")).cast("boolean")


def audit_pipeline(reports: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("total"), F.lit(0))
    return reports.agg(total.alias("path_total_parameters"), F.bround(total / 1e9, 4).alias("path_total_parameters_b"), (total <= PARAM_BUDGET).alias("within_budget"), (PARAM_BUDGET - total).alias("headroom"))


def verify_runtime(total: Column, runtime: Column, tolerance: float = 0.005) -> Column:
    delta = runtime - total
    relative = F.abs(delta) / F.greatest(F.lit(1), total)
    return F.struct(delta.alias("delta"), F.bround(relative, 6).alias("relative_delta"), (relative <= tolerance).alias("agrees"))

"""Model registry and its two-stage lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key, checkpoint id, coordinate mode, factor, approximate parameters, MLX id, least and most pixels
MODELS = [
    ("qwen2.5-vl-3b", "Qwen/Qwen2.5-VL-3B-Instruct", "abs", 28, 3.75e9, "mlx-community/Qwen2.5-VL-3B-Instruct-4bit", 256 * 28 * 28, 1280 * 28 * 28),
    ("qwen2-vl-2b", "Qwen/Qwen2-VL-2B-Instruct", "rel1000", 28, 2.21e9, "mlx-community/Qwen2-VL-2B-Instruct-4bit", 256 * 28 * 28, 1024 * 28 * 28),
    ("qwen2.5-vl-7b", "Qwen/Qwen2.5-VL-7B-Instruct", "abs", 28, 8.29e9, None, 256 * 28 * 28, 1280 * 28 * 28),
]
SCHEMA = "key string, hf_id string, coord_mode string, factor int, approx_params double, mlx_id string, min_pixels int, max_pixels int"


def registry(spark: SparkSession) -> DataFrame:
    def literal(v: object) -> str:
        return "CAST(NULL AS STRING)" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)

    rows = ", ".join("(" + ", ".join(map(literal, m)) + ")" for m in MODELS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(c.split()[0] for c in SCHEMA.split(', '))})")


def lookup(requests: DataFrame, key: str = "model") -> DataFrame:
    """Requests with their model's record: by key, else by checkpoint id; an unknown one is an error.

    The registry is a fixed list of a few rows.
    """
    models = registry(requests.sparkSession)
    record = F.struct(*models.columns)
    by_key = models.select(F.col("key").alias(key), record.alias("_a"))
    by_id = models.select(F.col("hf_id").alias(key), record.alias("_b"))
    unknown = F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(F.col(key), F.lit("null"))))
    both = requests.join(F.broadcast(by_key), key, "left").join(F.broadcast(by_id), key, "left")
    found = both.withColumn("spec", F.coalesce("_a", "_b", unknown.cast(models.schema.simpleString()))).drop("_a", "_b")
    return found

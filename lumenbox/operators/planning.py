"""Benchmark plans: which targets are asked for, in which variants, and which phrases are absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The variants as (name, refine, verify)
VARIANTS = [("coarse", False, False), ("coarse+verify", False, True), ("refine", True, False), ("full", True, True)]



def unique_targets(elements: DataFrame, screen: str = "screen_id", name: str = "descriptor") -> DataFrame:
    """Elements whose description occurs once on their screen."""
    once = elements.groupBy(screen, name).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return elements.join(once, [screen, name], "left_semi")


def sample_key(seed: int, *columns: str) -> Column:
    """A reproducible random order: md5 of the seed and the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def pick_targets(elements: DataFrame, k: int, seed: int, screen: str = "screen_id", key: str = "ord") -> DataFrame:
    """Up to k elements of each screen, without replacement: a sampling operator."""
    order = Window.partitionBy(screen).orderBy(sample_key(seed, screen, key), key)
    return elements.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def plan(targets: DataFrame) -> DataFrame:
    """Every target in every variant: the variants are four fixed rows, exploded into each target."""
    options = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(r).alias("refine"), F.lit(v).alias("verify")) for n, r, v in VARIANTS])
    return targets.withColumn("v", F.explode(options)).select(*targets.columns, "v.variant", "v.refine", "v.verify")


def without_warm_up(calls: DataFrame, number: str = "call_no") -> DataFrame:
    """The first call of a run warms the model up and is not recorded."""
    return calls.where(F.col(number) > 0)


def absent_phrases(phrases: DataFrame, elements: DataFrame, screens: DataFrame, screen: str = "screen_id") -> DataFrame:
    """(screen, phrase) of phrases none of whose longer words is the whole text of an element of the screen.

    ``phrases`` is a short fixed list; its words meet the elements by an equi-join.
    """
    words = phrases.select("phrase", F.explode(F.filter(F.split(F.lower("phrase"), r"\s+"), lambda w: F.length(w) > 3)).alias("word"))
    present = elements.select(screen, F.lower("text").alias("word")).distinct().join(words, "word").select(screen, "phrase").distinct()
    listed = phrases.agg(F.collect_list("phrase").alias("all"))
    pool = screens.select(screen).distinct().join(F.broadcast(listed)).select(screen, F.explode("all").alias("phrase"))
    return pool.join(present, [screen, "phrase"], "left_anti")

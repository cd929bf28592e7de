"""An extension: row-wise rules and running trial counts over streams of trials.

Row-wise expressions of this package apply to streams unchanged; counts are kept per window of event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, rules


def scored(trials: DataFrame) -> DataFrame:
    """Streaming or batch trials (pred, true, found, confidence) with their scores and the decision."""
    return trials.withColumn("score", metrics.score_one(F.col("pred"), F.col("true"))).withColumn("accepted", rules.accepted(F.col("found"), F.col("confidence")))


def windowed_counts(trials: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Trials, hits found and accepted per variant and window; late rows beyond the watermark are dropped by the engine."""
    return (
        trials.withWatermark(time, late)
        .groupBy(F.window(time, window), "variant")
        .agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"), F.count_if(rules.accepted(F.col("found"), F.col("confidence"))).alias("n_accepted"))
    )

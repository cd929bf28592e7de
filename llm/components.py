"""Connected components as DataFrame rounds: roots hook onto smaller roots, then paths are halved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, c) for every end of ``edges`` (a, b); c is the smallest id that v reaches.

    Every round at least halves the roots of a component that still have an edge between them, so rounds
    grow with the logarithm of the longest path. All state is in tables; the driver sees emptiness only.
    Self-links and repeated edges are harmless.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = materialise(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("v"), F.col("a").alias("c")), "state")
    live, ended = edges.where("a <> b"), []
    while True:
        hooks = materialise(live.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("p")), "hooks")
        if not hooks.head(1):
            discard(edges, hooks, *ended)
            return state
        while True:  # r -> p -> p's p, until every p is a root
            up = hooks.select(F.col("r").alias("p"), F.col("p").alias("q"))
            further = materialise(hooks.join(up, "p", "left").select("r", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hooks")
            moved = bool(further.where("moved").head(1))
            discard(hooks)
            hooks = further.drop("moved")
            if not moved:
                break
        old = state
        state = materialise(old.join(hooks.withColumnRenamed("r", "c"), "c", "left").select("v", F.coalesce("p", "c").alias("c")), "state")
        ends = materialise(
            edges.join(state.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(state.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
            .where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(),
            "ends",
        )
        discard(old, hooks, *ended)
        live, ended = ends, [ends]

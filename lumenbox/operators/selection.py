"""Order statistics by distributed selection: exact values at given ranks of each group, without a group in one place.

Values are counted first, equal ones together, so that one shuffle carries each distinct value of a group once. A
histogram over logarithmic ranges tells which range holds a rank; that range is split evenly into finer ones, again
and again, and only the few values of the last range are sorted. Histograms have a bounded number of ranges, whatever
the number of values, and every level reads the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges for each factor of e, even parts of a range that is split, and how often ranges are split
PER_FOLD, PARTS, SPLITS = 64, 1 << 16, 2

Rank = Callable[[Column], Column]


def at_share(share: float) -> Rank:
    """The rank, from 0, at floor(share * n), or the last."""
    return lambda n: F.least(n - 1, F.floor(F.lit(share) * n))


def lower_middle(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def value_counts(rows: DataFrame, keys: list[str], measures: list[Column]) -> DataFrame:
    """(keys..., m, v, c): how often each value v that is not null occurs as measure number m."""
    each = F.array(*[F.struct(F.lit(k).alias("m"), x.cast("double").alias("v")) for k, x in enumerate(measures)])
    return rows.select(*keys, F.inline(each)).where("v IS NOT NULL").groupBy(*keys, "m", "v").agg(F.count("*").alias("c"))


def _range_of(v: Column) -> Column:
    """A whole number that does not fall where v rises; NaN stands above all, as it sorts."""
    size = F.floor(F.ln(F.abs(v)) * PER_FOLD) + 50_000  # above 0 for every double
    return F.when(F.isnan(v), 200_001).when(F.abs(v) == float("inf"), F.signum(v) * 200_000).when(v == 0, 0).otherwise(F.signum(v) * size).cast("long")


def _same(left: list[str], right: list[str]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition &= F.col(a).eqNullSafe(F.col(b))
    return condition


def _holding(bins: DataFrame, within: list[str], order: str) -> DataFrame:
    """Of the bins in ``order``, those that hold rank ``r`` of their partition; ``r`` then counts within the bin."""
    below = F.sum("c").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    return bins.withColumn("below", below).where("below <= r AND r < below + c").withColumn("r", F.col("r") - F.col("below")).drop("below", "c")


def select_ranks(counts: DataFrame, keys: list[str], wanted: dict[str, tuple[int, Rank]]) -> DataFrame:
    """(keys..., one column for each wanted name): the value of a measure at a rank, null without values.

    ``counts`` are value_counts(); ``wanted`` maps a name to the number of a measure and its rank as a function of n.
    """
    bins = counts.groupBy(*keys, "m", _range_of(F.col("v")).alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    n = F.sum("c").over(Window.partitionBy(*keys, "m"))
    stats = F.array(*[F.struct(F.lit(k).alias("stat"), F.lit(m).alias("of"), rank(F.col("n")).cast("long").alias("r")) for k, (m, rank) in enumerate(wanted.values())])
    below = F.sum("c").over(Window.partitionBy(*keys, "m").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    ranked = bins.withColumn("n", n).withColumn("below", below).select(*keys, "m", "c", "lo", "hi", "below", F.inline(stats))
    picks = ranked.where("of = m AND below <= r AND r < below + c").withColumn("r", F.col("r") - F.col("below")).drop("c", "below", "of")
    named = [f"_{k}" for k in keys]
    for _ in range(SPLITS):
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        part = F.when(hi > lo, F.least(F.lit(PARTS - 1), F.floor((v - lo) / (hi - lo) * PARTS))).otherwise(0)
        bins = _inside(counts, picks, keys, named).groupBy(*keys, "m", "stat", "r", part.alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        picks = _holding(bins, [*keys, "m", "stat"], "bin").drop("bin")
    values = _holding(_inside(counts, picks, keys, named).select(*keys, "m", "stat", "r", "v", "c"), [*keys, "m", "stat"], "v")
    return values.groupBy(*keys).agg(*[F.max(F.when(F.col("stat") == k, F.col("v"))).alias(name) for k, name in enumerate(wanted)])


def _inside(counts: DataFrame, picks: DataFrame, keys: list[str], named: list[str]) -> DataFrame:
    """The counts of the values in each picked range."""
    picked = picks.select(*[F.col(k).alias(x) for k, x in zip(keys, named, strict=True)], F.col("m").alias("_m"), "stat", "r", "lo", "hi")
    return counts.join(picked, _same(keys, named) & (F.col("m") == F.col("_m")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' columns, joined on keys that may be null; without keys each has one row."""
    if not keys:
        return left.crossJoin(right)
    named = [f"_{k}" for k in keys]
    renamed = right.withColumnsRenamed(dict(zip(keys, named, strict=True)))
    return left.join(renamed, _same(keys, named), "left").drop(*named)

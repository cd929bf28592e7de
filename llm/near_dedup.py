"""Near-duplicate groups from bottom-k sketches of one hash function.

A document is the set of its distinct word shingles. One hash function orders all shingles; a document
retains the k smallest of its set, its sketch, with k = n - ceil(t * n) + 1 for a set of n and the
threshold t. Two sets that reach the threshold share a retained value whatever the order is, so no link is
lost. The order is by level, then by hash: shingles of boilerplate and of large families of copies, which
would give long inverted lists, have higher levels the more documents hold them, as counted on the whole sets
of every SAMPLE-th document. The count decides the order alone, never the result; at most HOT_VALUES shingles
have a level, whatever the input.

1. Documents with the same set (size and 128-bit digest) become one class, represented by its smallest doc_id.
2. Inverted lists: retained value -> representatives, with size and position. Values held once go.
3. Every list proposes links between its most central member (least position, then size) and the others: one
   row for each membership, not one for each pair. Components follow from the proposals that are links.
4. Whatever lists still hold members of different components that their positions and sizes allow to link is
   proposed pair by pair, and components are taken again: the result is complete.

Proposals are filtered on the sketch of the union of two sets, merged from their own: of its values, c are
common, and beyond it no more than the shorter rest can be. That bound is certain, where an estimate (c over the
size of the union's sketch) would lose links; what passes is verified by exact Jaccard on full sets.

Edge cases: texts without words (or null) have the empty set, link with nothing and stand alone; a text of
fewer words than a shingle has one shingle, its whole word sequence; rows of the same text link at once by
class; extra columns are ignored; an empty table gives an empty result. doc_id must be unique and not null.
Shingles are compared as 63-bit hashes (57 bits within sketches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .components import connected_components
from .shingles import each_slice, ragged

HOT_VALUES = 1 << 20
SAMPLE = 4
#: Values that the sample holds more often have a level
HOT_LEAST = 2
ID_BUCKETS = 1 << 17
#: Sampled shingles that a task counts together before it sends counts on
COUNTED = 1_000_000


def _retained(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, digest) of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in each_slice(batches, words):
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "n", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, digest binary")


def _tops(s: np.ndarray) -> np.ndarray:
    return (s >> 32).astype(np.int32)


def _hot(docs: DataFrame, words: int, sample: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash tops of values of many documents, ascending, and their levels; HOT_VALUES of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            tops, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tops, pa.int32()), pa.array(n, pa.int64())], names=["h", "n"])

        for _, sets in each_slice(batches, words):
            held += [_tops(s) for s in sets]
            if sum(map(len, held)) > COUNTED:
                yield counted()
                held = []
        if held:
            yield counted()

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0) if sample > 1 else docs
    level = F.least(F.lit(63), F.floor(2 * F.log2("n"))).cast("int")
    counts = some.mapInArrow(run, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    counts = materialise(counts.select("h", level.alias("level")), "counts")
    # at most 64 levels; the lowest go until HOT_VALUES values are left
    lowest, total = 64, 0
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > HOT_VALUES:
            break
        lowest = r["level"]
    hot = counts.where(F.col("level") >= lowest).orderBy("h").toPandas()
    discard(counts)
    return hot["h"].to_numpy(np.int32), hot["level"].to_numpy(np.int64)


def _sketches(docs: DataFrame, words: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, head): the retained values in their order, level and hash in one number."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, levels = shared.value
        for batch, sets in each_slice(batches, words):
            heads = []
            for s in sets:
                keys = s >> 6
                if len(tops) and len(s):
                    mine = _tops(s)
                    at = np.minimum(np.searchsorted(tops, mine), len(tops) - 1)
                    keys = keys | np.where(tops[at] == mine, levels[at], 0) << 57
                    keys = np.sort(keys)
                heads.append(keys[: _retained(len(s), percent)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()), ragged(heads, pa.int64())], names=["doc_id", "n", "head"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, head array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, members) of the documents in ``ids``.

    A broadcast of at most ID_BUCKETS hash buckets of the ids keeps most other texts out of the shuffle.
    """

    def bucket(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in each_slice(batches, words):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ragged(sets, pa.int64())], names=["doc_id", "members"])

    near = docs.withColumn("bucket", bucket("doc_id")).join(F.broadcast(ids.select(bucket("doc_id").alias("bucket")).distinct()), "bucket", "left_semi")
    return near.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, members array<long>")


def _reaches(inter: Column, n: Column, m: Column, percent: int) -> Column:
    return inter.cast("long") * 100 >= (n + m - inter).cast("long") * percent


def _possible(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """If the value at i and j is the first that two members share, no more can follow than the shorter rest."""
    return _reaches(F.least(n - i, m - j), n, m, percent)


def _union_reaches(percent: int) -> Column:
    """Whether sketches ha, hb of sets of na, nb allow the threshold, by the sketch of the union."""
    last = F.least(F.element_at("ha", -1), F.element_at("hb", -1))
    i, j = (F.size(F.filter(h, lambda x: x <= last)) for h in ("ha", "hb"))
    common = F.size(F.array_intersect("ha", "hb"))
    return _reaches(common + F.least(F.col("na") - i, F.col("nb") - j), F.col("na"), F.col("nb"), percent)


def _confirmed(pairs: DataFrame, held: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the threshold."""

    def sketch(key: str) -> DataFrame:
        return held.select(F.col("doc_id").alias(key), F.col("n").alias(f"n{key}"), F.col("head").alias(f"h{key}"))

    def side(key: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(key), F.col("members").alias(f"m{key}"))

    likely = materialise(pairs.join(sketch("b"), "b").join(sketch("a"), "a").where(_union_reaches(percent)).select("a", "b"), "likely")
    ids = materialise(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = materialise(_full_sets(docs, ids, words), "sets")
    inter = F.size(F.array_intersect("ma", "mb"))
    exact = likely.join(side("b"), "b").join(side("a"), "a").where(_reaches(inter, F.size("ma"), F.size("mb"), percent))
    links = materialise(exact.select("a", "b"), "links")
    discard(likely, ids, sets)
    return links


def _ordered_pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_dedup(docs: DataFrame, percent: int = 85, words: int = 5, sample: int = SAMPLE, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    Documents link when 100 * |intersection| >= percent * |union|; component_id is the smallest doc_id that
    links reach, kept marks it.
    """
    docs = docs.select("doc_id", "text")
    facts = materialise(_classes(docs, words), "facts")
    classes = materialise(facts.where("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    hot = _hot(docs, words, sample, hot_least)
    held = materialise(_sketches(docs, words, percent, hot).join(reps, "doc_id", "left_semi"), "held")

    postings = held.select("doc_id", "n", F.posexplode("head").alias("i", "h"))
    values = materialise(postings.groupBy("h").count().where("count > 1").select("h"), "values")
    lists = materialise(postings.join(values, "h", "left_semi"), "lists")
    discard(values)
    centres = lists.groupBy("h").agg(F.min(F.struct("i", "n", "doc_id")).alias("c"))
    proposed = lists.join(centres, "h").where((F.col("doc_id") != F.col("c.doc_id")) & _possible(F.col("n"), F.col("i"), F.col("c.n"), F.col("c.i"), percent))
    first = materialise(proposed.select(*_ordered_pairs("doc_id", "c.doc_id")).distinct(), "first")
    links = _confirmed(first, held, docs, words, percent)
    comps = connected_components(links)

    # the rest: members of one list in different components, as far as their bounds allow a link
    own = materialise(lists.join(comps.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "own")
    mixed = own.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h")
    left = materialise(own.join(mixed, "h", "left_semi"), "left")
    discard(lists, own, comps)
    x, y = (left.select(*[F.col(c).alias(f"{s}_{c}") for c in left.columns]) for s in "xy")
    apart = (F.col("x_h") == F.col("y_h")) & (F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_c") != F.col("y_c"))
    may = _possible(F.col("x_n"), F.col("x_i"), F.col("y_n"), F.col("y_i"), percent)
    rest = materialise(x.join(y, apart & may).select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct(), "rest")
    more = _confirmed(rest.join(first, ["a", "b"], "left_anti"), held, docs, words, percent)
    discard(first, rest, left, held)
    comps = connected_components(links.unionByName(more))

    named = materialise(classes.join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("n", "digest", F.coalesce("c", "rep").alias("component_id")), "named")
    discard(classes, comps, links, more)
    return (
        facts.join(named, ["n", "digest"], "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85, words=5)

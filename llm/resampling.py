"""Importance resampling towards a target: documents whose words are likelier in a target text than in the corpus.

Every document is read once, in blocks of neighbouring rows: a block keeps its distinct features (runs of words)
with their counts, and for each of its documents the numbers of its features and how often it holds them. The
blocks' features are counted together, with the target's, in one dictionary of distinct strings; each string is
hashed once, buckets are summed over the dictionary, and each string gets its bucket's gain. The gains then go
back by a join of blocks' features with the dictionary, a row for each block that holds a string instead of one for
each document, and meet the documents' counts block by block. Ranks come from one sort in ranges.

A block is the words of about BLOCK bytes of text, or one longer document; it is stored in rows of a document or of
CHUNK features, as readers and writers hold many rows at once. A very common word has a row for each
block; both sides of its join are plain exchanges of tables, so such a key can be split.

Edge cases: null text has no words; a document without features has weight 0. A repeated doc_id is drawn as often
as it ranks. A null doc_id counts in all statistics, but has no score and is not drawn, nor counted among those
that may be. Ties go to the smaller doc_id. Without target text all gains follow from its counts of 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, numbered, table, text_slices

#: Bytes of text whose words form one block
BLOCK = 4_000_000
#: Features of a block that are one row
CHUNK = 1024
#: Bytes other than those of words go, A-Z become lower case
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes | None, longest: int) -> tuple[int, list[bytes]]:
    """The number of words of a text, and its runs of 1 to ``longest`` words."""
    words = (text or b"").translate(_WORDS).split()
    runs = words
    for n in range(2, longest + 1):
        runs = runs + [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return len(words), runs


def _blocks(docs: DataFrame, longest: int) -> DataFrame:
    """Blocks in rows of their documents, each with its part in the block's features, and rows of up to CHUNK of these and their counts.

    A feature's number is ``first`` and its place in the row's list. No row is longer than one document or CHUNK
    features, however many blocks a task makes, so writers and readers of whole batches of rows hold a few MB.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, doc_id {doc_id}, n_words long, which array<int>, times array<int>, first int, feature array<string>, count array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names = TaskContext.get().partitionId() << 33, ["block", "doc_id", "n_words", "which", "times", "first", "feature", "count"]
        for block, batch in enumerate(text_slices(batches, limit=BLOCK)):
            number: dict[bytes, int] = {}
            words, sizes, which, times = [], [0], [], []
            for text in batch.column("text").to_pylist():
                n, runs = features(text, longest)
                held = Counter(runs)
                which.append([number.setdefault(f, len(number)) for f in held])
                times.append(held.values())
                words.append(n)
                sizes.append(len(held))
            which, times = np.fromiter(chain.from_iterable(which), np.int32), np.fromiter(chain.from_iterable(times), np.int32)
            total = np.bincount(which, weights=times, minlength=len(number)).astype(np.int64)
            listed, ends, n = pa.array([f.decode("utf-8", "replace") for f in number], pa.string()), pa.array(np.cumsum(sizes), pa.int32()), batch.num_rows
            parts = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (which, times)]
            none = [pa.nulls(n, kind) for kind in (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task + block)), batch.column("doc_id"), pa.array(words, pa.int64()), *parts, *none], names=names)
            first = np.arange(0, len(number), CHUNK, dtype=np.int32)
            ends, n = pa.array([*first, len(number)], pa.int32()), len(first)
            none = [pa.nulls(n, kind) for kind in (batch.column("doc_id").type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            lists = [pa.ListArray.from_arrays(ends, x) for x in (listed, pa.array(total))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task + block)), *none, pa.array(first), *lists], names=names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _gain(n: Column, s: Column, t: Column, total: Column, target: Column, buckets: int) -> Column:
    """floor(1000 * ln of how much likelier a bucket is in the target), smoothed by one for each bucket."""
    ratio = (t + 1).cast("double") * (total + buckets).cast("double") / ((s + 1).cast("double") * (target + buckets).cast("double"))
    return F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long")


def importance_resampling(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row per document; rank is null for those not drawn.

    ``target`` has a column ``text``. A document's weight is the floored mean of its features' gains; its score adds
    Gumbel noise from a hash of seed and doc_id, so that the highest scores are a sample without replacement with
    chances by weight. Of the documents with ``least_words`` words, ``percent`` of a hundred are drawn (rounded down).
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    blocks = materialise(_blocks(docs, longest), "blocks", "zstd")
    listed = blocks.where("feature IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("feature", "count")).alias("at", "x"))
    held = listed.select("block", (F.col("first") + F.col("at")).alias("k"), F.col("x.feature").alias("feature"), F.col("x.count").alias("count"))
    wanted = _blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest).select(F.inline(F.arrays_zip("feature", "count")))
    counts = (
        held.select("feature", F.col("count").alias("s"), F.lit(0).cast("long").alias("t"))
        .unionByName(wanted.select("feature", F.lit(0).cast("long").alias("s"), F.col("count").alias("t")))
        .groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        .withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)
    )
    dictionary = materialise(counts, "dictionary", "zstd")
    # as many rows as there are buckets, whatever the corpus
    bucket_counts = materialise(dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).coalesce(1), "buckets")
    total = bucket_counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).head()
    gains = bucket_counts.select("bucket", _gain(F.lit(0), F.col("s"), F.col("t"), F.lit(total["s"]), F.lit(total["t"]), buckets).alias("gain"))
    gained = materialise(dictionary.where("s > 0").join(F.broadcast(gains), "bucket").select("feature", F.col("gain").cast("int").alias("gain")), "gained", "zstd")
    discard(dictionary, bucket_counts)
    # lists of what a task has of a block, combined before they are moved; as long as a block has features
    back = held.select(F.col("block").alias("of_block"), "k", "feature").join(gained, "feature").groupBy("of_block").agg(F.collect_list("k").alias("k"), F.collect_list("gain").alias("gain"))

    def weigh(block: pa.Table, gain: pa.Table) -> pa.Table:
        """One block's documents: the sums of their features' gains."""
        part = block.column("which").combine_chunks()
        which, times = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("which", "times"))
        k, gains = (gain.column(c).combine_chunks().flatten().to_numpy() for c in ("k", "gain"))
        by_feature = np.zeros(len(k), np.int64)
        by_feature[k] = gains
        sizes = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        sums = _sums(by_feature[which] * times, sizes)
        n = _sums(times.astype(np.int64), sizes)
        weight = np.where(n > 0, sums // np.maximum(n, 1), 0)  # floors downwards
        return pa.table({"doc_id": block.column("doc_id"), "n_words": block.column("n_words"), "n_features": n, "weight": weight})

    packs = blocks.where("which IS NOT NULL").select("block", "doc_id", "n_words", "which", "times")
    weighed = packs.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(weigh, f"doc_id {doc_id}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296.0)))
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "scored")
    discard(blocks, gained)
    may = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = numbered(scored.where(may), [F.desc("score"), F.asc("doc_id")], "rank")
    rank = F.col("rank") + 1
    ranked = drawn.withColumn("rank", F.when(rank <= F.lit(scored.where(may).count() * percent // 100), rank))
    return ranked.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Exact sums of consecutive runs of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH one AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b::BIGINT)) AS crc_of
), words AS (
  SELECT 'd' AS kind, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark
), per_doc AS (
  SELECT kind, doc_id, word, count(*) AS n FROM words GROUP BY ALL
), spelled AS (
  SELECT word, hex(word) AS h, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 't') AS t FROM per_doc GROUP BY word
), hashed AS (
  SELECT word, coalesce(s, 0) AS s, coalesce(t, 0) AS t, xor(4294967295, list_reduce(
    list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM spelled, one
), totals AS (
  SELECT sum(s)::BIGINT AS ss, sum(t)::BIGINT AS tt FROM hashed
), gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((sum(t) + 1)::DOUBLE * (any_value(ss) + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (any_value(tt) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM hashed, totals GROUP BY bucket
), weighed AS (
  SELECT p.doc_id, sum(p.n)::BIGINT AS n_features, floor(sum(p.n * g.gain)::DOUBLE / sum(p.n))::BIGINT AS weight
  FROM per_doc p JOIN hashed h USING (word) JOIN gains g USING (bucket) WHERE p.kind = 'd' GROUP BY p.doc_id
), scored AS (
  SELECT d.doc_id, coalesce(w.n_features, 0) AS n_features, coalesce(w.weight, 0) AS weight,
         coalesce(w.weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS among FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN p.place <= 10 * p.among // 100 THEN p.place END AS rank
FROM scored s LEFT JOIN placed p USING (doc_id)
"""

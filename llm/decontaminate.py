"""Benchmark decontamination by latent semantic retrieval.

The benchmark is cut into passages of at most ITEM_WORDS words. Document frequencies of its words are counted
over all documents in one pass. Passages are searched in groups of at most GROUP passages and GROUP_WORDS
distinct words, so what tasks hold of a group is bounded; each group is one pass over the documents.

1. Randomised SVD, distributed: TF-IDF rows of the group's passages are multiplied with a random matrix where
   they lie, partial products are summed in the cluster, and the small result is orthogonalised; further
   passes rotate and truncate it to RANK dimensions, the latent space.
2. Every document is cut into overlapping windows, which are projected into the latent space. Passages with a
   cosine of at least COSINE are candidates. A window that holds too few of all passages' rarest words to
   reach any needed common subsequence is not projected: that bound is certain and loses nothing.
3. The longest common subsequence of words (bit-parallel) must cover LCS of the passage, and the passage's
   last words, its answer, must be covered by half, or nearly the whole passage be there.

The latent space is fitted on the benchmark's passages, which are what is looked for. (Fitted on corpus windows as
well, 128 dimensions follow the corpus's languages: of planted passages a tenth fell under a cosine of 0.32.)

Edge cases: documents or items that are null or without words match nothing; passages of less than
SHORT words must be there whole and are candidates by their rarest word, as their cosine says nothing; an item
that repeats is reported by each of its ids, and so are all items of one passage: none wins over another; an
item_id on several rows holds all their texts; documents are independent of each other; an empty benchmark
leaves every document clean; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_slices
from .tfidf import Vocabulary, word_hashes

GROUP, GROUP_WORDS = 4096, 1 << 16
RANK, SPARE = 128, 16  # dimensions, and those more that the randomised range has
ITEM_WORDS = 64
WINDOW, STRIDE = 96, 32  # words; every run of ITEM_WORDS words lies in one window
COSINE = 0.35
LCS = 0.7
LCS_WITHOUT_ANSWER = 0.85
SHORT = 8
KEYS = 2
ROW_BLOCK = 256  # words whose rows of a partial product travel together
FIT_TASKS = 8


def item_passages(ids: list[int], texts: list[str | None]) -> tuple[list[int], list[np.ndarray]]:
    """Passages of all items: (item id, word hashes)."""
    hashes, first = word_hashes(texts)
    out_ids, out = [], []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for p in range(a, max(a + 1, b - ITEM_WORDS // 2), ITEM_WORDS // 2) if b - a > ITEM_WORDS else [a] * (b > a):
            out_ids.append(ids[k])
            out.append(hashes[p : min(b, p + ITEM_WORDS)])
    return out_ids, out


@dataclass
class Group:
    """What a task needs to search one group of passages; bounded by GROUP and GROUP_WORDS."""

    items: list[int]
    words: list[np.ndarray]  # of each passage, vocabulary numbers
    vocabulary: Vocabulary
    keys: np.ndarray  # bool by vocabulary number
    latent: np.ndarray  # word -> latent space, idf within
    latent_items: np.ndarray  # unit vectors
    short: dict[int, list[int]]  # rarest word of a short passage -> passages


def needed(n: int) -> int:
    """Words of a passage of n that have to be found in order."""
    return n if n < SHORT else int(np.ceil(LCS * n))


def _document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        df, n = np.zeros(len(vocab), np.int64), 0
        for batch in text_slices(batches):
            hashes, first = word_hashes(batch.column("text").to_pylist())
            numbers = vocab.numbers(hashes)
            at = np.flatnonzero(numbers >= 0)
            text = np.searchsorted(first, at, "right") - 1
            df += np.bincount(np.unique(text * len(vocab) + numbers[at]) % len(vocab), minlength=len(vocab))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocab))), pa.array(np.concatenate([[n], df]))], names=["word", "n"])

    sums = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[sums["word"].to_numpy() + 1] = sums["n"].to_numpy()
    return out[1:], int(out[0])


def _latent_space(passages: DataFrame, size: int, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """(word, dimension): the ``rank`` leading right singular vectors of the TF-IDF matrix of ``passages`` (words array<int>)."""
    spark = passages.sparkSession
    start = np.random.default_rng(seed).standard_normal((size, min(rank + SPARE, size))).astype(np.float32)
    weights = spark.sparkContext.broadcast(idf)

    def product(right: np.ndarray) -> np.ndarray:
        """A' (A right), summed over the rows of A where they lie."""
        shared = spark.sparkContext.broadcast(right)
        wide = right.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r, w = shared.value, weights.value
            out = np.zeros_like(r)
            for batch in batches:
                for row in batch.column("words").to_pylist():
                    cols, n = np.unique(row, return_counts=True)
                    x = (n * w[cols]).astype(np.float32)
                    x /= np.linalg.norm(x)
                    out[cols] += x[:, None] * (x @ r[cols])
            for k in range(0, len(out), ROW_BLOCK):
                if out[k : k + ROW_BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([out[k : k + ROW_BLOCK].tobytes()], pa.binary())], names=["row", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, parts in zip(batch.column("row").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                    total = sum(np.frombuffer(x, np.float32) for x in sorted(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["row", "part"])

        parts = passages.select("words").mapInArrow(run, "row long, part binary")
        gathered = parts.groupBy("row").agg(F.collect_list("part").alias("parts"))  # one from each of FIT_TASKS tasks
        out = np.zeros_like(right)
        for r in gathered.mapInArrow(add, "row long, part binary").collect():  # GROUP_WORDS * (rank + SPARE) numbers at most
            block = np.frombuffer(r["part"], np.float32).reshape(-1, wide)
            out[r["row"] : r["row"] + len(block)] = block
        return out

    q, _ = np.linalg.qr(product(start))
    q, _ = np.linalg.qr(product(q.astype(np.float32)))
    values, vectors = np.linalg.eigh(q.T @ product(q.astype(np.float32)))
    lead = np.argsort(-values)[:rank]
    lead = lead[values[lead] > 1e-6 * max(values.max(initial=0), 1e-12)]
    return (q @ vectors[:, lead]).astype(np.float32)


def prepare(spark: SparkSession, items: list[int], passages: list[np.ndarray], everything: Vocabulary, df: np.ndarray, n: int) -> Group:
    vocabulary = Vocabulary(np.concatenate(passages))
    df = df[everything.numbers(vocabulary.hashes)]
    idf = np.log((n + 1) / (df + 1)) + 0.05
    words = [vocabulary.numbers(p) for p in passages]
    keys = np.zeros(len(vocabulary), bool)
    short: dict[int, list[int]] = {}
    for k, w in enumerate(words):  # the rarest words; at least KEYS of them (or all of a single word) are in any window that reaches the needed length
        order = w[np.argsort(df[w], kind="stable")]
        keys[order[: len(w) - needed(len(w)) + KEYS]] = True
        if len(w) < SHORT:
            short.setdefault(int(order[0]), []).append(k)
    rows = spark.createDataFrame([(w.tolist(),) for w in words], "words array<int>").repartition(FIT_TASKS)
    basis = _latent_space(rows, len(vocabulary), idf)
    latent = basis * idf[:, None].astype(np.float32)
    vectors = np.stack([latent[w].sum(axis=0) for w in words])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Group(items, words, vocabulary, keys, latent, vectors, short)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    full = (1 << len(a)) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    v = full
    for x in b:
        if m := places.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def covers(passage: list[int], window: list[int]) -> float:
    """Share of the passage that the window holds in order; 0 if it is too little or the answer is missing."""
    n = len(passage)
    common = lcs(passage, window)
    if common < needed(n):
        return 0.0
    if common < LCS_WITHOUT_ANSWER * n:
        answer = passage[-max(3, n // 5) :]
        if lcs(answer, window) * 2 < len(answer):
            return 0.0
    return common / n


def search(group: Group, texts: list[str | None]) -> list[dict[int, float]]:
    """For each text the items that it holds, with the share found."""
    out: list[dict[int, float]] = [{} for _ in texts]
    hashes, first = word_hashes(texts)
    numbers = group.vocabulary.numbers(hashes)
    known = np.flatnonzero(numbers >= 0)
    if not len(known):
        return out
    text = np.searchsorted(first, known, "right") - 1
    chunks = -(-np.diff(first) // STRIDE)  # chunks of each text
    before = np.concatenate([[0], np.cumsum(chunks)])
    chunk = before[text] + (known - first[text]) // STRIDE
    numbers = numbers[known]
    hits = np.bincount(chunk[group.keys[numbers]], minlength=before[-1])
    wide = WINDOW // STRIDE
    owner = np.repeat(np.arange(len(texts)), chunks)
    ends = np.minimum(np.arange(before[-1]) + wide, before[owner + 1])  # windows end with their text
    sums = np.concatenate([[0], np.cumsum(hits)])
    windows = np.flatnonzero(sums[ends] - sums[:-1] >= min(KEYS, *(len(w) for w in group.words)))
    edges = np.searchsorted(chunk, np.arange(before[-1] + 1))
    listed: dict[int, list[int]] = {}
    for w0 in range(0, len(windows), 512):
        some = windows[w0 : w0 + 512]
        starts, sizes = edges[some], edges[ends[some]] - edges[some]
        offsets = np.cumsum(sizes) - sizes
        flat = np.repeat(starts - offsets, sizes) + np.arange(sizes.sum())
        vectors = np.add.reduceat(group.latent[numbers[flat]], offsets, axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        found = {(int(k), int(p)) for k, p in zip(*np.nonzero(vectors @ group.latent_items.T >= COSINE), strict=True)}
        if group.short:
            found |= {(k, p) for k, (a, m) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)) for w in numbers[a : a + m].tolist() for p in group.short.get(w, ())}
        for k, p in sorted(found):
            t, item = owner[some[k]], group.items[p]
            if out[t].get(item, 0) >= 1:
                continue
            if p not in listed:
                listed[p] = group.words[p].tolist()
            share = covers(listed[p], numbers[starts[k] : starts[k] + sizes[k]].tolist())
            if share:
                out[t][item] = max(share, out[t].get(item, 0))
    return out


def grouped(passages: list[np.ndarray]) -> list[tuple[int, int]]:
    """Ranges of passages that make a group."""
    out, a, words = [], 0, set()
    for k, p in enumerate(passages):
        new = words | set(p.tolist())
        if k > a and (k - a >= GROUP or len(new) > GROUP_WORDS):
            out.append((a, k))
            a, new = k, set(p.tolist())
        words = new
    return [*out, (a, len(passages))] if passages else []


ITEMS = "array<struct<item_id: long, share: double>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items array<struct<item_id, share>>), one row per document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    # the benchmark is what is searched for, and does not grow with the documents; tasks hold a group of it
    listed = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL").orderBy("item_id", "text").collect()
    ids, passages = item_passages([r["item_id"] for r in listed], [r["text"] for r in listed])
    if not passages:
        return docs.select("doc_id", F.lit(False).alias("contaminated"), F.array().cast(ITEMS).alias("items"))
    everything = Vocabulary(np.concatenate(passages))
    df, n = _document_frequencies(docs, everything)
    parts = [_searched(docs, prepare(spark, ids[a:b], passages[a:b], everything, df, n)) for a, b in grouped(passages)]
    if len(parts) == 1:
        each = parts[0]
    else:
        hits = reduce(DataFrame.unionByName, [materialise(p.where(F.size("items") > 0), "hits") for p in parts])
        most = hits.select("doc_id", F.inline("items")).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
        held = most.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "share"))).alias("items"))  # at most the benchmark's items
        each = docs.select("doc_id").join(held, "doc_id", "left").withColumn("items", F.coalesce("items", F.array().cast(ITEMS)))
    return each.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")


def _searched(docs: DataFrame, group: Group) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))
        for batch in text_slices(batches):
            hits = search(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([[{"item_id": i, "share": s} for i, s in sorted(h.items())] for h in hits], kind)], names=["doc_id", "items"])

    return docs.mapInArrow(run, f"doc_id long, items {ITEMS}")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

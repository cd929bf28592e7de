"""Removal of repeated 100-byte strings by prefix-free parsing.

A rolling hash picks triggers: of every window of ``length`` bytes the K-byte string of least hash. Runs of
windows with the same trigger make a phrase: the bytes that those windows cover. So every window lies in one
phrase, phrases are at most 2 * length bytes long, and equal windows lie in phrases with the same trigger.

1. Triggers that occur once in the corpus cannot hold a repeat and go. (A bitmap of bounded size of
   the repeated ones keeps most others out of the shuffle; exactness doesn't rest on it.)
2. Parse: each document's phrases in order, by name (trigger and a 128-bit cryptographic digest). Sorted by name,
   then place, as its suffix array is to the depth of one phrase, which holds whole windows, it gives every
   distinct phrase its first place in corpus order. Every window of a later occurrence repeats.
3. Dictionary: distinct phrases. Those that share a trigger with another may share some windows; their bytes are
   fetched and the suffix array of these phrases is built, ordered by ``length`` bytes (prefix doubling, so
   bytes are compared, not hashes). Neighbours with a common prefix of ``length`` bytes are one window.
4. Combined: of neighbours in the dictionary's suffix array the one whose phrase stands first in the parse is
   the window's first place in the corpus; the others repeat. Triggers are independent of each other, so
   arrays are built for many small groups of phrases at once; the windows of a trigger with more than TOGETHER
   phrases are ordered by the cluster, row by row, on their bytes as well.
5. A document's repeated windows are merged to spans and cut out.

Only that part of the corpus's suffix order is made that can hold neighbours with ``length`` bytes in common: a
whole order would be a row for each byte of the corpus. Corpus order is by doc_id, then by place. What is combined
is aggregated before it is moved, so a passage that a third of all documents holds costs each task one row.

Edge cases: null text is empty; texts shorter than ``length`` keep all bytes; repeats may overlap
themselves (a run of one byte); matches never cross documents; rows of equal text: all but the first lose
their repeated windows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap_of, may_hold
from .common import discard, flat_bytes, materialise, prefix_hash, range_hash, table, text_slices

LENGTH = 100
TRIGGER = 32
TOGETHER = 1000
GROUPS = 200  # of phrases that one suffix array is built for
ID_BUCKETS = 1 << 17


def phrases(texts: list[bytes], length: int = LENGTH, k: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat bytes, start of each text, text, trigger hash, first window, last window) of all phrases; windows are flat places."""
    flat, starts = flat_bytes(texts)
    none = np.empty(0, np.int64)
    if len(flat) <= length:
        return flat, starts, none, none, none, none
    prefix = prefix_hash(flat)
    at = np.arange(len(flat) - k + 1)
    hashes = range_hash(prefix, at, at + k)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties go to the left
    span, wide = 1, length - k + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
    text = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(trigger)]
    inside = np.arange(len(trigger)) + length < starts[1:][text]
    window = np.flatnonzero(inside)
    if not len(window):
        return flat, starts, none, none, none, none
    new = np.concatenate([[True], (trigger[window[1:]] != trigger[window[:-1]]) | (text[window[1:]] != text[window[:-1]])])
    first = window[new]
    last = window[np.concatenate([new[1:], [True]])]
    return flat, starts, text[first], hashes[trigger[first]].view(np.int64), first, last


def _triggers(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = phrases([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], length, k)
            yield pa.RecordBatch.from_arrays([pa.array(found[3], pa.int64())], names=["a"])

    return docs.mapInArrow(run, "a long")


def _phrases(docs: DataFrame, bitmap: np.ndarray, length: int, k: int) -> DataFrame:
    """(doc_id, a, s, n, e) of phrases whose trigger may be repeated: trigger, place, bytes and their hash."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in text_slices(batches):
            flat, starts, text, a, first, last = phrases([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], length, k)
            if not len(a):
                continue
            held = may_hold(bits, a)
            text, a, first, last = text[held], a[held], first[held], last[held]
            raw = flat.tobytes()
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[text], pa.int64()),
                    pa.array(a, pa.int64()),
                    pa.array(first - starts[text], pa.int64()),
                    pa.array((last + length - first).astype(np.int32)),
                    pa.array([blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)], pa.binary()),
                ],
                names=["doc_id", "a", "s", "n", "e"],
            )

    return docs.mapInArrow(run, "doc_id long, a long, s long, n int, e binary")


def _with_bytes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(a, doc_id, s, phrase) for places (doc_id, a, s, n); a document's places are gathered, then cut from its text."""
    per_doc = materialise(places.groupBy("doc_id").agg(F.collect_list(F.struct("a", "s", "n")).alias("places")), "places")  # bounded by the document
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).cast("int").alias("bucket")
    # at most ID_BUCKETS rows are broadcast; they keep other texts out of the shuffle
    near = docs.select("doc_id", "text", bucket).join(F.broadcast(per_doc.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            doc, a, s, cut = [], [], [], []
            for d, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for x in found:
                    doc.append(d)
                    a.append(x["a"])
                    s.append(x["s"])
                    cut.append(raw[x["s"] : x["s"] + x["n"]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(doc, pa.int64()), pa.array(s, pa.int64()), pa.array(cut, pa.binary())], names=["a", "doc_id", "s", "phrase"])

    return near.join(per_doc, "doc_id").mapInArrow(run, "a long, doc_id long, s long, phrase binary")


def suffix_ranks(flat: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at every place by its first ``length`` bytes (zeros beyond the end); equal ones share a rank.

    Prefix doubling: ranks by w bytes at a place and w places on give the ranks by 2 * w.
    """
    eight = np.zeros(len(flat), np.uint64)
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    wide = min(8, length)
    for j in range(wide):
        eight = eight << np.uint64(8) | padded[j : j + len(flat)]
    ranks = np.unique(eight, return_inverse=True)[1].astype(np.uint64)
    while wide < length:
        step = min(wide, length - wide)
        further = np.concatenate([ranks[step:] + np.uint64(1), np.zeros(min(step, len(ranks)), np.uint64)])[: len(ranks)]
        ranks = np.unique(ranks << np.uint64(32) | further, return_inverse=True)[1].astype(np.uint64)
        wide += step
    return ranks


def repeats_within(groups: list[list[tuple[int, int, bytes]]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(doc_id, start, end) of windows that an earlier phrase of the same group holds; groups of (doc_id, place, phrase)."""
    rows = [r for g in groups for r in sorted(g)]
    flat, starts = flat_bytes([r[2] for r in rows])
    row = np.repeat(np.arange(len(rows)), np.diff(starts))
    at = np.flatnonzero(np.arange(len(flat)) + length < starts[1:][row])
    if not len(at):
        return []
    ranks = suffix_ranks(flat, length)[at]
    order = np.argsort(ranks, kind="stable")  # the suffix array; of equal windows the first in corpus order leads, as equal ones are in one group
    same = ranks[order[1:]] == ranks[order[:-1]]
    again = np.sort(at[order[1:][same]])
    if not len(again):
        return []
    new = np.concatenate([[True], (again[1:] != again[:-1] + 1) | (row[again[1:]] != row[again[:-1]])])
    begin, end = again[new], again[np.concatenate([new[1:], [True]])] + length
    out = []
    for b, e, r in zip(begin.tolist(), end.tolist(), row[begin].tolist(), strict=True):
        doc, place, _ = rows[r]
        out.append((doc, place + b - int(starts[r]), place + e - int(starts[r])))
    return out


def _compared(groups: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, GROUPS):
                found = repeats_within([[(x["doc_id"], x["s"], x["phrase"]) for x in g] for g in batch.column("g").slice(k, GROUPS).to_pylist()], length)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["doc_id", "start", "end"])

    return groups.select("g").mapInArrow(run, "doc_id long, start long, end long")


def repeated_windows(docs: DataFrame, length: int = LENGTH, k: int = TRIGGER, together: int = TOGETHER) -> DataFrame:
    """(doc_id, start, end): byte ranges covered by repeated windows; they may overlap."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    repeated = materialise(_triggers(docs, length, k).groupBy("a").count().where("count > 1").select("a"), "triggers")
    held = materialise(_phrases(docs, bitmap_of(repeated), length, k).join(repeated, "a", "left_semi"), "phrases")
    dictionary = materialise(held.groupBy("a", "e").agg(F.min(F.struct("doc_id", "s", "n")).alias("first")), "dictionary")
    occurrence = held.join(dictionary, ["a", "e"]).where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.s") != F.col("s")))
    later = materialise(occurrence.select("doc_id", F.col("s").alias("start"), (F.col("s") + F.col("n")).alias("end")), "later")
    discard(held)

    several = materialise(dictionary.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "several")
    places = dictionary.join(several.select("a"), "a", "left_semi").select("first.doc_id", "a", "first.s", "first.n")
    mixed = materialise(_with_bytes(docs, places), "mixed")
    some = mixed.join(several.where(F.col("m") <= together).select("a"), "a", "left_semi")
    near = _compared(some.groupBy("a").agg(F.collect_list(F.struct("doc_id", "s", "phrase")).alias("g")), length)  # at most ``together`` phrases of 2 * length bytes
    large = mixed.join(several.where(F.col("m") > together).select("a"), "a", "left_semi").select("doc_id", "s", "phrase", F.explode(F.sequence(F.lit(0), F.length("phrase") - length)).alias("i"))
    windows = materialise(large.select(F.expr(f"substring(phrase, i + 1, {length})").alias("w"), "doc_id", (F.col("s") + F.col("i")).alias("place")), "windows")
    firsts = materialise(windows.groupBy("w").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "place")).alias("first")).where("c > 1").select("w", "first"), "firsts")
    far = windows.join(firsts, "w").where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.place") != F.col("place")))
    again = materialise(near.unionByName(far.select("doc_id", F.col("place").alias("start"), (F.col("place") + length).alias("end"))), "again")
    discard(repeated, dictionary, several, mixed, windows, firsts)
    return later.unionByName(again)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = TRIGGER, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary), one row per document."""
    ranges = repeated_windows(docs, length, k, together)
    per_doc = materialise(ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")  # bounded by the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                cut = merged([(r["start"], r["end"]) for r in found or ()])
                edges = [0, *(x for span in cut for x in span), len(raw)]
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in cut])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = docs.select("doc_id", "text").join(per_doc, "doc_id", "left")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), LENGTH).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

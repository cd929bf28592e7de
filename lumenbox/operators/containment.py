"""Which lines are read in which texts: a join on containment through runs of bytes.

A text that contains a line contains every run of bytes of the line. One such run of each line is its anchor, as long
as the line allows. Each text is passed over once and gives the numbers of those of its runs that may be anchors, each
once; a join on the numbers proposes pairs, and only these are compared in full. Lines of fewer than SHORT characters
match whole texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

SHORT = 4  # characters
#: Bytes of an anchor: the largest of these that the line has
SIZES = (4, 5, 6, 7, 8, 9, 12)
#: Slots for each anchor in the bitmap, and the binary logarithm of their number (at most 2 MB for each size of anchor). Beyond
#: 2**20 lines more and more runs that are no anchors pass, which costs time and changes no result.
SPARE, LEAST_BITS, MOST_BITS = 256, 16, 24
#: Lines of up to so many bytes in all are sent to every task and compared where the text is; more meet the texts by key.
SENT_BYTES = 32 << 20
SLICE_BYTES = 1 << 17
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _numbers(flat: np.ndarray, size: int) -> np.ndarray:
    """A number for the run of ``size`` bytes (4 to 16) at each place of ``flat``; its upper bits depend on all of them."""
    n = max(0, len(flat) - size + 1)
    if not n:
        return np.zeros(0, np.uint64)
    kind = "<u4" if size < 8 else "<u8"  # one word, or two that cover the run
    word = lambda at: np.ndarray((n,), kind, flat, at, (1,))
    out = np.multiply(word(0), _FACTORS[0], dtype=np.uint64)
    if size not in (4, 8):
        out ^= out >> np.uint64(29)
        out += word(size - np.dtype(kind).itemsize)
        out *= _FACTORS[1]
    return out


def _runs(flat: np.ndarray, ends: np.ndarray, size: int, bitmap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the runs that lie within a row; with a bitmap, of those that it lets through."""
    numbers = _numbers(flat, size)
    if bitmap is None:
        places = np.arange(len(numbers))
    else:
        places = np.flatnonzero(bitmap.take((numbers >> np.uint64(65 - len(bitmap).bit_length())).view(np.int64)))
    row = np.searchsorted(ends, places, side="right")
    inside = places + size <= ends[row]
    return row[inside], numbers[places[inside]].view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with about SLICE_BYTES of text (a longer one stands alone): all bytes, and where each row ends."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a), np.frombuffer(b"".join(texts[a:b]), np.uint8), ends[a:b] - (ends[a - 1] if a else 0)


def _anchored(lines: DataFrame) -> DataFrame:
    """(line, size, anchor): the run of the least number, not where most lines begin alike. Size 0: the hash of a short line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, ends in _slices(batches, "line"):
            length = np.diff(ends, prepend=0)
            size = np.select([length >= s for s in SIZES[::-1]], SIZES[::-1], 0)
            anchor = np.zeros(len(ends), np.int64)
            for s in SIZES:
                row, number = _runs(flat, ends, s)
                row, number = row[size[row] == s], number[size[row] == s]
                order = np.lexsort((number, row))
                rows, first = np.unique(row[order], return_index=True)
                anchor[rows] = number[order][first]
            yield pa.RecordBatch.from_arrays([batch.column("line"), pa.array(size, pa.int32()), pa.array(anchor)], names=["line", "size", "anchor"])

    short = F.length("line") < SHORT
    found = lines.select("line").mapInArrow(run, "line string, size int, anchor long")
    return found.select("line", F.when(short, 0).otherwise(F.col("size")).alias("size"), F.when(short, F.xxhash64("line")).otherwise(F.col("anchor")).alias("anchor"))


def _bitmaps(anchored: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """For each size the bitmap of its anchors' upper bits, packed, and the bytes of all lines.

    The driver gets 64 slots in a row: 2**(MOST_BITS - 6) rows for each size at most, whatever the number of lines.
    """
    slot = F.when(F.col("size") > 0, F.shiftrightunsigned("anchor", 64 - MOST_BITS)).otherwise(0)
    words = anchored.select("size", F.octet_length("line").alias("bytes"), slot.alias("slot")).groupBy("size", F.shiftright("slot", 6).alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).toArrow()
    size, word, bits, n, n_bytes = (rows.column(k).to_numpy() for k in ("size", "word", "bits", "n", "bytes"))
    out = {}
    for s in SIZES:
        if (size == s).any():
            all_words = np.zeros(1 << MOST_BITS - 6, "<i8")
            all_words[word[size == s]] = bits[size == s]
            slots = np.flatnonzero(np.unpackbits(all_words.view(np.uint8), bitorder="little"))
            kept = min(MOST_BITS, max(LEAST_BITS, (SPARE * int(n[size == s].sum())).bit_length()))
            held = np.zeros(1 << kept, bool)
            held[slots >> MOST_BITS - kept] = True
            out[s] = np.packbits(held)
    return out, int(n_bytes.sum())


def _with_anchors(read: DataFrame, packed: dict[int, np.ndarray]) -> DataFrame:
    """``read`` with ``anchors``: the numbers of those runs of its text that may be anchors, each once."""
    schema = StructType([*read.schema]).add("anchors", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = {size: np.unpackbits(bits).view(bool) for size, bits in packed.items()}
        for batch, flat, ends in _slices(batches, "text"):
            found = [(np.zeros(0, np.int64),) * 2, *(_runs(flat, ends, size, bitmap) for size, bitmap in bitmaps.items())]
            row, number = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((number, row))
            row, number = row[order], number[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
            starts = np.searchsorted(row[new], np.arange(len(ends) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(starts.astype(np.int32), number[new])], names=schema.names)

    return read.mapInArrow(run, schema)


def containing(lines: DataFrame, texts: DataFrame, key: str, line: str = "line", text: str = "text") -> DataFrame:
    """(line, key) of each distinct line with each text that equals it, or contains it if it has SHORT characters or more.

    Both columns hold normalised text; null and empty ones match nothing. ``key`` is unique among the texts. The lines
    are read at once, for their bitmap; the texts stay where they are unless the lines are too many to be sent to them.
    """
    anchored = _anchored(lines.select(F.col(line).alias("line")).where("line <> ''").distinct())
    bitmaps, n_bytes = _bitmaps(anchored)
    read = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    numbers = F.when(F.length("text") < SHORT, F.array(F.xxhash64("text"))).otherwise(F.col("anchors"))
    runs = _with_anchors(read, bitmaps).select("key", "text", F.explode(numbers).alias("anchor"))
    if n_bytes <= SENT_BYTES:
        proposed = runs.join(F.broadcast(anchored.select("anchor", "line")), "anchor")
    else:
        proposed = runs.select("key", "anchor").join(anchored.select("anchor", "line"), "anchor").join(read, "key")
    return proposed.where(_holds(F.col("text"), F.col("line"))).select("line", "key")


def _holds(text: Column, line: Column) -> Column:
    return (text == line) | ((F.length(line) >= SHORT) & F.contains(text, line))


def corpus_lines(lines: DataFrame, texts: DataFrame, key: str, line: str = "line", text: str = "text") -> DataFrame:
    """``lines`` with the number of texts that hold each: 0 where none does."""
    held = containing(lines, texts, key, line, text).groupBy(F.col("line").alias("_line")).agg(F.count("*").alias("texts"))
    counted = lines.join(held, F.col(line) == F.col("_line"), "left").drop("_line")
    return counted.withColumn("texts", F.coalesce("texts", F.lit(0).cast("long")))


def corpus_score(lines: DataFrame, texts: DataFrame, key: str, line: str = "line", text: str = "text") -> DataFrame:
    """One row (recall, found, expected, read, spurious): all lines, repeated ones too, against the set of all texts."""
    want = corpus_lines(lines.where(F.col(line) != ""), texts, key, line, text).agg(F.count("*").alias("expected"), F.count_if(F.col("texts") > 0).alias("found"))
    read = texts.select(F.sha2(text, 256).alias("digest")).distinct().agg(F.count_if(F.col("digest") != F.sha2(F.lit(""), 256)).alias("read"))
    return want.crossJoin(read).select(  # a row each
        F.coalesce(F.bround(F.try_divide("found", "expected"), 4), F.lit(0.0)).alias("recall"),
        "found", "expected", "read",
        F.greatest(F.lit(0), F.col("read") - F.col("found")).alias("spurious"),
    )

"""A bitmap of hash values that is small enough for every task: a filter that lets all of them through, and some others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**27 bits are 16 MB; beyond 2**22 values more and more others pass, which costs time and changes no result
LEAST_BITS, MOST_BITS = 16, 27
SPARE = 32  # bits for each value, as far as MOST_BITS allows
BLOCK_BITS = 16


def bitmap_of(values: DataFrame) -> np.ndarray:
    """Words of the bitmap of the distinct values in column ``a``; its size follows their number, up to a bound."""
    bits = min(MOST_BITS, max(LEAST_BITS, (SPARE * values.count()).bit_length()))
    slot = F.col("a").bitwiseAND(F.lit((1 << bits) - 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.unique(batch.column("slot").to_numpy(zero_copy_only=False))
            for b in np.unique(slots >> BLOCK_BITS).tolist():
                block = blocks.setdefault(b, np.zeros(1 << BLOCK_BITS, bool))
                block[slots[slots >> BLOCK_BITS == b] & ((1 << BLOCK_BITS) - 1)] = True
        for b, block in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    packed = values.select(slot.alias("slot"), F.shiftright(slot, BLOCK_BITS).alias("block")).repartition("block").mapInArrow(pack, "block long, bits binary").toArrow()
    out = np.zeros((1 << bits - BLOCK_BITS, (1 << BLOCK_BITS) // 64), np.uint64)
    for b, content in zip(packed.column("block").to_pylist(), packed.column("bits").to_pylist(), strict=True):
        out[b] = np.frombuffer(content, np.uint64)
    return out.reshape(-1)


def may_hold(bitmap: np.ndarray, a: np.ndarray) -> np.ndarray:
    """False only for values that are not in the bitmap."""
    slot = a & (len(bitmap) * 64 - 1)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

"""Word shingle sets of whole texts as sorted 63-bit hashes, by numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ASCII_LOWER, NOT_SPACE, flat_bytes, mix, prefix_hash, range_hash, text_slices, word_spans

_STEP = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending; a text of fewer words has one, of no words none.

    Words are runs of characters other than [\\x20\\x09-\\x0D], with A-Z lower-cased.
    """
    flat, starts = flat_bytes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    flat = ASCII_LOWER[flat]
    begin, end = word_spans(flat, NOT_SPACE)
    if not len(begin):
        return [np.empty(0, np.int64)] * len(texts)
    hashes = range_hash(prefix_hash(flat), begin, end)
    first = np.searchsorted(begin, starts)  # of each text, its first word
    total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    factor = np.uint64(1)
    factors = []
    for j in range(words):
        factors.append(factor)
        if len(total):
            total += hashes[j : j + len(total)] * factor
        factor = np.uint64(int(factor) * int(_STEP) & (1 << 64) - 1)
    rolled = (mix(total) >> np.uint64(1)).view(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.array([sum(int(h) * int(f) for h, f in zip(hashes[a:b], factors, strict=False)) + (b - a) & (1 << 64) - 1], np.uint64)
            out.append((mix(mix(short)) >> np.uint64(1)).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def ragged(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def each_slice(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in text_slices(batches):
        yield batch, shingle_sets(batch.column("text").to_pylist(), words)

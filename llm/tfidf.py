"""Word hashes of lower-cased texts for term statistics, by numpy over many texts at once."""

from __future__ import annotations

import numpy as np

from .common import ALNUM, flat_bytes, prefix_hash, range_hash, word_spans


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes in order, and where each text's begin (one more entry: the end).

    Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.
    """
    flat, starts = flat_bytes([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
    begin, end = word_spans(flat, ALNUM)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return range_hash(prefix_hash(flat), begin, end), np.searchsorted(begin, starts)


class Vocabulary:
    """A fixed set of word hashes with an open-addressed table: hash -> number, -1 for others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.bits = max(10, int(len(self.hashes) * 4).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        # words that share a slot are kept apart by a second look in the sorted list
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.hashes & self.mask).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        likely = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[likely]), len(self.hashes) - 1)
        good = self.hashes[at] == hashes[likely]
        out[likely[good]] = at[good]
        return out

"""BPE encoding and decoding with a public vocabulary file of word pieces that end in a word-end mark.

Texts are normalised and split into words as the file says (added tokens cut out first; NFC, white space
to one blank, lower case; a pattern of words, digits and runs of signs; bytes as printable characters).
Each distinct new word of a batch is merged once, all of them together: the symbols of all words lie in one
flat array; in every round each word's lowest-rank adjacent pair, found by binary search over the sorted
pair keys, is merged at all its places. Finished words are kept in a bounded cache per Python worker.

Edge cases: null text counts as empty and gives no tokens and an empty decoded text; one very long word
costs one round per distinct merge, each linear in what is left of it; rows are independent, so ties and
repeats don't matter; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

CACHE_WORDS = 200_000
CACHE_LONGEST = 64
#: Bytes of text whose new words are merged together
SLICE = 2_000_000
#: White space as Unicode's White_Space property has it
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        ids = vocab | added
        self.tokens = [""] * (max(ids.values()) + 1)
        for token, number in ids.items():
            self.tokens[number] = token
        characters = byte_characters()
        self.plain = np.array([vocab[c] for c in characters], np.int64)
        self.ending = np.array([vocab[c + self.suffix] for c in characters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = np.int64(len(self.tokens))
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace("\\s", SPACE))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.cache: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, with the ids of added tokens between them."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self._split(text)
        out: list[str | int] = []
        for part in self.added_pattern.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out += self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # capital sigma has one lower form here
        return self.words.findall(self.spaces.sub(" ", text).lower())

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Token ids of each word, all words merged together in rounds."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.plain[flat]
        last = np.cumsum(sizes) - 1
        sym[last] = self.ending[flat[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word, done_sym = [], []
        none = np.int64(len(self.keys))
        while len(sym):
            rank = np.full(len(sym), none)  # of the pair that starts here
            same = np.flatnonzero(word[:-1] == word[1:])
            key = sym[same] * self.width + sym[same + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[same[hit]] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = best == none
            if over.any():  # words without a pair to merge are finished
                done_word.append(word[over])
                done_sym.append(sym[over])
                sym, word, rank, best = sym[~over], word[~over], rank[~over], best[~over]
                if not len(sym):
                    break
            take = rank == best
            # of pairs that overlap (a run of one symbol) every second is taken, from the left
            place = np.arange(len(take))
            opening = take & ~np.concatenate([[False], take[:-1]])
            take &= (place - np.maximum.accumulate(np.where(opening, place, 0))) % 2 == 0
            sym[take] = self.merged[rank[take]]
            keep = ~np.concatenate([[False], take[:-1]])
            sym, word = sym[keep], word[keep]
        out_word, out_sym = np.concatenate(done_word), np.concatenate(done_sym)
        out_sym = out_sym[np.argsort(out_word, kind="stable")]
        ends = np.cumsum(np.bincount(out_word, minlength=len(words))).tolist()
        values = out_sym.tolist()
        return [tuple(values[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.pieces(t or "") for t in texts]
        new = list({w for words in split for w in words if w.__class__ is str and w not in self.cache})
        own: dict[str, tuple[int, ...]] = {}
        if new:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
                new = list({w for words in split for w in words if w.__class__ is str})
            for w, ids in zip(new, self.merge(new), strict=True):
                (self.cache if len(w) <= CACHE_LONGEST else own)[w] = ids
        cache, out = self.cache, []
        for words in split:
            try:  # all of them cached words, as in nearly every text
                out.append(list(chain.from_iterable(map(cache.__getitem__, words))))
                continue
            except KeyError:
                ids: list[int] = []
            for w in words:
                if w.__class__ is int:
                    ids.append(w)
                else:
                    ids += cache.get(w) or own[w]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a blank; special tokens are kept."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


_LOADED: dict[str, WordBpe] = {}


def _coder(content: str, key: str) -> WordBpe:
    if key not in _LOADED:
        _LOADED[key] = WordBpe(content)
    return _LOADED[key]


def bpe_encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded): token ids of each text and the text that they decode to.

    ``vocabulary`` is the path of a tokenizer file on the driver; its content (a few MB, fixed) is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(content.value, vocabulary)
        for batch in text_slices(batches, limit=SLICE):
            ids = coder.encode(batch.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.fromiter((i for x in ids for i in x), np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([coder.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))

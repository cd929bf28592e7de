"""Language identification as inference of a multilingual mixture.

Training: character n-grams (2 and 3, within padded words of lower-cased letters) of labelled texts, hashed
into a fixed number of buckets, are counted per language in the cluster; smoothed shares are the model.

Inference: a text's n-gram counts are explained by a mixture of languages. Expectation-maximisation
estimates the proportions over all languages, for many texts at once; then, for every text, languages
are dropped one by one, least proportion first, while the penalised likelihood (log-likelihood minus a
penalty for each language) does not fall. The language with the largest proportion is the prediction, its
proportion the score.

Edge cases: a null text or one without a letter gets `und`, score 0; an empty training table makes every
prediction `und`; languages that tie go to the smaller name; labels that are null are not learned from;
extra columns are ignored. The counts are of whole texts, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

BUCKETS = 1 << 14
ROUNDS = 6
PENALTY = 3.0
SMOOTHING = 0.5
#: Labelled texts to learn from: all of a residue class of the hash of doc_id of about this many (a bound on the fit, not on what is scored)
FIT_ROWS = 20_000
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")
_UNKNOWN = "und"


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text; empty where it has no letter."""
    plain = _NOT_LETTERS.sub(" ", text or "").strip()
    if not plain:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {plain.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    b = c[1:-1]
    two = c[:-2] * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35)
    three = two + (c[2:] + np.uint32(1)) * np.uint32(0x27D4EB2F)
    both = np.concatenate([two, three[b != 32]]) * np.uint32(0x9E3779B1)
    return (both ^ (both >> np.uint32(15))) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _sparse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many different buckets each text has, and their numbers and counts, flat in text order."""
    cols, counts = [], []
    for t in texts:
        n = np.bincount(ngram_buckets(t), minlength=BUCKETS)
        at = np.flatnonzero(n)
        cols.append(at)
        counts.append(n[at])
    return np.array([len(x) for x in cols]), np.concatenate(cols), np.concatenate(counts).astype(np.float32)


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-shares (bucket, language) from (doc_id, text, lang) rows; about ``rows`` of them."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    parts = max(1, labelled.count() // rows)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(ngram_buckets(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = sample.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table_ = np.full((BUCKETS, len(languages)), SMOOTHING)
    if languages:
        code = {x: k for k, x in enumerate(languages)}
        table_[counts["bucket"].to_numpy(), counts["lang"].map(code).to_numpy()] += counts["n"].to_numpy()
    return languages, np.log(table_ / table_.sum(axis=0)) if languages else table_


def _expect(p: np.ndarray, c: np.ndarray, sizes: np.ndarray, mixture: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions of texts of ``sizes`` entries each; returns them and the log-likelihoods."""
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(c, starts)[:, None]
    weighted = p * c[:, None]
    for _ in range(rounds):
        shared = weighted / np.einsum("ij,ij->i", p, np.repeat(mixture, sizes, axis=0))[:, None]
        mixture = mixture * np.add.reduceat(shared, starts, axis=0) / total
    mixed = np.einsum("ij,ij->i", p, np.repeat(mixture, sizes, axis=0))
    return mixture, np.add.reduceat(c * np.log(np.maximum(mixed, np.float32(1e-30))), starts)


def _prune(p: np.ndarray, c: np.ndarray, sizes: np.ndarray, mixture: np.ndarray, fit_: np.ndarray, faint: np.ndarray) -> bool:
    """Drops the faint languages of those texts whose penalised likelihood does not fall by it; True if any did."""
    smaller = np.where(faint, 0.0, mixture)
    dropped = ((smaller == 0) & (mixture > 0)).sum(axis=1)
    todo = np.flatnonzero((dropped > 0) & (smaller.sum(axis=1) > 0))
    if not len(todo):
        return False
    chosen = np.zeros(len(mixture), bool)
    chosen[todo] = True
    mine = np.repeat(chosen, sizes)
    start = smaller[todo] / smaller[todo].sum(axis=1, keepdims=True)
    rounds = 3 if ((start > 0).sum(axis=1) > 1).any() else 0  # one language left: nothing to estimate
    own, own_fit = _expect(p[mine], c[mine], sizes[todo], start.astype(np.float32), rounds)
    better = own_fit + PENALTY * dropped[todo] >= fit_[todo]
    mixture[todo[better]], fit_[todo[better]] = own[better], own_fit[better]
    return bool(better.any())


def infer(texts: list[str | None], languages: list[str], log_shares: np.ndarray) -> list[tuple[str, float]]:
    """(language, proportion) of each text."""
    if not languages:
        return [(_UNKNOWN, 0.0)] * len(texts)
    sizes, bucket, c = _sparse(texts)
    present = sizes > 0
    some = np.flatnonzero(present)
    if not len(some):
        return [(_UNKNOWN, 0.0)] * len(texts)
    k = len(languages)
    logs = log_shares[bucket]
    p = np.exp(logs - logs.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    sizes = sizes[some]
    found, fit_ = _expect(p, c, sizes, np.full((len(some), k), 1 / k, np.float32), ROUNDS)
    _prune(p, c, sizes, found, fit_, found < 0.05)  # all faint ones at once
    for _ in range(k - 1):
        if not _prune(p, c, sizes, found, fit_, found == np.where(found > 0, found, np.inf).min(axis=1, keepdims=True)):
            break
    mixture = np.zeros((len(texts), k))
    mixture[some] = found
    best = mixture.argmax(axis=1)
    return [(languages[b], float(min(1.0, m[b]))) if ok else (_UNKNOWN, 0.0) for ok, b, m in zip(present, best, mixture, strict=True)]


def identify(docs: DataFrame, languages: list[str], log_shares: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast((languages, log_shares))  # BUCKETS rows, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=500_000):
            found = infer(batch.column("text").to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from documents that are not held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, *model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))

"""Toxicity: a learned lexicon in a trie, met with Levenshtein automata, with context scores.

Learning, from labelled documents alone (a bounded sample, one text of each family of near copies, whose words would
seem to speak for its label): words, and stems (of 4 to 11 letters) that at least three
of these words share, that are far more common in toxic than in other texts form the lexicon. As each of its terms
stands in several toxic texts of the sample, the sample bounds it. Every word of a text that is no term is turned
into a Levenshtein automaton (distance 1) which is intersected with the lexicon's trie, so misspelled terms are
caught, those that a stem stands for too; stems match any ending. A match within quotation marks, or with words
of quoting or denial in the window before it, counts apart. Weights of terms, and of misspellings that the
sample holds, are smoothed log-odds; other misspellings weigh a share of their term. A logistic regression
turns the summed weights of plain and of quoted matches into the score.

Edge cases: null or empty text has no match and gets the score of such texts; a table without labels of
both kinds gives score 0 everywhere; a document with conflicting labels counts as toxic; a term that repeats within a
text counts once for each way it occurs; rows are independent; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_slices
from .shingles import each_slice

#: Labelled documents to learn from, about; a bound on the fit, not on what is scored
FIT_ROWS = 8_000
LEAST_RATIO = 3.0  # natural log of how much more common a term must be in toxic texts
FUZZY_LEAST = 5  # letters of a term that may be misspelled
STEM_LEAST = 4
STEM_MOST = 11
#: Weight of a misspelling that the sample does not hold, of its term's
MISSPELLED = 0.7
CACHE_WORDS = 400_000
WINDOW = 60
_WORD = regex.compile(r"[\p{L}\p{N}_@$]+")
_QUOTES = "\"“”„«»"
_REPORT = regex.compile(r"\b(?:quote[ds]?|said|says|called|calling|word|term|example|never|not|don't)\b[^.!?\n]*$")


class Automaton:
    """Levenshtein automaton of a word: states are the sparse rows of the edit distance table."""

    def __init__(self, word: str, most: int) -> None:
        self.word, self.most = word, most

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.most, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], letter: str) -> tuple[tuple[int, int], ...]:
        out: list[tuple[int, int]] = []
        before = dict(state)
        for i in range(state[0][0], min(state[-1][0] + 1 + self.most, len(self.word)) + 1):
            best = before.get(i, 99) + 1
            if i:
                best = min(best, before.get(i - 1, 99) + (self.word[i - 1] != letter))
                if out and out[-1][0] == i - 1:
                    best = min(best, out[-1][1] + 1)
            if best <= self.most:
                out.append((i, best))
        return tuple(out)

    def accepts(self, state: tuple[tuple[int, int], ...]) -> bool:
        return bool(state) and state[-1][0] == len(self.word)


class Trie:
    """Lexicon: letters lead to nodes; a node may end a term."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for t in terms:
            node = self.root
            for letter in t:
                node = node.setdefault(letter, {})
            node[""] = t

    def within(self, word: str, most: int = 1) -> list[str]:
        """Terms at an edit distance of ``most`` at most: the trie and the word's automaton walked together."""
        automaton, found = Automaton(word, most), []
        todo = [(self.root, automaton.start())]
        while todo:
            node, state = todo.pop()
            for letter, below in node.items():
                if letter == "":
                    if automaton.accepts(state):
                        found.append(below)
                elif after := automaton.step(state, letter):
                    todo.append((below, after))
        return sorted(found)


@dataclass
class Lexicon:
    words: list[str]
    stems: list[str]
    behind: list[str] = field(default_factory=list)  # words that a stem stands for
    weights: dict[tuple[str, str], float] = field(default_factory=dict)  # (term, way) -> log-odds; ways are exact, stem and a misspelled word
    logit: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def prepare(self) -> None:
        fuzzy = sorted(w for w in {*self.words, *self.behind} if len(w) >= FUZZY_LEAST)
        self.trie = Trie(fuzzy)
        # words at distance 1 of each other become equal by at most one deletion each
        self.near = set(fuzzy) | {w[:i] + w[i + 1 :] for w in fuzzy for i in range(len(w))}
        self.longest = max(map(len, fuzzy), default=0) + 1
        self.exact, self.stem = set(self.words), set(self.stems)
        self.lengths = sorted({len(s) for s in self.stems})
        self.cache: dict[str, tuple[tuple[str, str], ...]] = {}

    def of_word(self, word: str) -> tuple[tuple[str, str], ...]:
        """(term, way) pairs that a lower-cased word matches; way is exact, stem or the word itself, misspelled."""
        known = self.cache.get(word)
        if known is not None:
            return known
        if word in self.exact:
            out = [(word, "exact")]
        else:
            out = [(word[:n], "stem") for n in self.lengths if word[:n] in self.stem and len(word) >= n]
            if not out and FUZZY_LEAST - 1 <= len(word) <= self.longest and self.may_be_near(word):
                out = sorted({(self.term_of(t), word) for t in self.trie.within(word)})
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = tuple(out)
        return self.cache[word]

    def term_of(self, word: str) -> str:
        """The term that stands for a word of the trie: itself, or its stem."""
        return word if word in self.exact else next((word[:n] for n in self.lengths if word[:n] in self.stem), word)

    def weight(self, term: str, way: str) -> float:
        known = self.weights.get((term, way))
        if known is not None:
            return known
        return MISSPELLED * self.weights.get((term, "exact"), self.weights.get((term, "stem"), 0.0))

    def may_be_near(self, word: str) -> bool:
        """False only for words that no term is within distance 1 of: spares them the automaton."""
        near = self.near
        if word in near:
            return True
        for i in range(len(word)):
            if word[:i] + word[i + 1 :] in near:
                return True
        return False

    def matches(self, text: str | None) -> dict[tuple[str, str], bool]:
        """(term, way) -> whether all its places in the text are quoted."""
        low = (text or "").lower()
        known, of_word, hits = self.cache.get, self.of_word, set()
        for w in set(_WORD.findall(low)):
            found = known(w)
            if found is None:
                found = of_word(w)
            if found:
                hits.add(w)
        out: dict[tuple[str, str], bool] = {}
        if hits:
            for m in _WORD.finditer(low):
                if m[0] in hits:
                    quoted = is_quoted(low, m.start(), m.end())
                    for term in self.of_word(m[0]):
                        out[term] = out.get(term, True) and quoted
        return out

    def sums(self, text: str | None) -> tuple[float, float, list[str]]:
        plain = quoted = 0.0
        terms = []
        for (term, way), inside in sorted(self.matches(text).items()):
            w = self.weight(term, way)
            if inside:
                quoted += w
            else:
                plain += w
            terms.append(term)
        return plain, quoted, terms

    def score(self, plain: float, quoted: float) -> float:
        z = self.logit[0] + self.logit[1] * plain + self.logit[2] * quoted
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a match opens a quotation before it and closes one behind, or reports it."""
    before = text[max(0, start - WINDOW) : start].rsplit("\n", 1)[-1]
    after = text[end : end + WINDOW].split("\n", 1)[0]
    if any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES):
        return before.count('"') % 2 == 1 or any(q in before for q in _QUOTES[1:])
    return bool(_REPORT.search(before))


def _term_counts(sample: DataFrame) -> DataFrame:
    """(kind, term, toxic, clean): documents that have the word, or a word with the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                keys = {"w" + w for w in words}
                for w in words:
                    keys.update("p" + w[:n] for n in range(STEM_LEAST, min(len(w), STEM_MOST + 1)))
                sums[toxic != 0].update(keys)
        keys = list(sums[0].keys() | sums[1].keys())
        for a in range(0, len(keys), 20_000):
            part = keys[a : a + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in part]), pa.array([k[1:] for k in part]), pa.array([sums[1][k] for k in part], pa.int64()), pa.array([sums[0][k] for k in part], pa.int64())],
                names=["kind", "term", "toxic", "clean"],
            )

    each = sample.mapInArrow(run, "kind string, term string, toxic long, clean long")
    return each.groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _families(sample: DataFrame) -> DataFrame:
    """(text, toxic) with one text of each family of near copies: those of one label with the same least shingle hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in each_slice(batches, 5):
            least = [int(s[0]) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic"), pa.array(least, pa.int64())], names=["doc_id", "toxic", "least"])

    sample = materialise(sample.select("doc_id", "text", "toxic"), "sample")
    one = sample.mapInArrow(run, "doc_id long, toxic int, least long").groupBy("toxic", "least").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return sample.join(F.broadcast(one), "doc_id", "left_semi").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """Lexicon and weights from about ``rows`` labelled documents, whatever the number of labels."""
    labels = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    parts_ = max(1, labels.count() // rows)
    some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts_)) == 0)
    # about ``rows`` rows of 12 bytes: bounded by the parameter
    sample = _families(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")).repartition(24)
    by_label = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = by_label.get(1, 0), by_label.get(0, 0)
    if not bad or not good:
        return Lexicon([], [])

    least = max(3, bad // 300)  # toxic texts of a word that speaks for a stem
    enough = max(5, bad // 100)  # toxic texts of a term, and half of those of a stem: fewer are chance, or copies of a few texts
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    likely = _term_counts(sample).where((F.col("toxic") >= least) & (odds >= LEAST_RATIO))
    rows_ = likely.collect()  # terms of ``least`` toxic texts of the sample each
    words = {r["term"]: (r["toxic"], r["clean"]) for r in rows_ if r["kind"] == "w"}
    stems: list[str] = []
    for r in sorted((r for r in rows_ if r["kind"] == "p"), key=lambda r: (len(r["term"]), r["term"])):
        s = r["term"]
        if r["toxic"] >= 2 * enough and sum(w.startswith(s) for w in words) >= 3 and not any(s.startswith(x) for x in stems):
            stems.append(s)
    behind = {w for w in words if any(w.startswith(s) for s in stems)}
    lexicon = Lexicon(sorted(w for w in words.keys() - behind if words[w][0] >= enough), sorted(stems), sorted(behind))
    return _weigh(lexicon, sample, bad, good)


def _weigh(lexicon: Lexicon, sample: DataFrame, bad: int, good: int) -> Lexicon:
    """Log-odds of (term, way), then a logistic regression on their sums, both over the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        lex.prepare()
        for batch in batches:
            found = [lex.matches(t) for t in batch.column("text").to_pylist()]
            flat = [[f"{t}\t{way}\t{int(q)}" for (t, way), q in sorted(m.items())] for m in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int64()), pa.array(flat, pa.list_(pa.string()))], names=["toxic", "found"])

    # one row for each sampled document: bounded by the parameter
    rows = [(int(r["toxic"] != 0), [tuple(x.split("\t")) for x in r["found"]]) for r in sample.mapInArrow(run, "toxic long, found array<string>").collect()]
    counts = (Counter(), Counter())
    for toxic, found in rows:
        counts[toxic].update({(t, way) for t, way, _ in found})
    smooth = 0.5
    lexicon.weights = {k: math.log((counts[1][k] + smooth) / (bad + 2 * smooth)) - math.log((counts[0][k] + smooth) / (good + 2 * smooth)) for k in counts[0].keys() | counts[1].keys()}
    x = np.zeros((len(rows), 3))
    y = np.array([t for t, _ in rows], float)
    x[:, 0] = 1
    for k, (_, found) in enumerate(rows):
        for t, way, q in found:
            x[k, 2 if q == "1" else 1] += lexicon.weights[(t, way)]
    lexicon.logit = tuple(float(v) for v in _logistic(x, y))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression drawn to (-3, 1, 0.2), by damped Newton steps."""
    prior, pull = np.array([-3.0, 1.0, 0.2]), np.array([0.1, 1.0, 1.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * (b - prior) ** 2).sum() / 2)

    b = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        grad = x.T @ (p - y) + pull * (b - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        size, now = 1.0, loss(b)
        while size > 1e-6 and loss(b - size * step) > now:
            size /= 2
        b = b - size * step
        if np.abs(step).max() * size < 1e-9:
            break
    return b


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, predicted, terms) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        lex.prepare()
        for batch in text_slices(batches):
            sums = [lex.sums(t) for t in batch.column("text").to_pylist()]
            scores = [lex.score(a, b) for a, b, _ in sums]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([t for _, _, t in sums], pa.list_(pa.string()))],
                names=["doc_id", "score", "predicted", "terms"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, terms array<string>")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, terms); learns from labels that are not held out."""
    lexicon = fit(docs, labels.where(~held_out()), rows)
    return score_toxicity(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted", "terms")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

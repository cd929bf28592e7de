"""The pipeline against brute force on a small corpus, and its stages' columns."""

import hashlib
import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm import registry

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["".join(rng.choice(["the", "ing", "ou", "er", "an", "st"]) for _ in range(3)) + rng.choice("aeiou") for _ in range(1500)]

    def some(n):
        return [rng.choice(vocab) for _ in range(n)]

    items = [some(30) for _ in range(5)]
    texts = [" ".join(some(120)) for _ in range(30)]
    near = texts[3].split()
    near[60] = "changed"
    texts += [texts[0], texts[1].replace(" ", "  "), " ".join(near), None, "", "123 !!", " ".join(some(50) + items[2] + some(50))]
    kept_longest = texts[1].replace(" ", "  ")
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(" ".join(i) for i in items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # brute force of every stage's rule
    left = {k: t for k, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)}
    groups = {}
    for k, t in left.items():
        groups.setdefault(re.sub(r"\s", "", t), []).append((-len(t), k))
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {k: shingles(t) for k, t in left.items()}
    gone = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    left = {k: t for k, t in left.items() if k not in gone and not any(" ".join(i) in t for i in items)}
    assert kept_longest in left.values() and 36 not in left and 32 not in left

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for k, t in left.items()}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"]: r["ids_sha256"] for r in got.collect()} == want

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.language(spark, docs, str(tmp_path)).columns == COLUMNS

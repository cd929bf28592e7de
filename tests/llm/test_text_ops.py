"""Row-wise operators against the tokenizers library, labels and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import decontaminate, langid, toxicity
from llm.bpe import WordBpe, bpe_encode_decode, digests
from llm.sharding import best_fit_decreasing, pack_into, shard

VOCAB = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, langs[k] if langs else "en", "s", 1, 7, 3) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def coder():
    with open(VOCAB) as f:
        return WordBpe(f.read())


def test_bpe_equals_the_library(coder):
    library = Tokenizer.from_file(VOCAB)
    random.seed(3)
    pool = list("aAéΣςİß1²½ﬁ漢🙂 \n\t-$'ǅा\x1c\x85") + ["'s", "'RE", "<|endoftext|>", "</w>", "é", "hello", "aaaa"]
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    texts += ["", "a" * 5000, "".join(random.choice("ab") for _ in range(20000))]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:60]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_edges(spark):
    out = {r["doc_id"]: r for r in digests(bpe_encode_decode(frame(spark, [None, "", "x x", "x x"]), VOCAB)).collect()}
    assert out[0]["n_tokens"] == out[1]["n_tokens"] == 0
    assert out[2]["ids_sha256"] == out[3]["ids_sha256"] != out[0]["ids_sha256"]
    assert digests(bpe_encode_decode(frame(spark, []), VOCAB)).count() == 0


def words(rng, roots, n):
    return " ".join(rng.choice(roots) + rng.choice(roots) for _ in range(n))


ROOTS = {"en": ["the", "ing", "and", "ou", "er"], "fr": ["é", "eau", "oi", "que", "ê"], "de": ["sch", "ung", "ä", "ich", "ver"]}


def test_language_held_out_accuracy_and_mixtures(spark):
    rng = random.Random(1)
    langs = [rng.choice(list(ROOTS)) for _ in range(300)]
    texts = [words(rng, ROOTS[x], 30) for x in langs]
    extra = [None, "", "123 456!", words(rng, ROOTS["en"], 60) + " " + words(rng, ROOTS["fr"], 20)]
    df = frame(spark, texts + extra, langs + ["en"] * 4)
    out = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    assert len(out) == 304
    held = [k for k in range(300) if out[k]["held_out"]]
    assert 40 < len(held) < 120
    assert np.mean([out[k]["lang_pred"] == langs[k] for k in held]) > 0.97
    assert [out[k]["lang_pred"] for k in (300, 301, 302)] == ["und"] * 3
    assert out[303]["lang_pred"] == "en" and 0.5 < out[303]["score"] < 0.95
    assert langid.language_id(frame(spark, [])).count() == 0


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_and_trie_equal_edit_distance():
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(60)})
    trie = toxicity.Trie(terms)
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
        for most in (1, 2):
            assert trie.within(w, most) == [t for t in terms if brute_distance(w, t) <= most]


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    texts, toxic = [], []
    for _ in range(400):
        bad = rng.random() < 0.3
        t = words(rng, ROOTS["en"], 40).split()
        if bad:
            t.insert(rng.randrange(40), rng.choice(["scoundrel", "villain", "scoundrol"]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    df = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, 1, x) for k, x in enumerate(toxic)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    held = [k for k in range(400) if out[k]["held_out"]]
    assert np.mean([out[k]["predicted"] == toxic[k] for k in held]) > 0.95
    assert out[400]["predicted"] == out[401]["predicted"] == 0
    none = toxicity.toxicity(df, labels.where("toxic = 5"))
    assert none.agg(F.max("predicted")).head()[0] == 0


def insults(rng, share):
    """Texts and labels; a family of words with a stem, and single terms."""
    texts, toxic = [], []
    for k in range(400):
        t = words(rng, ROOTS["en"], 40).split()
        if rng.random() < share:
            t.insert(rng.randrange(40), rng.choice(["scoundrel", "villain", "idiot", "idiots", "idiotic"]))
        texts.append(" ".join(t))
        toxic.append(int(len(t) > 40))
    return texts, toxic


def test_toxicity_fit_and_score_against_brute_force(spark):
    texts, toxic = insults(random.Random(12), 0.3)
    df = frame(spark, texts)
    labels = spark.createDataFrame([(k, x) for k, x in enumerate(toxic)] + [(0, 1 - toxic[0]), (1, None)], "doc_id long, toxic int")
    toxic[0] = 1  # conflicting labels count as toxic
    lex = toxicity.fit(df, labels)
    sets = [set(t.lower().split()) for t in texts]
    bad, good = sum(toxic), len(toxic) - sum(toxic)

    def counts(test):
        return [sum(test(s) for s, t in zip(sets, toxic, strict=True) if t == x) for x in (1, 0)]

    def strong(t, c):
        return t >= max(3, bad // 300) and np.log((t + 0.5) / (bad + 1)) - np.log((c + 0.5) / (good + 1)) >= toxicity.LEAST_RATIO

    terms = {w for w in set().union(*sets) if strong(*counts(lambda s, w=w: w in s))}
    assert {"scoundrel", "villain", "idiot", "idiots", "idiotic"} <= terms
    stems = [x for x in lex.stems if "idiot".startswith(x)]
    assert len(stems) == 1 and set(lex.words) | set(lex.behind) == terms and set(lex.behind) == {w for w in terms if any(w.startswith(x) for x in lex.stems)}
    for term in lex.words:
        t, c = counts(lambda s, w=term: w in s)
        assert lex.weights[term, "exact"] == pytest.approx(np.log((t + 0.5) / (bad + 1)) - np.log((c + 0.5) / (good + 1)))
    lex.prepare()
    fuzzy = sorted(w for w in terms if len(w) >= toxicity.FUZZY_LEAST)
    for w in ["scoundrol", "1diotic", "idjot", "idiotism", "scoundrel", "vilain", "plain", "xvillainx", "i"]:
        if w in lex.words:
            want = [(w, "exact")]
        elif any(w.startswith(x) for x in lex.stems):
            want = [(x, "stem") for x in lex.stems if w.startswith(x)]
        else:
            want = sorted({(lex.term_of(t), w) for t in fuzzy if brute_distance(w, t) <= 1})
        assert list(lex.of_word(w)) == want, w
    assert lex.of_word("idjot") == ((stems[0], "idjot"),)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(df, lex).collect()}
    for k, s in enumerate(sets):
        total = sum(lex.weight(*m) for m in sorted({m for w in s for m in lex.of_word(w)}))
        z = lex.logit[0] + lex.logit[1] * total
        assert scored[k]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_toxicity_of_misspelled_terms_alone(spark):
    texts, toxic = insults(random.Random(13), 0.3)
    more = ["well you 1diot go home", "such an idjot he was", "a scoundre1 came by", "that vilain again", "a plain and friendly text", "x" * 100_000 + " scoundrol"]
    df = frame(spark, [*texts, *more]).withColumnRenamed("source", "toxic").withColumnRenamed("size", "score").withColumnRenamed("shard", "terms")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    assert [out[400 + k]["predicted"] for k in range(6)] == [1, 1, 1, 1, 0, 1]
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
    assert toxicity.toxicity(df, labels.limit(0)).agg(F.max("score")).head()[0] < 1e-6


def test_quotation_counts_apart():
    text = 'he said "you scoundrel" to me'
    at = text.index("scoundrel")
    assert toxicity.is_quoted(text, at, at + 9)
    assert not toxicity.is_quoted("you scoundrel", 4, 13)


def test_lcs_equals_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(9)
    vocab = [words(rng, ROOTS["en"], 1) + words(rng, ROOTS["de"], 1) for _ in range(3000)]

    def some(n):
        return [rng.choice(vocab) for _ in range(n)]

    items = [some(30) for _ in range(20)]
    docs, leaks = [], set()
    for k in range(60):
        t = some(200)
        if k % 3 == 0:
            x = list(items[k % 20])
            if k % 2:  # a paraphrase: every seventh word replaced
                x = [rng.choice(vocab) if j % 7 == 3 else w for j, w in enumerate(x)]
            at = rng.randrange(170)
            t[at:at] = [w.upper() for w in x]
            leaks.add((k, k % 20))
        docs.append(" ".join(t))
    df = frame(spark, [*docs, None, ""])
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    out = decontaminate.decontaminate(df, bench).collect()
    assert len(out) == 62
    assert {(r["doc_id"], i["item_id"]) for r in out for i in r["items"]} == leaks
    empty = decontaminate.decontaminate(df, bench.where("item_id = 99"))
    assert empty.where("contaminated").count() == 0 and empty.count() == 62


@pytest.mark.parametrize("most", [4096, 100])
def test_decontamination_against_every_window(spark, most, monkeypatch):
    """Recall of the latent search (rank below the passages) against the subsequence check of every window; groups; short items."""
    monkeypatch.setattr(decontaminate, "GROUP", most)
    rng = random.Random(29)
    vocab = [words(rng, ROOTS["en"], 1) + words(rng, ROOTS["fr"], 1) for _ in range(1500)]

    def some(n):
        return [vocab[int(1500 * rng.random() ** 2)] for _ in range(n)]

    items = [some(rng.choice([12, 20, 40, 60, 90])) for _ in range(240)] + [["lonely"], ["two", "words"], some(8)]
    texts: list[str | None] = [None, "", "  "]
    for k in range(160):
        t = some(rng.randint(5, 300))
        if k % 2:
            x, lost = list(items[rng.randrange(240)]), rng.choice([0, 0.1, 0.2, 0.3])
            x = [w for w in x for w in ([w] if rng.random() > lost else rng.choice([[], some(1), [w, *some(1)]]))]
            at = rng.randrange(len(t))
            t[at:at] = x
        texts.append(" ".join(t))
    texts += ["some lonely thing", "two other words two words", texts[-1], "x " * 60_000 + " ".join(items[5])]
    ids, passages = decontaminate.item_passages(list(range(len(items))), [" ".join(x) for x in items])
    want = set()
    for d, t in enumerate(texts):
        (h, first), listed = decontaminate.word_hashes([t]), [p.tolist() for p in passages]
        for w in range(0, len(h), decontaminate.STRIDE):
            window = h[w : w + decontaminate.WINDOW].tolist()
            if len(set(window)) > 1:
                want |= {(d, ids[p]) for p, x in enumerate(listed) if decontaminate.covers(x, window)}
    df = frame(spark, texts).withColumnRenamed("source", "items").withColumnRenamed("size", "share")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], i["item_id"]) for r in decontaminate.decontaminate(df, bench).collect() for i in r["items"]}
    assert got <= want and len(got) >= 0.97 * len(want) > 60
    assert {(163, 240), (164, 241), (166, 5)} <= got
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


def one_by_one(sizes, capacity):
    """Best-fit decreasing, every bin looked at for every item."""
    left, out = {}, []
    for s in sorted(sizes, reverse=True):
        fits = [(c, b) for b, c in left.items() if c >= s]
        b = min(fits)[1] if fits else len(left)
        left[b] = left.get(b, capacity) - s
        out.append((s, b))
    return out


def as_runs(sizes):
    return sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)


def flat(runs, packed):
    return [(s, b) for (s, _), places in zip(runs, packed, strict=True) for b, n in places for _ in range(n)]


def test_packing():
    rng = random.Random(6)
    for high in (20, 60, 150):
        sizes = [rng.randint(1, high) for _ in range(300)]
        runs = as_runs(sizes)
        assert flat(runs, best_fit_decreasing(runs, 100)) == one_by_one(sizes, 100)
        packed = flat(runs, pack_into(runs, 8))
        total = [sum(s for s, b in packed if b == j) for j in range(8)]
        assert sorted(s for s, _ in packed) == sorted(sizes) and max(total) - min(total) <= 8
        assert all(max(b for _, b in one_by_one(sizes, c)) >= 8 for c in range(max(total) - 3, max(total)))  # the least capacity
    assert pack_into([], 4) == [] and flat([(900, 1), (5, 7)], pack_into([(900, 1), (5, 7)], 3))[0] == (900, 0)


@pytest.mark.parametrize("options", [{"shards": 4}, {"capacity": 6000}, {"shards": 4, "exact": 2000}])
def test_sharding(spark, options):
    texts = ["x" * 500] * 40 + [f"text {k} " * (k % 30) for k in range(400)] + [None, "", "y" * 3000]
    out = shard(frame(spark, texts), **options).collect()
    assert len(out) == 443
    by_text, weights = {}, {}
    for r in out:
        t = texts[r["doc_id"]] or ""
        by_text.setdefault(t, set()).add(r["shard"])
        weights[t] = weights.get(t, 0) + r["size"]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
    assert all(len(s) == 1 for s in by_text.values())
    for j in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == j)
        assert slots == list(range(len(slots)))
    if "exact" not in options:  # as every group one by one, up to which group of a size goes where
        runs = as_runs(list(weights.values()))
        want = one_by_one(list(weights.values()), 6000) if "capacity" in options else flat(runs, pack_into(runs, 4))
        assert sorted((weights[t], next(iter(b))) for t, b in by_text.items()) == sorted(want)
    else:
        sizes = [sum(r["size"] for r in out if r["shard"] == j) for j in range(4)]
        sizes.remove(max(sizes))  # the large group's shard
        assert max(sizes) - min(sizes) < 0.1 * sum(sizes)
    assert shard(frame(spark, []), shards=4).count() == 0

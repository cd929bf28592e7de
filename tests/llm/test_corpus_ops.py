"""Operators that compare documents, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from llm import license_scan
from llm.bitmap import bitmap_of, may_hold
from llm.components import connected_components
from llm.exact_dedup import exact_dedup
from llm.near_dedup import near_dedup
from llm.substring_dedup import K, _common, align, chains, passages, seeds, segments, substring_dedup, word_stream
from llm.suffix_dedup import suffix_dedup, suffix_ranks

SCHEMA = "doc_id long, text string, name string, h1 long, a long, n int, c long, pos int"


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "clash", 1, 1, 1, 1, 1) for k, t in docs], SCHEMA)


def prose(rng, n, vocab):
    return [rng.choice(vocab) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    docs, base = [], prose(rng, 150, vocab)
    passage = " ".join(prose(rng, 60, vocab))
    for _ in range(12):
        docs.append(" ".join(prose(rng, rng.randint(3, 200), vocab)))
    docs += [docs[0], docs[0].upper(), docs[1] + " ", docs[2].replace(" ", "\n")]
    for _ in range(60):  # near copies of one text, of which some link
        x = list(base)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice(vocab)
        docs.append(" ".join(x))
    for _ in range(8):
        docs.append(" ".join(prose(rng, 40, vocab)) + " " + passage + " " + " ".join(prose(rng, 30, vocab)))
    docs += ["", None, "  \n", "one two", "One two", "ab " * 200, "x" * 400]
    return list(enumerate(docs))


def test_exact_dedup(spark, corpus):
    norm = {k: re.sub(r"[\x20\x09-\x0D]", "", t or "") for k, t in corpus}
    groups = {}
    for k, t in corpus:
        groups.setdefault(norm[k], []).append((-len(t or ""), k))
    want = {k: (min(groups[norm[k]])[1], len(groups[norm[k]]), hashlib.sha256(norm[k].encode()).hexdigest()) for k, _ in corpus}
    for options in ({"block_chars": 64}, {"block_chars": 100, "hash_bits": 1}):  # the second forces hash clashes
        got = exact_dedup(frame(spark, corpus), **options).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_dedup_of_repeated_ids(spark):
    docs = [(1, "aa"), (1, "bb"), (2, "bb"), (3, "c" * 5000), (3, "c" * 5000), (3, "c" * 4999 + "d"), (4, "c " * 5000), (None, "b b"), (5, None), (5, "")]
    got = exact_dedup(frame(spark, docs)).collect()
    seen = sorted((r["doc_id"] or 0, r["text_sha256"][:4], r["keep_id"], r["group_size"], r["kept"]) for r in got)
    digest = {x: hashlib.sha256(x.encode()).hexdigest()[:4] for x in ("aa", "bb", "c" * 5000, "c" * 4999 + "d", "")}
    want = [(1, "aa", 1, 1, True), (1, "bb", None, 3, False), (2, "bb", None, 3, False), (0, "bb", None, 3, True), (4, "c" * 5000, 4, 3, True), (3, "c" * 4999 + "d", 3, 1, True)]
    want += [(3, "c" * 5000, 4, 3, False)] * 2 + [(5, "", 5, 2, True)] * 2
    assert seen == sorted((i, digest[x], keep, size, kept) for i, x, keep, size, kept in want)


@pytest.mark.parametrize("block_chars", [64])
def test_exact_dedup_of_a_block_in_a_third_of_the_rows(spark, block_chars):
    docs = [(k, ("same" * 16 + f"tail{k % 7}" if k % 3 == 0 else f"own text {k // 2}")) for k in range(600)]
    norm = {k: t.replace(" ", "") for k, t in docs}
    first = {}
    for k, _ in docs:
        first.setdefault(norm[k], k)
    sizes = {x: sum(v == x for v in norm.values()) for x in first}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(frame(spark, docs), block_chars).collect()}
    assert got == {k: (first[norm[k]], sizes[norm[k]]) for k, _ in docs}


def test_exact_dedup_empty(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(edges, nodes):
    parent = {v: v for v in nodes}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def wanted_components(sets, percent):
    links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and 100 * len(x & y) >= percent * len(x | y)]
    return components(links, sets)


@pytest.mark.parametrize("options", [{}, {"sample": 1, "hot_least": 3}, {"sample": 1, "hot_least": 1000}])
def test_near_dedup(spark, corpus, options):
    sets = {k: shingles(t) for k, t in corpus}
    want = wanted_components(sets, 85)
    got = near_dedup(frame(spark, corpus), **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}


@pytest.mark.parametrize("hot_values", [1 << 20, 40])
def test_near_dedup_with_boilerplate_and_large_sets(spark, hot_values, monkeypatch):
    """Sets of over 256 shingles, boilerplate in most texts, families about the threshold; levels for all or a few values."""
    monkeypatch.setattr("llm.near_dedup.HOT_VALUES", hot_values)
    rng = random.Random(19)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6000)]
    stock, docs = prose(rng, 120, vocab), []
    for size in (120, 350, 900):
        base = prose(rng, size, vocab)
        for k in range(25):
            x = list(base)
            for _ in range(rng.randint(0, size // 40)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            docs.append(" ".join(x + stock if k % 3 else x))
    docs += [" ".join(prose(rng, rng.randint(10, 60), vocab) + stock) for _ in range(30)]
    docs = list(enumerate(docs))
    sets = {k: shingles(t) for k, t in docs}
    for percent in (80, 85):
        want = wanted_components(sets, percent)
        got = near_dedup(frame(spark, docs), percent=percent, sample=2).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert 3 < len(set(want.values())) < len(docs)


def test_near_dedup_empty(spark):
    assert near_dedup(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    nodes = {v for e in edges for v in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["v"]: r["c"] for r in got} == components(edges, nodes)


@pytest.mark.parametrize("together", [1000, 2])
def test_suffix_dedup(spark, corpus, together):
    length = 100
    seen, want = set(), {}
    for k, t in corpus:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        want[k] = (len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone))))
    got = suffix_dedup(frame(spark, corpus), together=together).collect()
    assert {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got} == want


def test_suffix_ranks():
    rng = random.Random(2)
    for length in (1, 5, 8, 13, 32, 100):
        text = bytes(rng.choice(b"aab\0") for _ in range(400)) + b"ab" * 150
        ranks = suffix_ranks(np.frombuffer(text, np.uint8), length)
        cut = [text[i : i + length] for i in range(len(text) - length + 1)]
        names = {w: k for k, w in enumerate(sorted(set(cut)))}
        order = sorted(range(len(cut)), key=lambda i: ranks[i])
        assert [names[cut[i]] for i in order] == sorted(names[w] for w in cut)
        assert all((ranks[i] == ranks[j]) == (cut[i] == cut[j]) for i, j in zip(order, order[1:], strict=False))


def test_suffix_dedup_of_a_very_long_repetitive_text(spark):
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = [(0, "".join(line[: rng.randrange(20, 90)] + str(k) for k in range(4000))), (1, line * 3000), (2, "é" * 120)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup(frame(spark, texts), together=5).collect()}
    seen = set()
    for k, t in texts:
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p] += 1
                gone[p + 100] -= 1
            seen.add(b[p : p + 100])
        assert got[k] == bytes(np.frombuffer(b, np.uint8)[np.cumsum(gone)[:-1] == 0])


def test_suffix_dedup_empty(spark):
    assert suffix_dedup(frame(spark, [])).count() == 0


def test_seeds_reach_every_run():
    rng = random.Random(4)
    for n_vocab in (2, 30, 5000):
        text = [str(rng.randrange(n_vocab)) for _ in range(600)]
        words, first = word_stream([" ".join(text), "", " ".join(text[100:300])])
        owner, place, a = seeds(words, first)
        for t, n in ((0, 600), (2, 200)):
            at = set(place[owner == t].tolist())
            assert all(any(p in at for p in range(s, s + K - 1)) for s in range(n - 2 * K + 3))
        names = {}
        for t, p, h in zip(owner.tolist(), place.tolist(), a.tolist(), strict=True):
            assert names.setdefault(h, text[100 * (t > 0) + p :][:K]) == text[100 * (t > 0) + p :][:K]
        inner = {(p - 100, h) for t, p, h in zip(owner.tolist(), place.tolist(), a.tolist(), strict=True) if t == 0 and 100 <= p <= 300 - K}
        assert inner == {(p, h) for t, p, h in zip(owner.tolist(), place.tolist(), a.tolist(), strict=True) if t == 2}


def test_chains_equal_quadratic_search():
    rng = random.Random(3)
    for _ in range(80):
        m = sorted({(rng.randrange(60), rng.randrange(60), rng.choice([0, 0, 3, 9])) for _ in range(rng.randint(1, 25))})
        best = {}
        for a, b, n in m:
            best[a, b, n] = n + 8 + max([0.0, *(s - 0.2 * (a - x - l + b - y - l) for (x, y, l), s in best.items() if x + l < a and y + l < b)])
        found = chains(m, k=8)
        assert sorted(p for c in found for p in c) == list(range(len(m)))
        top = [m[i] for i in found[0]]
        score = sum(n + 8 for _, _, n in top) - sum(0.2 * (x - p - n + y - q - n) for (p, q, n), (x, y, _) in zip(top, top[1:], strict=False))
        assert score == pytest.approx(max(best.values()))


def test_align_against_edit_free_words():
    rng = random.Random(8)
    for _ in range(100):
        x = [rng.randrange(10**6) for _ in range(120)]
        y = [w for w in x for w in ([w] if rng.random() > 0.1 else rng.choice([[], [rng.randrange(10**6)], [w, 5]]))]
        a, b = rng.randrange(40), rng.randrange(40)
        one, two = np.array([*range(a), *x, *range(100, 140)]), np.array([*range(-b, 0), *y, *range(-900, -860)])
        at = {w: i for i, w in enumerate(one.tolist())}
        runs = [i for i in range(len(two) - K + 1) if all(at.get(two[i + j]) == at.get(two[i], -9) + j for j in range(K))]
        if len(runs) < 2:
            continue
        found = [s for s, _ in segments(np.array([at[two[i]] for i in runs]), np.array(runs))]
        for p, q, r, s, identity in align([found[i] for i in chains(found)[0]], one, two):
            true = _common(one[r:s].tolist(), two[p:q].tolist()) / max(s - r, q - p)
            assert identity >= 0.8 and true >= identity - 1e-9 and true - identity < 0.08


def test_substring_dedup(spark, corpus):
    got = {r["doc_id"]: r for r in substring_dedup(frame(spark, corpus)).collect()}
    assert set(got) == {k for k, _ in corpus}
    least, seen, hits = 51, {}, 0
    for k, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert got[k]["n_words"] == len(w)
        inside = [any(s["start"] <= i < s["end"] for s in got[k]["spans"]) for i in range(len(w))]
        for p in range(len(w) - least + 1):
            key = tuple(w[p : p + least])
            if key in seen:  # words beyond what the first holder of the passage shares may stay out
                assert sum(inside[p : p + least]) >= least - 3, (k, p)
                hits += 1
            seen[key] = k
    assert not got[3]["spans"] and not got[0]["spans"] and hits > 100


def test_substring_dedup_empty(spark):
    assert substring_dedup(frame(spark, [])).count() == 0


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    prose_ = "the quick brown fox jumps over the lazy dog near the river bank while nobody sees it\n" * 3
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.txt", prose_), (3, "a/b/y.txt", prose_), (4, "a/b/COPYING", prose_ + gpl), (5, "a/b/c/z.txt", prose_), (6, "q/w.txt", prose_),
        (7, "q/own.txt", prose_ + mit), (8, None, None), (9, "a/e.txt", ""), (10, "a/x.txt", prose_),
    ]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, path string, text string, license string, score double")
    got = {r["doc_id"]: (r["license"], r["origin"], r["inherited_from"]) for r in license_scan.license_scan(df).collect()}
    assert got == {
        1: ("MIT", "header", None), 2: ("MIT", "inherited", "a/LICENSE"), 3: ("GPL-3.0", "inherited", "a/b/COPYING"), 4: ("GPL-3.0", "header", None),
        5: ("GPL-3.0", "inherited", "a/b/COPYING"), 6: (None, "none", None), 7: ("MIT", "header", None), 8: (None, "none", None),
        9: ("MIT", "inherited", "a/LICENSE"), 10: ("MIT", "inherited", "a/LICENSE"),
    }
    assert license_scan.license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [1, 3])
@pytest.mark.parametrize("n", [3, 30])
def test_license_scan_of_a_frequent_license(spark, n, share):
    prose_ = "the quick brown fox jumps over the lazy dog\n"
    rows = [(k, f"{k}/x.txt", prose_ + "Released under the MIT License." if k % share == 0 else prose_) for k in range(n)]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {k: ("MIT", "header") if k % share == 0 else (None, "none") for k in range(n)}


def test_license_scan_does_not_depend_on_the_size_of_the_table(spark):
    prose_ = "this project file is for the public and its details are in the work that you see\n"
    headers = {0: "This project is released under the MIT License.", 1: "// Licensed under the Apache License, Version 2.0 - see LICENSE for details"}
    texts = [prose_ + headers.get(k, f"word{k} other{k} third{k}") for k in range(20)]
    found = []
    for times in (1, 200):
        df = spark.range(20 * times).selectExpr("id AS doc_id", "concat(id, '/x.txt') AS path", f"element_at(array({', '.join(map(repr, texts))}), cast(id % 20 + 1 AS int)) AS text")
        got = license_scan.license_scan(df).selectExpr("doc_id % 20 AS k", "license", "score").distinct().collect()
        found.append({r["k"]: (r["license"], r["score"]) for r in got})
        assert len(got) == 20
    assert found[0] == found[1]
    assert [found[0][k][0] for k in range(3)] == ["MIT", "Apache-2.0", None]


def brute_licenses(texts):
    """Own license and score of each text by the definition in the module's docstring."""
    L = license_scan
    templates = L.template_terms()
    vocabulary = {t for _, _, terms in templates for t in terms}
    near = {t for _, _, terms in templates[: len(L.STATEMENTS)] for t in terms}
    split = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    n = len(texts)
    idf = {t: 1 - math.log(max(sum(t in w for w in split) / n, L.RAREST)) for t in vocabulary}
    rare = 1 - math.log(L.RAREST)

    def best(unit):
        held, out = set(unit) & vocabulary, (0.0, None)
        norm = math.sqrt(sum(idf[t] ** 2 for t in held) + rare**2 * len(set(unit) - held))
        for _, name, terms in templates:
            dot = sum(idf[t] ** 2 for t in terms if t in held) / math.sqrt(sum(idf[t] ** 2 for t in terms))
            out = min(out, (-round(dot / norm, 6), name), key=lambda x: (x[0], x[1] or "~"))
        return -out[0], out[1]

    found = []
    for w in split:
        options = []
        if len(set(w) & set(L.MARKS)) > 1:
            options += [x for x in [best(w)] if x[0] >= L.WHOLE]
        marks = [i for i, x in enumerate(w) if x in L.MARKS]
        runs = [[marks[0]]] if marks else []
        for i in marks[1:]:
            runs[-1].append(i) if i - runs[-1][-1] <= L.GAP else runs.append([i])
        for run in runs:
            if len(run) > 1:
                a, b = run[0], run[-1] + 1
                low, high = max(0, a - L.BESIDE), min(len(w), b + L.BESIDE)
                while a > low and w[a - 1] in near:
                    a -= 1
                while b < high and w[b] in near:
                    b += 1
                options += [x for x in [best(w[a:b])] if x[0] >= L.HEADER]
        for span in L.spans():
            cut = [w[a : a + span] for a in range(0, len(w), span // 4)]
            options += [x for x in [best(v) for v in cut if sum(x in L.MARKS for x in v) >= L.DENSE] if x[0] >= L.WHOLE]
        ends = [-1, *[i for i, x in enumerate(w) if x not in vocabulary], len(w)]
        runs = [w[a + 1 : b] for a, b in zip(ends, ends[1:]) if b - a > L.RUN]
        options += [x for x in [best(v) for v in runs if sum(x in L.MARKS for x in v) >= L.DENSE] if x[0] >= L.WHOLE]
        found.append(min(((-s, name) for s, name in options), default=(0, None)))
    return [(name, -s) for s, name in found]


def test_license_scan_against_brute_force(spark):
    rng = random.Random(31)
    L = license_scan
    vocab = [w for _, _, terms in L.template_terms() for w in terms] + [f"word{k}" for k in range(300)] + L.MARKS
    texts: list[str | None] = [None, "", "license license", "MIT"]
    for k in range(150):
        t = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        if k % 3:
            x = rng.choice([*L.STATEMENTS, *L.TEXTS, *L.PASSAGES])[1].split()
            x = [w for w in x if rng.random() > 0.08]
            at = rng.randrange(len(t))
            t = x if k % 3 == 1 else [*t[:at], *x, *t[at:]]
        texts.append("".join(w + rng.choice([" ", " ", "\n", ", "]) for w in t))
    texts.append("word5 " * 30_000 + "released under the MIT license" + " word7" * 30_000)
    df = spark.createDataFrame([(k, f"{k}/x.txt", t, "clash", 2) for k, t in enumerate(texts)], "doc_id long, path string, text string, terms string, n int")
    got = {r["doc_id"]: (r["license"], r["score"]) for r in L.license_scan(df).where("origin <> 'inherited'").collect()}
    want = brute_licenses(texts)
    assert len({name for name, _ in want}) > 8 and want[-1][0] == "MIT"
    for k, (name, score) in enumerate(want):
        assert got[k] == (name, pytest.approx(score, abs=2e-6)), (k, texts[k])


def test_templates_hold_marks():
    for _, text in [*license_scan.TEXTS, *license_scan.PASSAGES]:
        assert sum(w in license_scan.MARKS for w in re.findall("[a-z0-9]+", text.lower())) >= license_scan.DENSE, text
    for _, text in [*license_scan.STATEMENTS, *license_scan.TEXTS, *license_scan.PASSAGES]:
        assert len(set(re.findall("[a-z0-9]+", text.lower())) & set(license_scan.MARKS)) > 1, text


def test_licenses_within_longer_files(spark):
    """Texts and passages behind a comment sign before much code, and before more of a license, are found; code alone has none."""
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(400)]
    code = "\n".join(f"def {rng.choice(names)}({rng.choice(names)}, n={k}):\n    return {rng.choice(names)} + {rng.choice(names)}" for k in range(60))
    shown = [*license_scan.TEXTS, *license_scan.PASSAGES]
    long_ = " ".join(rng.choice(names) for _ in range(3000))
    texts = []
    for name, text in shown:
        lines = re.findall(r"(?s).{1,70}(?:\s|$)", text)
        texts.append((name, "x.py", "# Copyright (c) 2020 Somebody\n" + "".join(f"# {x}\n" for x in lines) + code))
        texts.append((name, "y.py", code + "\n/*\n" + "\n * ".join(lines) + "*/\n" + code))
        texts.append((name, "LICENSE", text + " " + long_))
    texts += [(None, "z.py", code), (None, "LICENSE", long_)]
    df = spark.createDataFrame([(k, f"{k}/{file}", t) for k, (_, file, t) in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(df).collect()}
    assert {k: (got[k], t[:200]) for k, (name, _, t) in enumerate(texts) if got[k] != name} == {}


def test_license_texts_are_license_files(spark):
    texts = dict(license_scan.TEXTS)
    rows = [(k, f"{k}/any.txt", f"Copyright (c) 2020 Somebody\n\n{text}") for k, text in enumerate(texts.values())] + [(50 + k, f"{k}/src/x.py", "print()") for k in range(len(texts))]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {k: (name, "header") for k, name in enumerate(texts)} | {50 + k: (name, "inherited") for k, name in enumerate(texts)}


def test_substring_dedup_of_short_shared_lines(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)]
    lines, passage = [prose(rng, 16, vocab) for _ in range(3)], prose(rng, 60, vocab)
    docs = [prose(rng, 40, vocab) + x + prose(rng, 40, vocab) for x in [*lines, passage]]
    stock = prose(rng, 30, vocab) + lines[0] + prose(rng, 12, vocab) + lines[1] + prose(rng, 12, vocab) + lines[2] + prose(rng, 30, vocab)
    docs += [stock, prose(rng, 30, vocab) + passage + prose(rng, 30, vocab)]
    aligned = [{"start": 28 * k, "end": 28 * k + 16, "partner": k, "partner_start": 40, "partner_end": 56, "identity": 1.0} for k in range(3)]
    assert passages(aligned) == []
    near = [{"start": a, "end": a + 28, "partner": 0, "partner_start": a + 5, "partner_end": a + 33, "identity": 1.0} for a in (0, 36)]
    assert passages([*near, {"start": 66, "end": 86, "partner": 7, "partner_start": 0, "partner_end": 20, "identity": 1.0}]) == [(0, 86, {0, 7})]
    assert passages(near) == [(0, 64, {0})]  # one partner and 56 of 64 words agree
    got = {r["doc_id"]: r for r in substring_dedup(frame(spark, [(k, " ".join(x)) for k, x in enumerate(docs)])).collect()}
    assert not got[4]["spans"]
    assert [(s["start"], s["end"]) for s in got[5]["spans"]] == [(30, 90)]


def test_substring_dedup_of_edited_passages(spark):
    """Recall and precision on passages edited by 0 to 15 %, alone or with partial holders before them."""
    rng = random.Random(23)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    stock = [prose(rng, 10, vocab) for _ in range(5)]

    def around(x):
        return [*prose(rng, rng.randint(20, 60), vocab), *rng.choice(stock), *x, *prose(rng, rng.randint(10, 40), vocab)]

    docs, planted = [], {}
    for n in range(120):
        x, share = prose(rng, 70, vocab), (0, 0.05, 0.1, 0.15)[n % 4]
        if n % 3 == 0:
            docs.append(around(x[: rng.randint(20, 40)]))  # holds a part alone
        docs.append(around(x))
        y = [w for w in x for w in ([w] if rng.random() >= share else rng.choice([[], [rng.choice(vocab)], [w, rng.choice(vocab)]]))]
        planted[len(docs)] = (share, y)
        docs.append(around(y))
    texts = [(k, " ".join(x)) for k, x in enumerate(docs)] + [(len(docs), " ".join(stock[k % 5][0] for k in range(30_000)))]
    got = {r["doc_id"]: r for r in substring_dedup(frame(spark, texts)).collect()}
    assert not [k for k in range(len(docs)) if k not in planted and got[k]["spans"]]
    found = {share: [bool(got[k]["spans"]) for k, (s, _) in planted.items() if s == share] for share in (0, 0.05, 0.1, 0.15)}
    assert all(found[0]) and all(found[0.05]) and sum(found[0.1]) >= 0.9 * len(found[0.1]) and sum(found[0.15]) >= 0.75 * len(found[0.15]), {k: sum(v) / len(v) for k, v in found.items()}
    covered = []
    for k, (_, y) in planted.items():
        inside = {i for s in got[k]["spans"] for i in range(s["start"], s["end"])}
        at = {i for i in range(len(docs[k]) - len(y) + 1) if docs[k][i : i + len(y)] == y}.pop()
        assert len(inside - set(range(at - 14, at + len(y) + 4))) == 0  # a stock line may stand before
        covered += [len(inside & set(range(at, at + len(y)))) / len(y)] if inside else []
    assert sum(covered) > 0.85 * len(covered) and min(covered) > 0.5
    assert got[len(docs)]["n_repeated"] > 29_000


@pytest.mark.parametrize("n", [0, 5, 40_000])
def test_bitmap(spark, n):
    bits = bitmap_of(spark.range(n).selectExpr("xxhash64(id) AS a"))
    a = np.array([r["a"] for r in spark.range(2 * n + 100).selectExpr("xxhash64(id) AS a").collect()])
    found = may_hold(bits, a)
    assert found[:n].all() and found[n:].sum() <= 0.05 * len(found[n:])


def test_substring_dedup_of_passages_known_in_parts(spark):
    """Each part of a passage is first seen in a document of its own; a later whole copy repeats the earlier one all the same."""
    rng = random.Random(11)

    def noise(n):
        return [f"n{rng.randrange(10**9)}" for _ in range(n)]

    passage = [f"p{k}" for k in range(64)]
    parts = [noise(30) + passage[k : k + 12] + noise(30) for k in range(0, 60, 6)]
    cycle = noise(7) * 12  # equal to itself seven words on
    docs = [*parts, noise(40) + passage + noise(40), noise(20) + passage + noise(60), noise(80), noise(10) + cycle, noise(5) + passage[:50]]
    got = {r["doc_id"]: r for r in substring_dedup(frame(spark, [(k, " ".join(x)) for k, x in enumerate(docs)])).collect()}
    assert [got[k]["n_repeated"] for k in range(11)] == [0] * 11 and got[12]["n_repeated"] == 0
    assert [tuple(s) for s in got[11]["spans"]] == [(20, 84)] and 10 in got[11]["partners"]
    assert got[13]["n_repeated"] == 84 - 7 and got[14]["n_repeated"] == 0

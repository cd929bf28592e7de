"""Whitening, importance resampling and byte-level BPE against brute force and the public library."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from llm import resampling, whitening
from llm.byte_bpe import ByteBpe, ByteDecoder, Transducer, byte_bpe_decode, byte_bpe_encode_decode

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def embeddings(spark, rows):
    return spark.createDataFrame([(k, v, 1, 0.5, 7) for k, v in rows], "vec_id long, embedding array<double>, label int, whitened double, n long")


def brute_whitening(vectors, components):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    once = sorted(set(map(tuple, x)))
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    dim = len(sums)
    v = np.array([[(n * sum(r[i] * r[j] for r in once) - sums[i] * sums[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    away = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    white = np.array([[c / n for c in r] for r in away]) @ axes / np.sqrt(values)
    return n, [sum(c * c for c in r) for r in away], white, values / np.trace(v)


@pytest.mark.parametrize("scale", [0.2, 3e4, 1e11])
def test_whitening_equals_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6)) * scale + 5 * scale
    vectors = [*mixed.tolist(), *mixed[:40].tolist()]
    out = whitening.whiten(embeddings(spark, enumerate(vectors)), components=4).orderBy("vec_id", "component").collect()
    n, deviation, white, explained = brute_whitening(vectors, 4)
    assert len(out) == 190 * 4 and {r["n"] for r in out} == {n}
    got = np.array([r["whitened"] for r in out]).reshape(-1, 4)
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, rtol=1e-9, atol=1e-9)
    assert [int(r["deviation"]) for r in out[::4]] == deviation
    assert np.allclose([r["explained"] for r in out[:4]], explained, rtol=1e-9)
    assert max(r["identity_error"] for r in out) < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [3.0, 5.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0])]
    out = whitening.whiten(embeddings(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in out} == {3} and out[0]["identity_error"] < 1e-12
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0  # no variance
    flat = whitening.whiten(embeddings(spark, [(1, [2.0, 3.0]), (2, [5.0, 3.0]), (3, [1e300, 3.0])])).collect()
    assert [r["component"] for r in flat] == [1, 1, 1]  # one dimension is constant; 1e300 counts as 2**62 / 64


def test_scatter_is_exact_beyond_64_bits():
    rng = random.Random(2)
    rows = [[rng.randint(-(1 << 62), 1 << 62) for _ in range(3)] for _ in range(9000)]
    total = whitening.Scatter(3)
    total.add(np.array(rows[:5000]))
    total.add(np.array(rows[5000:]))
    assert total.n == 9000 and total.sums.tolist() == [sum(c) for c in zip(*rows, strict=True)]
    assert total.products[0, 2] == sum(r[0] * r[2] for r in rows) and total.products[1, 1] == sum(r[1] ** 2 for r in rows)
    back = Counter()
    for i, j, k, limb in total.rows():
        back[i, j] += limb << 32 * k
    assert back[0, 2] == total.products[0, 2] and back[-1, -1] == 9000 and back[1, -1] == total.sums[1]


def brute_resampling(docs, target, longest, buckets=10_000, least=20, percent=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(w), [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    held = [(k, *runs(t)) for k, t in docs]
    s = Counter(bucket(f) for _, _, x in held for f in x)
    t = Counter(bucket(f) for x in target for f in runs(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out = []
    for k, n, x in held:
        weight = sum(gain[bucket(f)] for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
        score = None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, n, len(x), weight, score, None])
    may = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for place, r in enumerate(may[: len(may) * percent // 100], 1):
        r[5] = place
    return out


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 3000)
    rng = random.Random(7)
    pool = ["The", "the", "été", "x1", "7", "日本", "a", "B"] + ["w" + str(k) for k in range(200)]
    docs = [(k, " ".join(rng.choice(pool) + rng.choice(["", ",", ".\n", "-"]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs += [(300, None), (301, ""), (302, "!?"), (5, docs[5][1]), (None, docs[9][1]), (303, "the " * 40_000)]
    target = ["w1 w2 w3 the the", None, "unseen words été", ""]
    frame = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in docs], "doc_id long, text string, rank long, gain long, feature string").repartition(3)
    out = resampling.importance_resampling(frame, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long"), longest=longest, percent=30)
    got = [[r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in out.collect()]
    key = lambda r: [-(10**9) if x is None else x for x in r]
    want = brute_resampling(docs, target, longest, percent=30)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[5] is not None for r in got) > 50


def test_resampling_stores_blocks_in_short_rows(spark, monkeypatch):
    """Readers and writers hold thousands of rows at once: none is longer than a document or a chunk of features."""
    monkeypatch.setattr(resampling, "CHUNK", 16)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(i % 40))) for i in range(100)] + [(100, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = resampling._blocks(frame, 1).collect()
    assert max(len(r["feature"] or []) for r in rows) == 16 and len({r["block"] for r in rows}) == 1
    assert sorted(r["doc_id"] for r in rows if r["which"] is not None) == list(range(101))
    assert max(len(r["which"] or []) for r in rows) == 39
    target = ["w7x1 w7x2 w9x3"]
    out = resampling.importance_resampling(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(tuple(r)[:5] for r in brute_resampling(docs, target, 1))


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.importance_resampling(empty, some).count() == 0
    assert [r["weight"] for r in resampling.importance_resampling(some, empty).collect()] == [brute_resampling([(1, "a b")], [], 1)[0][3]]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return ByteBpe(f.read(), public_tokenizers.PATTERN)


def texts(n):
    rng = random.Random(11)
    pool = list("aAéΣ漢🙂 \n\t-$'ǅ\x1c\x85\xa0  1²½\x00") + ["'s", "'re", "hello", " the", "aaaa", "  ", "\r\n", "0000", " x ", "<|endoftext|>"]
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 126)])) for _ in range(50)) for _ in range(n // 4)]
    out += ["".join(rng.choice("etaoins") for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*out, "", " ", "a" * 5000, " " * 3000, "=-" * 3000, "".join(rng.choice("etaoin") for _ in range(20_000))]


def test_byte_bpe_equals_the_library(coder, library):
    every = texts(1500)
    for k in range(0, len(every), 200):
        part = every[k : k + 200]
        for text, ids in zip(part, coder.encode(part), strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == library.encode_ordinary(text), text[:60]


def test_transducer_forgets_and_waits_within_bounds():
    """Small random tables of ranks: any merge order, few states kept; nothing waits longer than two longest tokens."""
    rng = random.Random(3)
    for _ in range(12):
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 25:  # each token joins two earlier ones, as in a trained table
            t = rng.choice(tokens) + rng.choice(tokens)
            if t not in tokens and len(t) < 9:
                tokens.append(t)
        ranks = {t: k for k, t in enumerate(tokens)} | {bytes([b]): 1000 + b for b in range(256) if bytes([b]) not in tokens}
        library = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        machine = Transducer(ranks, most_states=10, most_pairs=20)
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(120)]
        for k in (1, 30, 120):
            flat, counts = machine.encode(pieces[:k])
            ends = np.cumsum(counts).tolist()
            for p, a, b in zip(pieces[:k], [0, *ends], ends, strict=False):
                assert flat[a:b].tolist() == [t for t in library.encode_ordinary(p.decode())] if p not in ranks else True
        assert max(sum(len(tokens[t]) for t in items[-1][0]) for items in machine.items) <= 2 * max(map(len, tokens))


def test_decoder_streams(coder, library):
    decoder = ByteDecoder(coder.transducer.token_bytes)
    for text in texts(60):
        ids = np.array(library.encode_ordinary(text), np.int64)
        assert decoder.decode(ids) == text
        decoder.reset()
        assert "".join(decoder.feed(ids[k : k + 1]) for k in range(len(ids))) + decoder.end() == text
    rng = random.Random(9)
    single = [t for t, b in enumerate(coder.transducer.token_bytes) if len(b) == 1 and b[0] > 90]
    for _ in range(800):  # bytes that are no UTF-8, as one list and one by one
        ids = np.array([rng.choice(single) for _ in range(rng.randint(0, 8))], np.int64)
        want = b"".join(coder.transducer.token_bytes[i] for i in ids.tolist()).decode("utf-8", "replace")
        assert decoder.decode(ids) == want
        decoder.reset()
        assert "".join(decoder.feed(ids[k : k + 1]) for k in range(len(ids))) + decoder.end() == want
    held = decoder.feed(np.array(library.encode_ordinary("漢"), np.int64)[:1])
    assert held == "" and decoder.held


def test_byte_bpe_tables(spark, library):
    rows = [(1, None), (2, ""), (3, "x x"), (3, "x x"), (None, "漢字 é"), (5, "word " * 60_000)]
    docs = spark.createDataFrame([(k, t, 1, [2], "z") for k, t in rows], "doc_id long, text string, n_tokens int, ids array<int>, decoded string")
    out = byte_bpe_encode_decode(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted(((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in out.collect()), key=lambda r: r[0])
    assert got == sorted(((k or 0, library.encode_ordinary(t or ""), t or "") for k, t in rows), key=lambda r: r[0])
    again = byte_bpe_decode(out, RANKS).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in again) == sorted((k or 0, t or "") for k, t in rows)
    odd = spark.createDataFrame([(1, None), (2, [-1, 10**6, None])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in byte_bpe_decode(odd, RANKS).orderBy("doc_id").collect()] == ["", "�" * 3]
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert byte_bpe_encode_decode(broken, RANKS, public_tokenizers.PATTERN).head()["decoded"] == "a�b"
    assert byte_bpe_encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0

"""Order statistics by distributed selection, and overlaps by a grid, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumenbox.functions import geometry as g
from lumenbox.functions.text import normalise_ocr
from lumenbox.operators import containment, layout, metrics, selection

NAN, INF = float("nan"), float("inf")


def groups():
    rng = random.Random(8)
    out = {"wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(200)], "ties": [float(rng.randint(0, 3)) for _ in range(101)]}
    out["close"] = [1.7e9 + rng.randint(0, 5000) * 2.0**-20 for _ in range(300)]  # all in one logarithmic range
    out["closer"] = [1.0 + k * 2.0**-52 for k in range(40)] + [INF] * 3
    out |= {"one": [4.5], None: [0.0, -0.0, 2.0, -3.0], "odd": [NAN, INF, -INF, 1.0, NAN], "none": [None]}
    return out


def test_ranks_equal_brute_force(spark):
    rows = [(k, v) for k, vs in groups().items() for v in vs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    wanted = {"low": (0, selection.lower_middle), "high": (0, selection.upper_middle), "p90": (0, selection.at_share(0.9)), "first": (0, lambda n: F.lit(0)), "last": (1, lambda n: n - 1)}
    out = selection.select_ranks(selection.value_counts(df, ["k"], [F.col("x"), -F.col("x")]), ["k"], wanted)
    got = {r["k"]: [r[name] for name in wanted] for r in out.collect()}
    assert set(got) == set(groups()) - {"none"}
    for k, vs in groups().items():
        if k != "none":
            s, t = (sorted(x, key=lambda v: (v != v, v)) for x in (vs, [-v for v in vs]))
            n = len(s)
            want = [s[(n - 1) // 2], s[n // 2], s[min(n - 1, int(0.9 * n))], s[0], t[-1]]
            assert all(a == b or (a != a and b != b) for a, b in zip(got[k], want, strict=True)), (k, got[k], want)


def test_no_state_that_grows_with_a_group(spark):
    trials = spark.createDataFrame([("a", True, True, 0.5, 1.0, 2.0, "tight")], "variant string, found boolean, click_hit boolean, iou double, centre_error_px double, latency_s double, box_kind string")
    plan = metrics.aggregate_trials(trials, "variant")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan and "median(" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("keys", [[], ["variant"]])
def test_aggregates_of_no_trials(spark, keys):
    trials = spark.createDataFrame([], "variant string, found boolean, click_hit boolean, iou double, centre_error_px double, latency_s double, box_kind string")
    out = metrics.aggregate_trials(trials, *keys).collect()
    assert [r["n"] for r in out] == ([] if keys else [0])


def brute_dedupe(lines):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(0, w) * max(0, h)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return inter / union if union > 0 else 0

    kept = []
    for k, b, t in sorted(lines, key=lambda x: (-len(x[2] or ""), x[0])):
        if b is None or not any(o[1] and (iou(b, o[1]) > 0.6 or (t and t == o[2] and iou(b, o[1]) > 0.2)) for o in kept):
            kept.append((k, b, t))
    return sorted(k for k, _, _ in kept)


def screen_frame(spark, screens):
    rows = [(s, k, b, t, 9) for s, lines in screens.items() for k, b, t in lines]
    return spark.createDataFrame(rows, f"screen_id long, ord long, box {g.BOX}, text string, _cell long")


def test_dedupe_on_a_grid_equals_brute_force(spark):
    rng = random.Random(6)
    screens = {}
    for s in range(8):
        n = [0, 1, 5, 60, 120, 60, 80, 200][s]
        spread = [1, 1, 5, 300, 900, 10, 2000, 400][s]
        boxes = [(x := rng.uniform(-50, spread), y := rng.uniform(-50, spread / 2), x + rng.choice([0, 3, 40, 300 * (s == 6)]), y + rng.choice([0, 2, 15])) for _ in range(n)]
        screens[s] = [(k, tuple(map(float, b)) if rng.random() > 0.03 else None, rng.choice(["", "aa", "ab", "abc", None])) for k, b in enumerate(boxes)]
    out = layout.dedupe_text(screen_frame(spark, screens).drop("_cell"))
    assert out.columns == ["screen_id", "ord", "box", "text"]
    got = {}
    for r in out.collect():
        got.setdefault(r["screen_id"], []).append(r["ord"])
    assert {s: sorted(k) for s, k in got.items()} == {s: brute_dedupe(lines) for s, lines in screens.items() if lines}


def test_candidates_are_linear_on_a_dense_screen(spark):
    """Of 5,000 boxes on one screen, spread or with a few large ones, a box meets a bounded number of others."""
    rng = random.Random(12)
    small = [(k, (x := rng.uniform(0, 3000), y := rng.uniform(0, 1700), x + 30, y + 12), f"t{k}") for k in range(5000)]
    large = [(5000 + k, (0.0, 0.0, 3000.0, 1700.0), "all") for k in range(3)]
    cells = layout.in_cells(screen_frame(spark, {1: small + large}).drop("_cell"))
    per_cell = cells.where("ord < 5000").groupBy("_cell").count()
    pairs = per_cell.select(F.sum(F.col("count") * (F.col("count") - 1) / 2)).head()[0]
    assert cells.count() < 6 * 5000 and pairs < 20 * 5000
    assert cells.where("_home").count() == 5003


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choice("abc") for _ in range(rng.choice([0, 2, 3, 8, 40, 200])))) for k in range(150)] + [(900, None), (901, "abc"), (902, "abc")]
    lines = ["", "ab", "abc", "abca", "zzzz", "a" * 30, None, *[t[a : a + n] for _, t in texts[:60] if t for a, n in [(rng.randrange(len(t)), rng.choice([2, 3, 4, 7, 11, 12, 13, 30]))]]]
    lines += lines[:4]
    want = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "n long, line string")
    read = spark.createDataFrame(texts, "doc_id long, text string")
    out = containment.corpus_lines(want, read, "doc_id")
    holds = lambda x: sum(bool(x) and t is not None and (t == x or (len(x) > 3 and x in t)) for _, t in texts)
    assert {r["n"]: (r["line"], r["texts"]) for r in out.collect()} == {k: (x, holds(x)) for k, x in enumerate(lines)}
    score = containment.corpus_score(want, read, "doc_id").head()
    told = [x for x in lines if x]
    assert (score["expected"], score["found"], score["read"]) == (len(told), sum(holds(x) > 0 for x in told), len({t for _, t in texts if t}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("sent", "bits"), [(1 << 20, 24), (0, 24), (1 << 20, 6)])
def test_containment_by_each_path(spark, monkeypatch, sent, bits):
    """Characters of one to four bytes, lines about the anchors' sizes; sent to the texts or met by key; a bitmap that is full."""
    monkeypatch.setattr(containment, "SENT_BYTES", sent)
    monkeypatch.setattr(containment, "MOST_BITS", bits)
    monkeypatch.setattr(containment, "LEAST_BITS", min(bits, containment.LEAST_BITS))
    rng = random.Random(8)
    texts = [(k, "".join(rng.choice("abñ語𝒳") for _ in range(rng.choice([0, 1, 2, 3, 4, 9, 60])))) for k in range(120)] + [(500, None), (501, "ñó"), (502, "ab"), (503, "ñó")]
    lines = [t[a : a + n] for _, t in texts if t for n in (1, 2, 3, 4, 5, 8, 12, 13) for a in [rng.randrange(len(t))]] + ["ñó", "ab", "語語語語語語", "zzzzzzzzzzzzz"]
    want = spark.createDataFrame([(x,) for x in lines], "line string")
    out = containment.containing(want, spark.createDataFrame(texts, "doc_id long, text string"), "doc_id").collect()
    brute = {(x, k) for x in set(lines) for k, t in texts if t and (t == x or (len(x) > 3 and x in t))}
    assert len(out) == len(brute) and {(r["line"], r["key"]) for r in out} == brute


def test_containment_reads_texts_once_and_moves_no_runs(spark, tmp_path):
    """Texts of 100,000 characters meet few lines: no row for each character, no exchange of texts or of their runs."""
    rng = random.Random(9)
    texts = [(k, "".join(rng.choice("abcdefghij") for _ in range(100_000))) for k in range(4)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/texts")
    want = spark.createDataFrame([(texts[k % 4][1][a : a + n],) for k in range(20) for a, n in [(1000 * k, 9 + k)]], "line string")
    read = spark.read.parquet(f"{tmp_path}/texts")
    anchored = containment._anchored(want.distinct())
    runs = containment._with_anchors(read, containment._bitmaps(anchored)[0])
    assert runs.select(F.sum(F.size("anchors"))).head()[0] < 4000
    out = containment.corpus_lines(want, read, "doc_id")
    assert out.where("texts > 0").count() == 20
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/texts") == 1, plan


def test_corpus_score_normalises_a_text_once_for_each_side(spark, tmp_path):
    """One pass looks for lines and one counts distinct texts; empty and null ones are not counted."""
    rows = [(1, "The Cat, sat."), (2, "the cat sat"), (3, "..."), (4, None), (5, "dog")]
    spark.createDataFrame(rows, "doc_id long, raw string").coalesce(1).write.parquet(f"{tmp_path}/raw")
    texts = spark.read.parquet(f"{tmp_path}/raw").select("doc_id", normalise_ocr(F.col("raw")).alias("text"))
    want = spark.createDataFrame([("catsa",), ("dog",), ("do",), ("catsa",), ("",), (None,)], "line string")
    out = containment.corpus_score(want, texts, "doc_id")
    assert tuple(out.head()) == (0.75, 3, 4, 2, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(raw") == 2, plan

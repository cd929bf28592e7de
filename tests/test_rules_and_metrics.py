"""Decision rules, scores, aggregates and order-dependent operators, with brute force for the latter."""

import json
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from lumenbox.functions import geometry as g
from lumenbox.functions import text
from lumenbox.operators import audit, datagen, inference, layout, metrics, planning, report, rules
from lumenbox.plans import adapters, suite
from lumenbox.sources import checkpoints, registry
from lumenbox.streaming import trials as streamed


def value(spark, c):
    return spark.range(1).select(c.alias("v")).head()["v"]


@pytest.mark.parametrize(
    ("answer", "want"),
    [("Yes", True), ("no.", False), ("Maybe", None), ("", None), ("yes and no", None), ("Incorrect", False), ("not correct", True), ("noé", None), (None, None)],
)
def test_yes_no(spark, answer, want):
    assert value(spark, text.parse_yes_no(F.lit(answer).cast("string"))) is want


def test_scores(spark):
    def score(a, b):
        return value(spark, metrics.score_one(g.make_box(*a), g.make_box(*b)))

    same = score((0, 0, 10, 10), (0, 0, 10, 10))
    assert (same["iou"], same["click_hit"], same["centre_error_px"]) == (1.0, True, 0.0)
    small = score((45, 45, 55, 55), (0, 0, 100, 100))
    assert small["click_hit"] and small["iou"] < 0.1
    assert not score((500, 500, 510, 510), (0, 0, 10, 10))["click_hit"]


TRIAL = "variant string, found boolean, click_hit boolean, iou double, centre_error_px double, latency_s double, box_kind string, confidence double"


def test_aggregates(spark):
    rows = [("a", True, True, 0.9, 1.0, 1.0, "tight", 0.95), ("a", True, True, 0.1, 2.0, 2.0, "region", 0.9), ("b", True, True, 0.5, 1.0, 1.0, "region", 0.3), ("b", False, None, None, None, 3.0, "tight", None)]
    out = {r["variant"]: r for r in metrics.aggregate_trials(spark.createDataFrame(rows, TRIAL), "variant").collect()}
    assert (out["a"]["iou_mean"], out["a"]["tight_iou_mean"], out["a"]["tight_n"]) == (0.5, 0.9, 1)
    assert (out["b"]["click_accuracy"], out["b"]["click_accuracy_when_found"], out["b"]["tight_iou_mean"]) == (0.5, 1.0, None)
    conf = metrics.confidence_analysis(spark.createDataFrame(rows, TRIAL).withColumn("click_hit", F.col("confidence") > 0.5)).orderBy("threshold").collect()
    assert [r["acted_on"] for r in conf] == [3, 2, 2, 2]
    assert conf[0]["precision"] < conf[1]["precision"] and conf[0]["coverage"] > conf[1]["coverage"]


def test_published_means(spark):
    coarse, fine = [0.58, 0.54, 0.71, 0.27, 0.47, 0.64], [0.91, 0.93, 0.88, 0.96, 0.89, 0.89]
    rows = [(v, True, True, x, 1.0, 1.0, "tight", None) for v, xs in (("coarse", coarse), ("refine", fine)) for x in xs]
    out = {r["variant"]: r for r in metrics.aggregate_trials(spark.createDataFrame(rows, TRIAL), "variant").collect()}
    assert out["coarse"]["iou_mean"] == pytest.approx(0.536, abs=2e-3) and out["refine"]["iou_mean"] == pytest.approx(0.911, abs=2e-3)
    assert out["coarse"]["iou_at_50"] == pytest.approx(0.6667) and out["refine"]["iou_at_75"] == 1.0


def test_ocr_score_of_bags_and_long_texts(spark):
    rng, alphabet = random.Random(3), ["", "a", "ab", "abc", "abcd", "bcde", "xabcdx", "bcd", "bcdef", "é" * 5, "a\nbcd", "zzzz"]
    rows = [([rng.choice(alphabet) for _ in range(rng.randint(0, 6))], [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    # every entry compared with every other, each side computed anew for it, would not end in time
    long = [f"word{k}" for k in range(20_000)]
    rows += [(long[9:], long + long[:5] + long[-5:]), (None, ["abcd"])]
    out = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, p array<string>, t array<string>").select("k", metrics.ocr_score(F.col("p"), F.col("t")).alias("s"))
    begun = time.monotonic()
    got = {r["k"]: (r["s"]["found"], r["s"]["expected"], r["s"]["read"], r["s"]["spurious"]) for r in out.collect()}
    assert time.monotonic() - begun < 60
    for k, (p, t) in enumerate(rows[:-2]):
        read, want = set(p) - {""}, [w for w in t if w]
        found = sum(any(x == w or len(w) > 3 and w in x for x in read) for w in want)
        assert got[k] == (found, len(want), len(read), max(0, len(read) - found))
    # word0 to word8 are within word10 and so on, but word0 is not: no number begins with 0
    assert got[60] == (20_010 - 2, 20_010, 19_991, 17 - 17) and got[61] == (0, 1, None, 0)


def test_ocr_score(spark):
    s = value(spark, metrics.ocr_score(F.array(F.lit("hello"), F.lit("worldwide")), F.array(F.lit("hello"), F.lit("world"), F.lit("none"))))
    assert (s["recall"], s["found"], s["spurious"]) == (0.6667, 2, 0)


def test_reading_order_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(s, k, rng.randrange(200), rng.randrange(120), rng.randrange(0, 40), rng.randrange(0, 30)) for s in range(30) for k in range(25)]
    df = spark.createDataFrame(rows, "screen_id long, ord long, x int, y int, w int, h int").withColumn("box", g.make_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    got = {(r["screen_id"], r["ord"]): r["position"] for r in layout.reading_order(df).collect()}
    for s in range(30):
        items = [r for r in rows if r[0] == s]
        tolerance = 0.5 * sorted(max(1, r[5]) for r in items)[len(items) // 2]
        lines = []
        for r in sorted(items, key=lambda r: r[3] + r[5] / 2):
            middle = r[3] + r[5] / 2
            if lines and abs(middle - lines[-1][0]) <= tolerance:
                lines[-1][1].append(r)
            else:
                lines.append((middle, [r]))
        order = [r[1] for _, line in lines for r in sorted(line, key=lambda r: r[2])]
        assert [k for k, _ in sorted(((r[1], got[s, r[1]]) for r in items), key=lambda t: t[1])] == order


def test_dedupe_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(s, k, rng.randrange(60), rng.randrange(40), rng.randrange(5, 40), rng.randrange(5, 30), rng.choice(["", "a", "bb", "ccc"])) for s in range(30) for k in range(25)]
    df = spark.createDataFrame(rows, "screen_id long, ord long, x int, y int, w int, h int, text string").withColumn("box", g.make_box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    got = {(r["screen_id"], r["ord"]) for r in layout.dedupe_text(df).collect()}

    def overlap(a, b):
        wide = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        high = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        return wide * high / (a[4] * a[5] + b[4] * b[5] - wide * high)

    want = set()
    for s in range(30):
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: -len(r[6])):
            if not any(overlap(r, k) > 0.6 or (r[6] and r[6] == k[6] and overlap(r, k) > 0.2) for k in kept):
                kept.append(r)
        want |= {(s, r[1]) for r in kept}
    assert got == want


def test_best_tile(spark):
    rng = random.Random(3)
    rows = [(s, k, rng.choice([None, 0.0, 0.0, 0.3, 0.8])) for s in range(60) for k in range(4)]
    got = {r["screen_id"]: r["pos"] for r in rules.best_tile(spark.createDataFrame(rows, "screen_id long, pos long, confidence double"), ["screen_id"]).collect()}
    for s in range(60):
        best = None
        for _, k, c in (r for r in rows if r[0] == s):
            if best is None or (-1.0 if c is None else c) > (best[1] or -1.0):
                best = (k, c)
        assert got[s] == best[0]


def blob(header):
    body = json.dumps(header).encode()
    return struct.pack("<Q", len(body)) + body


def test_headers_and_audit(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.safetensors").write_bytes(blob({"__metadata__": {"format": "pt"}, "model.layers.0": {"dtype": "BF16", "shape": [10, 20]}, "visual.merger.x": {"dtype": "BF16", "shape": [3]}, "scalar": {"dtype": "F32", "shape": []}}))
    (folder / "b.safetensors").write_bytes(blob({"model.layers.0": {"dtype": "F32", "shape": [99]}, "odd": {"dtype": "F32", "shape": [5]}}))
    (folder / "config.json").write_text('{"text_config": {"tie_word_embeddings": true}}')
    r = audit.audit(audit.tensors(checkpoints.local_headers(spark, str(tmp_path)))).head()
    assert (r["model"], r["total"], r["within_budget"]) == ("m", 208, True)
    assert r["components"] == {"language backbone": 200, "other": 5, "vision-language projector": 3}
    tied = checkpoints.local_configs(spark, str(tmp_path)).select(audit.tied_flag(F.col("config")).alias("t")).head()["t"]
    assert tied is True
    assert len(value(spark, audit.notes(F.lit(True), F.lit(False), F.create_map(F.lit("other"), F.lit(5))))) == 3
    for bad in (b"123", struct.pack("<Q", 10**9) + b"{}"):
        with pytest.raises(Exception, match="header"):
            spark.createDataFrame([(bytearray(bad),)], "content binary").select(audit.parse_header(F.col("content"))).collect()
    assert value(spark, audit.header_length(F.lit(bytearray(b"\xc3\xa9\x01\0\0\0\0\0")))) == 108995


@pytest.mark.parametrize(("name", "want"), [("visual.blocks.1", "vision encoder"), ("visual.merger.mlp", "vision-language projector"), ("model.embed_tokens", "token embeddings"), ("model.layers.3", "language backbone"), ("lm_head.weight", "output head"), ("x", "other"), ("language_model.embed_tokens", "token embeddings")])
def test_classify(spark, name, want):
    assert value(spark, audit.classify(F.lit(name))) == want


def test_budget_boundary(spark):
    v = value(spark, audit.verify_runtime(F.lit(3_750_000_000), F.lit(3_000_000_000)))
    assert v["agrees"] is False and v["delta"] < 0
    out = audit.audit_pipeline(spark.createDataFrame([(2_774_773_760,), (631_975_680,), (311_164_928,), (36_708_608,)], "total long")).head()
    assert (out["path_total_parameters"], out["headroom"], out["within_budget"]) == (3_754_622_976, 2_245_377_024, True)
    assert audit.audit_pipeline(spark.createDataFrame([(6_000_000_000,)], "total long")).head()["within_budget"]
    assert not audit.audit_pipeline(spark.createDataFrame([(6_000_000_001,)], "total long")).head()["within_budget"]


def test_screens(spark):
    built = datagen.screens(spark, 6)
    rows = built.collect()
    assert [r["scale"] for r in sorted(rows, key=lambda r: r["id"])] == [1.0, 0.75, 0.55] * 2
    assert rows == datagen.screens(spark, 6).collect()
    for r in rows:
        names = [e["descriptor"] for e in r["ground_truth"]]
        assert len(names) == len(set(names))
        for e in r["all_elements"]:
            assert -1 <= e["box"]["x1"] < e["box"]["x2"] <= 1280 and 0 <= e["box"]["y1"] < e["box"]["y2"] <= 800
    assert planning.unique_targets(datagen.elements(built, "all_elements")).count() == sum(len(r["ground_truth"]) for r in rows)


def test_registry(spark):
    found = registry.lookup(spark.createDataFrame([("qwen2-vl-2b",), ("Qwen/Qwen2-VL-2B-Instruct",)], "model string")).collect()
    assert [r["spec"]["key"] for r in found] == ["qwen2-vl-2b"] * 2
    with pytest.raises(Exception, match="unknown model"):
        registry.lookup(spark.createDataFrame([("x",)], "model string")).collect()


def test_ground_with_replay(spark, tmp_path):
    n = iter(range(100))

    def save(df):
        path = str(tmp_path / f"t{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    requests = spark.createDataFrame([(1, 1260, 784, "Save", "abs"), (2, 1260, 784, "Gone", "abs")], "screen_id long, w int, h int, target string, mode string")
    said = [
        (1, 'Locate "Save" in this screenshot.', '[{"bbox_2d": [100, 100, 140, 120], "label": "save"}]'),
        (1, 'Locate "Save" in this enlarged part of a screenshot.', '[{"bbox_2d": [300, 300, 400, 360], "label": ""}]'),
        (1, 'Is this "Save"? Answer Yes or No.', "Yes"),
        (2, 'Locate "Gone" in this screenshot.', "It is not there."),
    ]
    recorded = spark.createDataFrame([(*r, 1, 1, 0.5) for r in said], "screen_id long, prompt string, answer string, prompt_tokens long, new_tokens long, latency_s double")
    out = inference.ground(requests, inference.replay_backend(recorded), save).collect()
    assert len(out) == 1 and out[0]["confidence"] == 1.0 and out[0]["refined"] and out[0]["label"] == "save"
    plain = inference.ground(requests, inference.replay_backend(recorded), save, refine=False, verify=False).collect()
    assert len(plain) == 1 and plain[0]["confidence"] is None and plain[0]["box"]["x1"] == 100.0
    with pytest.raises(KeyError):
        inference.choose_backend("auto", {})


def test_report(spark):
    page = value(spark, report.report_html(F.lit("T<1>"), report.subtitle(F.lit(""), F.lit("a & b"), F.lit("")), report.meta_cells({"n": F.lit(3), "none": F.lit(None)}), F.lit("<tr></tr>"), F.lit("{}")))
    assert "T&lt;1&gt;" in page and "a &amp; b" in page and "none" not in page
    df = spark.createDataFrame([(1, "x")], "a int, _image string")
    assert report.strip_private(df).columns == ["a"]


def test_stream_of_trials(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 'a' AS variant, true AS found, cast(null AS double) AS confidence UNION ALL SELECT timestamp'2024-01-01 00:01:00', 'a', true, 0.1D").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, variant string, found boolean, confidence double").parquet(src)
    q = streamed.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    r = spark.sql("SELECT n, n_found, n_accepted FROM counts").head()
    assert tuple(r) == (2, 2, 1)


def test_whole_screens_enter_best_tile_and_ocr_task(spark):
    sf = "/root/testdata/sf0.001"
    rows = adapters.trials(spark, sf).select("screen_id", "ord", "confidence").collect()
    best = {}
    for s, k, c in sorted(rows, key=lambda r: (r[0], r[1], -9.0 if r[2] is None else r[2])):
        if s not in best or (-1.0 if c is None else c) > (best[s][1] or -1.0):
            best[s] = (k, c)
    got = {r["screen_id"]: (r["pos"], r["confidence"]) for r in suite.QUERIES["w04_best_tile"](spark, sf).collect()}
    assert got == best
    # of equal lines that overlap one stays, so each text that was read on a screen is told
    said = adapters.answers(spark, sf).select("screen_id", text.clean_line(F.col("text"), F.col("text")).alias("text")).where(F.length("text") > 0)
    told = {(r["screen_id"], r["text"]) for r in suite.QUERIES["u07_ocr_task"](spark, sf).collect()}
    whole = {(r["screen_id"], r["text"]) for r in said.distinct().collect()}
    assert len(told & whole) > 0.9 * len(whole)

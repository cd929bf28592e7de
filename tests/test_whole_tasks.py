"""Tasks of several model calls from start to end, and their commands, over recorded answers."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenbox import cli
from lumenbox.operators import inference, metrics, report, tasks

RECORDED = "screen_id long, prompt string, answer string, prompt_tokens long, new_tokens long, latency_s double"
SCREEN = "screen_id long, w int, h int, mode string"


def recorded(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 0.5) for r in rows], RECORDED)


def boxes(*items):
    return json.dumps([{"bbox_2d": b, "label": n} for b, n in items])


@pytest.fixture
def save(spark, tmp_path):
    return cli.saver(spark, str(tmp_path / "steps"))


def run(spark, tmp_path, verb, requests, said, *more):
    requests.write.mode("overwrite").parquet(str(tmp_path / "requests"))
    recorded(spark, said).write.mode("overwrite").parquet(str(tmp_path / "answers"))
    return cli.main([verb, "--requests", str(tmp_path / "requests"), "--answers", str(tmp_path / "answers"), "--out", str(tmp_path / "out"), *more], spark)


def test_find_all(spark, tmp_path):
    asked = spark.createDataFrame([(1, 1260, 784, "row", "abs"), (1, 1260, 784, "none", "abs")], "screen_id long, w int, h int, target string, mode string")
    said = [(1, 'Locate every "row" in this screenshot, as a JSON list.', boxes(([10, 300, 90, 320], "c"), ([200, 12, 280, 30], "b"), ([10, 10, 90, 30], "a"), ([0, 0, 0, 0], "flat")))]
    assert run(spark, tmp_path, "find", asked, said, "--all") == 0
    rows = spark.read.json(str(tmp_path / "out/hits")).orderBy("position").collect()
    assert [(r["label"], r["target"], r["position"]) for r in rows] == [("a", "row", 0), ("b", "row", 1), ("c", "row", 2)]
    assert run(spark, tmp_path, "find", asked.where("target = 'none'"), said, "--all") == 1


def test_guide(spark, tmp_path, save):
    plan = json.dumps([{"instruction": "Open", "target": "Save"}, {"instruction": "Wait", "target": "none"}, {"instruction": "Look", "target": "Gone"}])
    said = [
        (1, 'List the steps to "finish", as a JSON list with the element of each.', plan),
        (1, 'Locate "Save" in this screenshot.', boxes(([100, 100, 140, 120], "save"))),
        (1, 'Is this "Save"? Answer Yes or No.', "Yes"),
        (1, 'Locate "Gone" in this screenshot.', "not there"),
    ]
    screens = spark.createDataFrame([(1, 1260, 784, "abs", "finish")], SCREEN + ", goal string")
    steps = tasks.guide(screens, inference.replay_backend(recorded(spark, said)), save)
    assert [(r["n"], r["instruction"], r["resolved"], r["hit"] is not None) for r in steps.orderBy("n").collect()] == [(1, "Open", True, True), (2, "Wait", None, False), (3, "Look", False, False)]
    assert tuple(inference.guide_counts(steps).head()) == (1, 1, 2)


def test_redact(spark, tmp_path):
    said = [
        (1, "Locate all email addresses, phone numbers, personal names of individuals in this screenshot, as a JSON list with the kind of each.", boxes(([100, 100, 140, 120], " Email "), ([300, 300, 380, 320], ""))),
        (1, 'Is this " Email "? Answer Yes or No.', "No"),
    ]
    assert run(spark, tmp_path, "redact", spark.createDataFrame([(1, 1260, 784, "abs")], SCREEN), said) == 0
    rows = {r["kind"]: r for r in spark.read.json(str(tmp_path / "out/redact")).collect()}
    assert set(rows) == {"email", "unknown"} and not rows["email"]["kept"] and rows["unknown"]["kept"]
    assert rows["email"]["box"]["x1"] == 97.0 and rows["email"]["mask"]["strength"] == 6


def test_ocr_and_diff(spark, tmp_path):
    said = [(1, inference.READ_PROMPT, json.dumps([{"bbox_2d": [10, 10, 90, 30], "text": " line "}])), (2, inference.DIFF_PROMPT, boxes(([10, 10, 50, 50], "gone"), ([900, 10, 950, 50], "new")))]
    assert run(spark, tmp_path, "ocr", spark.createDataFrame([(1, 800, 600, "abs")], SCREEN), said) == 0
    rows = spark.read.json(str(tmp_path / "out/ocr")).orderBy("position").collect()
    assert [r["text"] for r in rows] == ["line"] * 4  # the same lines of four tiles, at different places
    pairs = spark.createDataFrame([(2, 600, 400, 600, 400, "abs")], "screen_id long, before_w int, before_h int, after_w int, after_h int, mode string")
    assert run(spark, tmp_path, "diff", pairs, said) == 0
    changes = {r["description"]: r for r in spark.read.json(str(tmp_path / "out/diff")).collect()}
    assert changes["gone"]["side"] == "left" and changes["new"]["side"] == "right" and changes["new"]["box"]["x2"] <= 600


def test_bench_tables_and_kinds_of_items(spark, tmp_path):
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in (("x1", 100), ("y1", 100), ("x2", 140), ("y2", 120))])
    targets = spark.createDataFrame([(1, 1260, 784, "Save", "abs"), (2, 1260, 784, "Gone", "abs")], "screen_id long, w int, h int, target string, mode string")
    targets = targets.withColumns({"true_box": box, "scale": F.lit(1.0), "role": F.when(F.col("screen_id") == 1, "button").otherwise("menu"), "latency_s": F.lit(0.5)})
    targets = targets.withColumn("box_kind", F.when(F.col("role") == "button", "tight").otherwise("region"))
    said = [(1, 'Locate "Save" in this screenshot.', boxes(([100, 100, 140, 120], "save"))), (1, 'Is this "Save"? Answer Yes or No.', "Yes")]
    assert run(spark, tmp_path, "bench", targets, said) == 0
    read = {n: spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / f"out/{n}")).collect() for n in ("overall", "by_box_kind", "by_role")}
    assert len(read["overall"]) == 4 and {r["click_accuracy"] for r in read["overall"]} == {0.5}
    kinds = {(r["variant"], r["group"]): r for r in read["by_box_kind"]}
    assert kinds["coarse", "tight"]["tight_iou_mean"] == 1.0 and kinds["coarse", "region"]["tight_iou_mean"] != kinds["coarse", "region"]["tight_iou_mean"]
    assert {r["group"] for r in read["by_role"]} == {"button", "menu"}
    names = ("find", "ocr", "diff", "redact", "guide")
    rows = spark.createDataFrame([(t,) for t in (*names, "ask")], "task string").select("task", report.items_of(F.col("task"), *[F.array(F.lit(n)) for n in names]).alias("items"))
    assert {r["task"]: r["items"] for r in rows.collect()} == {n: [n] for n in names} | {"ask": None}
    page = report.gallery(spark.createDataFrame([(2, "B<", "x" * 3000), (1, "A", "{}")], "pos int, title string, json string")).head()["html"]
    assert page.index("A") < page.index("B&lt;") and page.count("x") == 2600


def test_batch_backend(spark):
    """The loader runs once in each worker, and batches keep their rows."""

    def load():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"answer": "said " + batch["prompt"], "prompt_tokens": batch["prompt"].str.len(), "new_tokens": 2, "latency_s": 0.25}, index=batch.index)

        return model

    asked = spark.createDataFrame([(k, f"p{k}") for k in range(20)], "screen_id long, prompt string").repartition(3)
    rows = inference.batch_backend(load)(asked).collect()
    assert {(r["screen_id"], r["answer"], r["prompt_tokens"]) for r in rows} == {(k, f"said p{k}", len(f"p{k}")) for k in range(20)}
    assert inference.batch_backend(load)(asked.where("false")).count() == 0


def test_observed_calls_equal_the_log(spark, tmp_path):
    """Totals that come to the driver while calls are made are those of the saved answers."""
    place = boxes(([100, 100, 140, 120], "save"))

    def load():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            answer = ["Yes" if p.startswith("Is this") else place for p in batch["prompt"]]
            return pd.DataFrame({"answer": answer, "prompt_tokens": batch["prompt"].str.len(), "new_tokens": 3, "latency_s": 0.25}, index=batch.index)

        return model

    kept = []

    def save(df):
        path = str(tmp_path / f"t{len(kept)}")
        df.write.parquet(path)
        kept.append(spark.read.parquet(path))
        return kept[-1]

    asked = spark.createDataFrame([(k, 1260, 784, f"Save {k % 3}", "abs") for k in range(7)], "screen_id long, w int, h int, target string, mode string")
    backend = inference.Measured(inference.batch_backend(load, memory=True))
    out = save(inference.ground(asked, backend, save))
    assert out.where("confidence = 1").count() == 7
    totals = backend.totals()
    saved = [df for df in kept if "answer" in df.columns]
    logged = [metrics.call_stats(df).head() for df in saved]
    verified = out.count()  # the last calls' answers are read off at once, one for each hit
    assert totals["calls"] == sum(r["calls"] for r in logged) + verified == 21
    assert totals["new_tokens"] == 63 and totals["latency_s"] == 5.25 and totals["max_call_s"] == 0.25 and totals["decode_tokens_per_s"] == 12.0
    assert totals["rss_peak_bytes"] > 10_000_000
    none = inference.Measured(inference.batch_backend(load))
    save(none(asked.where("false").withColumn("prompt", F.lit("x"))))
    assert (none.totals()["calls"], none.totals()["mean_call_s"], none.totals()["decode_tokens_per_s"]) == (0, None, 0.0)

"""Tasks end to end over recorded answers, the commands and their exit codes."""

import json
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lumenbox import cli
from lumenbox.functions import geometry as g
from lumenbox.functions import parsing, pictures
from lumenbox.operators import inference, report, rules, tasks
from lumenbox.sources import checkpoints

REQUEST = "screen_id long, w int, h int, target string, mode string"
RECORDED = "screen_id long, prompt string, answer string, prompt_tokens long, new_tokens long, latency_s double"


def recorded(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 0.5) for r in rows], RECORDED)


def box(*v):
    return json.dumps([{"bbox_2d": v, "label": "x"}])


SAID = [
    (1, 'Locate "Save" in this screenshot.', box(100, 100, 140, 120)),
    (1, 'Locate "Save" in this enlarged part of a screenshot.', "none"),
    (1, 'Is this "Save"? Answer Yes or No.', "Yes"),
    (2, 'Locate "Gone" in this screenshot.', "It is not there."),
    (2, 'Locate "Gone" in this enlarged part of a screenshot.', "nor here"),
    (3, 'Locate "Tiny" in this screenshot.', "nothing"),
    (3, 'Locate "Tiny" in this enlarged part of a screenshot.', box(300, 300, 360, 330)),
    (3, 'Is this "Tiny"? Answer Yes or No.', "Yes"),
    (4, 'Locate "Odd" in this screenshot.', box(10, 10, 60, 40)),
    (4, 'Locate "Odd" in this enlarged part of a screenshot.', box(300, 300, 360, 330)),
    (4, 'Is this "Odd"? Answer Yes or No.', "No"),
]
ASKED = [(1, 1260, 784, "Save", "abs"), (2, 1260, 784, "Gone", "abs"), (3, 1260, 784, "Tiny", "abs"), (4, 1260, 784, "Odd", "abs")]


@pytest.fixture
def save(spark, tmp_path):
    return cli.saver(spark, str(tmp_path / "steps"))


def test_find(spark, save):
    requests, backend = spark.createDataFrame(ASKED, REQUEST), inference.replay_backend(recorded(spark, SAID))
    got = {r["screen_id"]: r for r in tasks.find(requests, backend, save).collect()}
    assert [(got[k]["found"], got[k]["accepted"], got[k]["count"]) for k in (1, 2, 3, 4)] == [(True, True, 1), (False, False, 0), (True, True, 1), (True, False, 1)]
    assert (got[1]["stage"], got[3]["stage"]) == ("coarse", "tile[0,0]") and got[3]["hit"]["confidence"] == 1.0
    assert got[4]["tiled"] is False  # a tile's hit of the same confidence does not replace the first
    tile = tasks.tiles(requests.where("screen_id = 3"), 2, 2, tasks.SEARCH_OVERLAP).where("r = 0 AND c = 0").select("view.*", "region").head()
    assert got[3]["hit"]["box"]["x1"] == pytest.approx(300 * tile["tf"]["sx"], abs=0.05)
    told = {k: [(t["stage"], t["box"] is not None, t["region"] is not None, t["confidence"]) for t in got[k]["trace"] or ()] for k in got}
    assert told[1] == [("coarse", True, False, None), ("zoom", False, True, None), ("verify", True, True, 1.0)] and told[2] == []
    assert told[3] == [("tile[0,0]", True, False, 1.0)] and [t[0] for t in told[4]] == ["coarse", "zoom", "verify"] and told[4][-1][-1] == 0.0
    plain = tasks.find(requests, backend, save, fallback_tiles=False)
    assert plain.where("found").count() == 2


def test_bench_and_payload(spark, save):
    targets = spark.createDataFrame(ASKED, REQUEST).withColumn("true_box", F.struct(*[F.lit(float(v)).alias(k) for k, v in (("x1", 100), ("y1", 100), ("x2", 140), ("y2", 120))]))
    targets = targets.withColumns({"scale": F.lit(1.0), "role": F.lit("button"), "box_kind": F.lit("tight"), "latency_s": F.lit(0.5)})
    trials = save(tasks.bench(targets, inference.replay_backend(recorded(spark, SAID)), save))
    rows = {(r["variant"], r["screen_id"]): r for r in trials.collect()}
    assert len(rows) == 16 and rows["coarse", 1]["iou"] == 1.0 and rows["coarse", 2]["iou"] is None and not rows["coarse", 2]["found"]
    out = {r["variant"]: r for r in tasks.bench_payload(trials).collect()}
    assert out["coarse"]["summary"]["overall"]["n"] == 4 and out["coarse"]["summary"]["by_role"]["button"]["found_rate"] == 0.5
    assert out["coarse"]["confidence"] is None and out["coarse+verify"]["confidence"][0]["acted_on"] == 2
    long = report.summary_tables(tasks.bench_payload(trials).select("variant", "summary.*"), "by_box_kind").collect()
    assert {r["group"] for r in long} == {"tight"}


def test_distractors(spark, save):
    absent = spark.createDataFrame(ASKED, REQUEST)
    got = {r["screen_id"]: (r["returned_box"], r["would_act"]) for r in tasks.distractors(absent, inference.replay_backend(recorded(spark, SAID)), save).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, False)}


def test_describe_ask_and_tiled_reading(spark):
    said = recorded(spark, [(1, "Describe this screenshot as JSON.", '{"app": "Mail"}'), (2, "Describe this screenshot as JSON.", "A page."), (1, "Why?", "Because.")])
    screens = spark.createDataFrame([(1, 800, 600), (2, 800, 600)], "screen_id long, w int, h int")
    out = {r["screen_id"]: json.loads(r["result"]) for r in tasks.describe(screens, inference.replay_backend(said)).collect()}
    assert out[1] == {"app": "Mail"} and out[2]["summary"] == "A page." and out[2]["app"] == "unknown"
    assert tasks.ask(screens.where("screen_id = 1").withColumn("question", F.lit("Why?")), inference.replay_backend(said)).head()["answer"] == "Because."
    cut = tasks.tiles(screens.where("screen_id = 1"), 2, 2, tasks.READ_OVERLAP).withColumn("mode", F.lit("abs"))
    lines = cut.withColumn("answer", F.lit(json.dumps([{"bbox_2d": [10, 10, 90, 30], "text": "line"}])))
    read = tasks.read_tiles(lines).collect()
    assert [r["text"] for r in read] == ["line"] * 4 and [r["position"] for r in read if r["box"]["x1"] < 100 and r["box"]["y1"] < 100] == [0]


def header(n):
    body = json.dumps({"model.layers.0": {"dtype": "F16", "shape": [n, 1000]}}).encode()
    return struct.pack("<Q", len(body)) + body


def test_commands(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.createDataFrame(ASKED, REQUEST).write.parquet(f"{out}/requests")
    recorded(spark, SAID).write.parquet(f"{out}/answers")
    options = ["--requests", f"{out}/requests", "--answers", f"{out}/answers", "--out", out]
    assert cli.main(["find", *options], spark) == 0
    assert spark.read.json(f"{out}/hits").count() == 4
    spark.createDataFrame(ASKED[1:2], REQUEST).write.mode("overwrite").parquet(f"{out}/requests")
    assert cli.main(["find", *options, "--no-tiles"], spark) == 1
    assert cli.main(["gen-data", "--out", out, "--n", "3"], spark) == 0
    assert spark.read.json(f"{out}/ground_truth").count() == 3
    drawn = [pictures.decode_png(open(f"{out}/screens/screen_00{k}.png", "rb").read()) for k in range(3)]
    assert {d.shape for d in drawn} == {(800, 1280, 3)} and all((d != 255).any() for d in drawn)
    for name, n, code in (("small", 1000, 0), ("large", 7_000_000, 1)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.safetensors").write_bytes(header(n))
        assert cli.main(["budget", "--root", str(tmp_path / name)], spark) == code
    assert cli.main(["hardware"], spark) == 0


def test_sources(spark, tmp_path):
    failures = []

    class Shard(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/index":
                body = json.dumps({"siblings": [{"rfilename": n} for n in ("1.safetensors", "config.json", "readme.md", "2.safetensors")]}).encode()
            else:
                body = b'{"tie_word_embeddings": true}' if "config" in self.path else header(int(self.path[-13])) + b"x" * 1000
            if len(failures) < 2 and self.path != "/index":  # the first reads of files fail
                failures.append(self.path)
                self.send_response(503)
                self.end_headers()
                return
            asked = self.headers.get("Range")
            if asked and "2.safe" not in self.path:  # one file's server knows no ranges
                low, high = map(int, asked.removeprefix("bytes=").split("-"))
                self.send_response(206)
                body = body[low : high + 1]
            else:
                self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Shard)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    found = checkpoints.checkpoint(spark, index=f"{base}/index", files=f"{base}/files", model="m").persist()
    rows = found.where("kind = 'header'").collect()
    assert {(r["model"], r["file"], bytes(r["content"])) for r in rows} == {("m", f"{k}.safetensors", header(k)) for k in (1, 2)}
    assert [tuple(r) for r in checkpoints.configs(found).collect()] == [("m", '{"tie_word_embeddings": true}')] and len(failures) == 2
    named = checkpoints.checkpoint(spark, urls=f"{base}/1.safetensors", model="n").collect()
    server.shutdown()
    assert [(r["model"], bytes(r["content"])) for r in named] == [("n", header(1))]
    with pytest.raises(ValueError, match="live screen"):
        checkpoints.load(spark, "-")
    for k in (1, 2):
        (tmp_path / f"bench-{k}.json").write_text(json.dumps({"model": f"m{k}"}))
    assert [r["model"] for r in checkpoints.latest_bench(spark, str(tmp_path)).collect()] == ["m2"]
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    (tmp_path / "p.png").write_bytes(png)
    r = checkpoints.load(spark, str(tmp_path / "p.png")).head()
    assert (r["w"], r["h"]) == (640, 480)


def test_headers_of_a_large_file_are_all_that_is_read(spark, tmp_path, monkeypatch):
    (tmp_path / "m").mkdir()
    with open(tmp_path / "m" / "a.safetensors", "wb") as f:
        f.write(header(5))
        f.truncate(1 << 30)  # a sparse file of 1 GB
    (tmp_path / "m" / "b.safetensors").write_bytes(b"\xff" * 9)  # a length that is not believed
    (tmp_path / "m" / "config.json").write_text("{broken")
    reader, read = checkpoints._CheckpointReader({"path": str(tmp_path)}), []
    whole = reader.bytes_at
    monkeypatch.setattr(reader, "bytes_at", lambda *a: read.append(whole(*a)) or read[-1])
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[0], r[1], r[2]) for r in rows] == [("m", "a.safetensors", "header"), ("m", "b.safetensors", "header"), ("m", "config.json", "config")]
    assert rows[0][3] == header(5) and rows[1][3] == b"\xff" * 8 and sum(map(len, read)) < 10_000
    assert {bytes(r["content"]) for r in checkpoints.local_headers(spark, str(tmp_path)).collect()} == {header(5), b"\xff" * 8}
    assert [r["config"] for r in checkpoints.local_configs(spark, str(tmp_path)).collect()] == ["{}"]
    (tmp_path / "none").mkdir()
    assert checkpoints.local_headers(spark, str(tmp_path / "none")).count() == 0


def test_answers_are_parsed_once(spark):
    """A filter inferred for an exploded column, or a join of a frame with itself, would read each answer again."""
    answer = '[{"bbox_2d": [1, 2, 30, 40], "label": "a"}, {"bbox_2d": [50, 2, 90, 40], "label": "b"}]'
    view = F.struct(F.lit(180).alias("w"), F.lit(160).alias("h"), g.make_transform(0, 0, 1, 1).alias("tf"))
    told = spark.range(3).select(F.col("id").alias("screen_id"), F.lit(answer).alias("answer"), view.alias("view"), F.lit("abs").alias("mode"), F.lit(80).alias("before_w"), F.lit(80).alias("after_w"), F.lit(160).alias("after_h"))
    told = spark.createDataFrame(told.collect(), told.schema)
    items = told.withColumn("items", parsing.parse_boxes("answer")).select("*", "view.*")
    for out in (inference.boxes_on(told), rules.on_view(items), inference.ground_all(told), inference.ocr(told), inference.diff(told)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert out.count() == 6

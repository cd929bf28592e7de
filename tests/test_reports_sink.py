"""Files of a report are all there or none of them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbox.functions import pictures
from lumenbox.sources import reports


def tree(path):
    return {os.path.relpath(os.path.join(d, n), path): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(path) for n in names}


def test_fan_out_of_one_result(spark, tmp_path):
    png = bytearray(pictures.encode_png(np.zeros((2, 3, 3), np.uint8)))
    rows = spark.createDataFrame([(1, "a", png), (2, "b", None), (3, "c", png)], "screen_id long, label string, picture binary").repartition(3)
    files = reports.files_of(rows, F.concat(F.lit("s/"), F.col("screen_id").cast("string")), {".json": F.to_json(F.struct("screen_id", "label")), ".html": F.concat(F.lit("<p>"), "label"), ".png": F.col("picture")})
    out = str(tmp_path / "out")
    reports.write_files(files, out)
    found = tree(out)
    assert set(found) == {f"s/{k}.{e}" for k in (1, 2, 3) for e in ("json", "html", "png")} - {"s/2.png"}
    assert found["s/2.html"] == b"<p>b" and found["s/1.json"] == b'{"screen_id":1,"label":"a"}' and found["s/3.png"] == bytes(png)
    with pytest.raises(Exception, match="exists"):
        reports.write_files(files, out)
    reports.write_files(files.where("name = 's/1.json'"), out, overwrite=True)
    assert set(tree(out)) == {"s/1.json"} and os.listdir(tmp_path) == ["out"]
    reports.write_files(files.where("false"), str(tmp_path / "none"))
    assert tree(tmp_path / "none") == {}


def test_a_task_that_dies_leaves_no_half_report(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        reports.write_files(rows, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []

    def dies(batches):
        for batch in batches:
            if (batch["id"] == 39).any():
                os._exit(1)  # as where an executor is lost
            yield batch.assign(name="f" + batch["id"].astype(str), content=b"x")[["name", "content"]]

    with pytest.raises(Exception):
        reports.write_files(spark.range(0, 40, 1, 4).mapInPandas(dies, "name string, content binary"), str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
    repeated = spark.sql("SELECT 'a' AS name, X'00' AS content UNION ALL SELECT 'a', X'01'")
    with pytest.raises(Exception, match="two files"):
        reports.write_files(repeated, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []

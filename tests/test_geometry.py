"""Cases of the box algebra."""

import pytest
from pyspark.sql import functions as F

from lumenbox.functions import geometry as g


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()
    return row[0] if len(columns) == 1 else row


def box(*v):
    return g.make_box(*v)


def tup(r):
    return tuple(r[k] for k in ("x1", "y1", "x2", "y2"))


def test_crop_keeps_the_way_home(spark):
    c = g.crop(box(400, 300, 700, 500), F.lit(1280), F.lit(800), F.lit(None).cast(g.TRANSFORM))
    assert tup(one(spark, b=g.to_original(c["tf"], box(0, 0, 10, 10)))) == (400, 300, 410, 310)
    outer = g.crop(box(200, 100, 800, 600), F.lit(1280), F.lit(800), F.lit(None).cast(g.TRANSFORM))
    inner = g.crop(box(50, 50, 150, 150), outer["w"], outer["h"], outer["tf"])
    assert tup(one(spark, b=g.to_original(inner["tf"], box(0, 0, 10, 10)))) == (250, 150, 260, 160)


def test_crop_and_upscale_map_back(spark):
    c = g.crop(box(900, 60, 1060, 104), F.lit(1280), F.lit(800), F.lit(None).cast(g.TRANSFORM))
    v = g.prepare(c["w"], c["h"], c["tf"], F.lit(28), F.lit(256 * 784), F.lit(1280 * 784), F.lit(1280 * 784))
    home = one(spark, b=g.to_original(v["tf"], box(0, 0, v["w"], v["h"])))
    assert tup(home) == pytest.approx((900, 60, 1060, 104), abs=1.5)


def test_fit_dims(spark):
    def fit(w, h, low=256 * 784, high=1280 * 784):
        r = one(spark, d=g.fit_dims(F.lit(w), F.lit(h), F.lit(28), F.lit(low), F.lit(high)))
        return r["w"], r["h"]

    assert fit(2560, 1600) == fit(3840, 2400) == fit(1280, 800) == (1260, 784)
    assert fit(160, 44, 1003520, 1003520) == (1932, 532)  # growing is not clamped again


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((0, 0, 1, 1), (5, 5, 6, 6), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, want):
    assert one(spark, v=g.iou(box(*a), box(*b))) == pytest.approx(want)


def test_clamp_modes_and_points(spark):
    assert tup(one(spark, b=g.clamp_box(box(50, 40, 10, 20), F.lit(100), F.lit(100)))) == (10, 20, 50, 40)
    assert tup(one(spark, b=g.model_to_pixels(box(0, 0, 500, 500), F.lit(800), F.lit(600), F.lit("rel1000")))) == (0, 0, 400, 300)
    assert one(spark, v=g.point_in(F.lit(10.0), F.lit(10.0), box(0, 0, 10, 10)))
    assert not one(spark, v=g.point_in(F.lit(10.1), F.lit(10.0), box(0, 0, 10, 10)))
    with pytest.raises(Exception, match="unknown coordinate mode"):
        one(spark, b=g.model_to_pixels(box(0, 0, 1, 1), F.lit(1), F.lit(1), F.lit("other")))
    assert tup(one(spark, b=g.pixels_to_model(box(0, 0, 1, 1), F.lit(10), F.lit(10), F.lit("other")))) == (0, 0, 100, 100)

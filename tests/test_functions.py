"""Column functions on literal rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import arrays, geometry, hashing, images, labels, strings, views


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_scene_names(spark):
    name = F.lit("street_traffic-paris-12-345-s1.wav")
    assert one(spark, strings.scene_in_name(name), strings.device_in_name(name), strings.segment_in_name(name)) == ("street_traffic", "S1", "345")
    scene = strings.scene_in_name(name)
    assert one(spark, strings.city_in_name(name, scene), strings.location_in_name(name, scene)) == ("paris", "12")
    assert one(spark, strings.recording_in_name(name, F.lit("345"))) == "street-traffic-paris-12"
    assert one(spark, strings.scene(F.lit("7"), F.lit("x.wav")), strings.scene(F.lit("Metro Station"), F.lit("x"))) == ("bus", "metro_station")
    assert one(spark, strings.device(F.lit(None).cast("string"), F.lit("x.wav"), F.lit("eval"))) == "unknown"
    with pytest.raises(Exception, match="no device"):
        one(spark, strings.device(F.lit(None).cast("string"), F.lit("x.wav"), F.lit("dev_test")))
    assert one(spark, strings.device_in_name(F.lit("a-b-c.wav"))) == "C"


def test_hashes_are_those_of_python(spark):
    for v in ("", "abc", "é"):
        assert one(spark, hashing.stable_hash(F.lit(v))) == int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "big") & (2**63 - 1) == hashing.stable_hash_of(v)
    digest = hashlib.sha256(b"x").digest()
    assert one(spark, *hashing.fingerprint(F.lit("x"))) == tuple(int.from_bytes(digest[i : i + 8], "big", signed=True) for i in range(0, 32, 8))
    assert one(spark, hashing.view_key(F.lit("{}"))) > 0
    assert hashing.canonical_json({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    with pytest.raises(ValueError):
        hashing.image_seed(1 << 33, F.lit(0))
    u = [r[0] for r in spark.range(2000).select(hashing.draw(3, F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03 and len(set(u)) == 2000


def test_labels(spark):
    assert one(spark, labels.one_hot(F.lit(1), 3, 0.3)) == pytest.approx([0.1, 0.8, 0.1])
    assert one(spark, labels.multi_hot(F.array(F.lit(0), F.lit(2)), 3)) == [1.0, 0.0, 1.0]
    e = F.array(F.struct(F.lit(0.6).alias("start"), F.lit(0.6).alias("end"), F.lit(1).alias("label")))
    assert one(spark, labels.event_frames(e, 2, 4, 0.5)) == [[0, 0], [0, 1], [0, 0], [0, 0]]
    assert one(spark, labels.blend(array([1, 0]), array([0, 1]), F.lit(0.3), either=True)) == [1.0, 1.0]
    with pytest.raises(ValueError):
        labels.transform_label(F.lit(1), "no such")


@pytest.mark.parametrize("how", ["zero", "repeat", "reflect"])
@pytest.mark.parametrize("side", ["right", "center"])
def test_padding_is_that_of_numpy(spark, how, side):
    x = np.arange(1.0, 6.0)
    before = 0 if side == "right" else 4
    want = np.pad(x, (before, 9 - before), mode={"zero": "constant", "repeat": "wrap", "reflect": "reflect"}[how])
    assert one(spark, views.padded(array(x), F.lit(14), how, side)) == want.tolist()


def test_views(spark):
    assert one(spark, views.sliding_starts(F.lit(10), F.lit(4), F.lit(4))) == [0, 4, 6]
    assert one(spark, views.spread_starts(F.lit(10), F.lit(4), 1)) == [3] and one(spark, views.spread_starts(F.lit(10), F.lit(4), 3)) == [0, 3, 6]
    with pytest.raises(ValueError):
        views.Views(1.0, train_mode="sliding").resolved(True)
    with pytest.raises(ValueError):
        views.Views(0)
    df = spark.createDataFrame([(i, [float(k) for k in range(10 + i)], 4) for i in range(5)], "id long, x array<double>, r int")
    a, b = (views.segment(df.repartition(k), views.Views(1.0), signal="x", rate="r", position="id", training=True, seed=1).orderBy("id").collect() for k in (1, 4))
    assert a == b and all(len(r["view"]) == 4 for r in a)
    full = views.segment(df, views.Views(1.0, policy="keep_1s"), signal="x", rate="r", position="id").collect()
    assert {len(r["view"]) for r in full} == set(range(10, 15))


def test_signal_columns(spark):
    x = np.array([0.5, -0.25, 1.0, 0.0])
    assert one(spark, arrays.leveled(array(x), "peak")) == pytest.approx((x / 1.0).tolist())
    assert one(spark, arrays.without_offset(array(x))) == pytest.approx((x - x.mean()).tolist())
    assert one(spark, arrays.smoothed(array(x), 0.5)) == pytest.approx([0.5, 0.125, 0.5625, 0.28125])
    assert one(spark, arrays.rolled(array(x), F.lit(1))) == [0.0, 0.5, -0.25, 1.0]
    assert one(spark, arrays.shifted(array(x), F.lit(9))) == [0.0] * 4
    assert one(spark, arrays.framed(array(range(5)), 3, 2)) == [[0, 1, 2], [2, 3, 4]] and one(spark, arrays.framed(array([1]), 3, 2)) == []
    assert one(spark, arrays.fir(array([0, 0, 1, 0, 0]), (0.1, 0.2, 0.4, 0.2, 0.1))) == pytest.approx([0.1, 0.2, 0.4, 0.2, 0.1])
    gone = one(spark, arrays.with_gaps(array([1] * 40), 4, 0.0, 3, F.lit(1)))
    assert gone.count(0.0) == 4
    for bad in (0, 6, True, 2.0):
        with pytest.raises(ValueError):
            arrays.by_severity(arrays.CLIP_THRESHOLDS, bad)
    assert one(spark, arrays.maybe(F.lit("x"), F.lit("y"), 0.0, 1, F.lit(1)), arrays.maybe(F.lit("x"), F.lit("y"), 1.0, 1, F.lit(1))) == ("x", "y")


def test_half_rounds_to_even(spark):
    assert one(spark, images.clip_round(F.lit(0.5)), images.clip_round(F.lit(1.5)), images.clip_round(F.lit(1.9), "cut"), images.clip_round(F.lit(300.0))) == (0, 2, 1, 255)


def test_strength_meets_the_rows(spark):
    for s, v in enumerate((1.0, *images.CONTRAST)):
        assert one(spark, images.at_strength(images.CONTRAST, F.lit(float(s)), neutral=1.0)) == pytest.approx(v)
    assert one(spark, images.at_strength((0.5, 0.25, 0.12, 0.06, 0.03), F.lit(1.5), "log", 1.0)) == pytest.approx((0.5 * 0.25) ** 0.5)


def test_sampled_geometry_keeps_its_own_rules(spark):
    g = geometry.Geometry(crop=64, resize_range=None, scale_range=(0.5, 2.0), patch=14)
    r = geometry.sample((F.col("id") % 90 + 10), (F.col("id") % 70 + 20), g, training=True, seed=5, position=F.col("id"))
    rows = spark.range(500).select(r.alias("r"))
    assert rows.filter(F.size(geometry.problems(F.col("r"))) > 0).count() == 0
    sizes = rows.select("r.model_input_size", "r.horizontal_flip").collect()
    assert {tuple(x[0]) for x in sizes} == {(70, 70)} and 0.4 < np.mean([x[1] for x in sizes]) < 0.6
    broken = rows.select(F.col("r").withField("patch_size", F.lit(13)).alias("r"))
    assert broken.filter(F.array_contains(geometry.problems(F.col("r")), "grid")).count() == 500
    for bad in ({"crop": 0}, {"scale_range": (1, 2)}, {"flip_probability": 2}, {"pad_mode": "x"}):
        with pytest.raises(ValueError):
            geometry.Geometry(**bad)


def test_colours(spark):
    assert one(spark, images.to_srgb(images.to_linear(F.lit(0.3)))) == pytest.approx(0.3)
    assert one(spark, *images.lab(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == pytest.approx((100, 0, 0), abs=0.02)
    assert one(spark, images.segment_number(F.lit(1), F.lit(2), F.lit(3))) == 1 + 512 + 196608

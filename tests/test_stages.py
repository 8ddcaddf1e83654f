"""Stages by name, and contracts of identities, masks and classes."""

from __future__ import annotations

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.kernels import images, signal
from tidemill.operators import contracts
from tidemill.operators.positions import POS, enumerate_rows
from tidemill.plans import pipeline, presets, stages

RATE = 16000


@pytest.fixture(scope="module")
def clips(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(RATE // 4 + 100 * i).astype(np.float32).tolist(), RATE, i % 3) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, waveform array<float>, sample_rate int, label int")
    return enumerate_rows(df, "id")


def tensor(row):
    return np.array(row["data"], np.float32).reshape(row["shape"])


def test_acoustic_pipeline_gives_the_frontends_features(clips):
    config = presets.Audio(RATE, 0.5, "logmel", signal.Stft(512, 400, 160, rate=RATE), signal.Mel(32))
    made = stages.acoustic_pipeline(config, label="one_hot", classes=3)
    got = {r["id"]: r for r in made.postprocess(made.preprocess(clips)).collect()}
    for r in clips.collect():
        x = signal.fit_length(np.array(r["waveform"], np.float32)[:, None], RATE // 2)
        want = signal.layout(signal.frontend(x, "logmel", config.stft, config.mel, config.log, config.norm), config.layout)
        assert np.allclose(tensor(got[r["id"]]["features"]), want, atol=1e-4)
        assert got[r["id"]]["label"][r["label"]] == 1 and want.shape[0] == config.frames()
    assert stages.output_key("raw_waveform") == "audio" and stages.output_key("mfcc") == "features" and stages.with_channel(np.zeros(3)).shape == (3, 1)
    with pytest.raises(KeyError):
        stages.acoustic_pipeline("no such preset")


def test_acoustic_training_is_seeded_and_mixes_within_batches(clips):
    made = stages.acoustic_pipeline("audio_default_16k_waveform", waveform=["random_gain", "polarity_inversion"], batch=stages.AudioMixup(1.0), label="one_hot", classes=3)
    fixed = clips.withColumn("waveform", F.slice("waveform", 1, 1000))
    options = pipeline.Options(("x",), ("all",), "train", 3, 11, ("id",), metadata_mode="none")
    rows = made.preprocess(fixed)
    read = lambda seed: [[(r["id"], tuple(np.round(r["audio"]["data"][:5], 5)), tuple(np.round(r["label"], 4))) for r in b["rows"]] for b in pipeline.finalized(rows, options, made, seed=seed).orderBy("batch_id").collect()]
    first = read(1)
    assert first == read(1) != read(2) and [len(b) for b in first] == [3, 3, 3]
    assert any(0 < v < 1 for b in first for _, _, label in b for v in label) and all(abs(sum(label) - 1) < 1e-3 for b in first[:2] for _, _, label in b)
    plain = made.postprocess(rows).select("audio.shape").distinct().collect()
    assert [r["shape"] for r in plain] == [[1000, 1]]


def test_views_give_a_tensor_each(clips):
    views = clips.select(POS, F.array(F.slice("waveform", 1, 500), F.slice("waveform", 501, 500)).alias("waveform"))
    config = presets.Audio(RATE, None, "raw_waveform", signal.Stft(rate=RATE))
    got = stages.model_input(config)(views).collect()
    assert len(got) == 7 and all([v["shape"] for v in r["audio"]] == [[500, 1], [500, 1]] for r in got)


def test_vision_pipeline_from_files_to_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(i, bytearray(images.encode_png(rng.integers(0, 256, (40 + i, 50, 3)).astype(np.uint8))), i % 2) for i in range(5)]
    df = enumerate_rows(spark.createDataFrame(rows, "id long, image binary, label int"), "id")
    made = stages.vision_pipeline("cifar", classes=2)
    options = pipeline.Options(("x",), ("all",), "train", 2, 5, ("id",))
    got = pipeline.finalized(made.preprocess(df), options, made).orderBy("batch_id").collect()
    assert [sum(b["padding_mask"]) for b in got] == [2, 2, 1]
    assert all(r["image"]["shape"] == [3, 32, 32] for b in got for r, real in zip(b["rows"], b["padding_mask"], strict=True) if real)
    quiet = pipeline.Options(("x",), ("all",), "test", 2, 5, ("id",))
    plain = pipeline.finalized(made.preprocess(df), quiet, made).orderBy("batch_id").first()["rows"][0]
    want = images.channels_first((images.resize(images.decode_png(bytes(rows[0][1])), 32, 32) / 255 - np.array(presets.CIFAR10[0])) / (np.array(presets.CIFAR10[1]) + 1e-8))
    assert np.allclose(tensor(plain["image"]), want, atol=1e-3) and plain["label"] == [1, 0]
    for name in ("wilds:rxrx1_strong", "imagenet_resnet", "wilds:fmow_strong"):
        strong = stages.vision_pipeline(name, classes=2)
        assert strong.postprocess(strong.augment(strong.preprocess(df.limit(2)), 3)).count() == 2
    with pytest.raises(KeyError):
        stages.vision_pipeline("segmentation_a1")


def test_batch_configurations_are_checked():
    for bad in (lambda: stages.AudioMixup(prob=1.5), lambda: stages.AudioMixup(label_mode="x"), lambda: stages.CutMixSpec(axes="z"), lambda: stages.WavMix(prob=-1), lambda: stages.MixStyle(prob=2)):
        with pytest.raises(ValueError):
            bad()


def test_helpers(spark):
    assert stages.qualified_name(functools.partial(images.resize, h=1)) == "tidemill.kernels.images.resize"
    df = spark.range(2).withColumn("metadata", F.struct(F.lit("a").alias("x")))
    got = stages.with_augmentation(stages.with_augmentation(df, "crop", size=3), "flip").first()["metadata"]
    assert [a["name"] for a in got["augmentations"]] == ["crop", "flip"] and got["augmentations"][0]["parameters"] == {"size": "3"} and got["x"] == "a"
    x, n = stages.as_batch(np.zeros((2, 3, 3)))
    assert x.shape == (1, 2, 3, 3) and stages.as_before(x, n).shape == (2, 3, 3)
    with pytest.raises(ValueError):
        stages.as_batch(np.zeros(3))
    assert stages.identity_pipeline().preprocess(df) is df


def test_contracts(spark):
    a, b = spark.range(5), spark.range(2, 7)
    assert sorted(tuple(r) for r in contracts.identity_difference(a, b, "id").collect()) == [(0, "missing"), (1, "missing"), (5, "unknown"), (6, "unknown")]
    assert contracts.same_identities(a, spark.range(5).union(spark.range(2)), "id") and not contracts.same_identities(a, b, "id")
    assert [tuple(r) for r in contracts.repeated(a.union(spark.range(1)), "id").collect()] == [(0, 2)]
    masks = [(0, [[0, 1], [255, 1]]), (1, [[0, 1]]), (2, [[0, 1], [1]]), (3, [[0, 7], [0, 0]]), (4, None), (5, [[0, None], [0, 0]])]
    df = spark.createDataFrame(masks, "id int, m array<array<int>>").withColumns({"h": F.lit(2), "w": F.lit(2)})
    issues = {r["id"]: r["issue"] for r in contracts.validate_dense(df, height="h", width="w", mask="m", classes=[0, 1]).collect()}
    assert issues == {1: "shape_differs", 2: "shape_differs", 3: "undeclared_label", 4: "no_mask", 5: "undeclared_label"}
    contracts.validate_classes([0, 1, 2], [1], void=255, capacity=2, ignore=255)
    contracts.validate_categorical("m", "int", 255, [0, 1])
    for args in (([0, 0], []), ([0, -1], []), ([], []), ([0], [1]), ([0, True], [])):
        with pytest.raises(ValueError):
            contracts.validate_classes(*args)
    for more in ({"ignore": 0}, {"capacity": 1}, {"void": -1}):
        with pytest.raises(ValueError):
            contracts.validate_classes([0, 1, 2], [2], **more)
    for args in (("m", "float", 0, []), ("m", "tinyint", 255, []), ("m", "int", 1, [1])):
        with pytest.raises(ValueError):
            contracts.validate_categorical(*args)

"""Numeric kernels: formulas against plain numpy, and what holds of every stochastic operator."""

from __future__ import annotations

import numpy as np
import pytest

from tidemill.kernels import compositing, corruptions, images, scene, signal

RNG = np.random.default_rng(0)
TONE = (0.35 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000) + 0.15 * np.sin(2 * np.pi * 1370 * np.arange(8000) / 16000)).astype(np.float32)
IMAGE = RNG.integers(0, 256, (40, 56, 3)).astype(np.uint8)


def test_wav_round_trip_and_widths():
    x, rate = signal.decode_wav(signal.encode_wav(TONE, 16000))
    assert rate == 16000 and np.abs(x[:, 0] - TONE).max() < 1 / 32768
    assert signal.decode_wav(signal.encode_wav(TONE, 8000), 2)[0].shape == (8000, 2)


def test_power_spectrum_is_the_transform_of_windowed_frames():
    s = signal.Stft(256, 256, 128, center=False, rate=16000)
    got = signal.power_spectrogram(TONE, s)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    want = np.abs(np.fft.rfft(TONE[128:384] * w)) ** 2
    assert got.shape == (1 + (8000 - 256) // 128, 129, 1) and np.allclose(got[1, :, 0], want, rtol=1e-3, atol=1e-3)
    assert int(got.mean(0)[:, 0].argmax()) == round(440 / 16000 * 256)
    assert signal.power_spectrogram(TONE, signal.Stft(256, 256, 128, onesided=False, rate=16000)).shape[1] == 256


@pytest.mark.parametrize("bank", ["htk", "hertz", "slaney", "no_nyquist"])
def test_mel_banks_are_triangles(bank):
    w = signal.mel_bank(signal.Stft(512, 400, 160, rate=16000), signal.Mel(20, 50.0, 7000.0, bank))
    assert w.shape == (257, 20) and (w >= 0).all() and (np.diff(w.argmax(0)) >= 0).all() and w.max() <= 1.0001
    with pytest.raises(ValueError):
        signal.mel_bank(signal.Stft(rate=16000), signal.Mel(high=9000.0))


@pytest.mark.parametrize("name", ["raw_waveform", "stft_magnitude", "mel_power", "logmel", "kaldi_fbank", "mfcc", "ast_kaldi_fbank", "efficientat_logmel"])
def test_frontends_are_finite(name):
    got = signal.frontend(TONE, name, signal.Stft(512, 400, 160, rate=16000), signal.Mel(32, 20.0), signal.Log(amin=1e-6))
    assert np.isfinite(got).all() and got.ndim in (2, 3)


#: Vectors whose sums lie within 1e-6 of where rounding turns, and the digests of the SQL.
@pytest.mark.parametrize(("name", "seed", "want"), [("fe08_logmel", 183729, (72, 183.3, 4.5)), ("fe10_mfcc", 45029, (54, 97.2, 14.4)), ("fe12_emphasised_logmel", 114178, (64, 93.5, 1.86))])
def test_digests_round_as_64_bits_do(spark, tmp_path, name, seed, want):
    from tidemill.queries import QUERIES

    x = np.random.default_rng(seed).standard_normal(64).astype(np.float32)
    spark.createDataFrame([(5, 1, x.tolist())], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == [(5, *want)]


def test_coefficients_of_bands_below_the_floor_are_those_of_the_sql(spark, tmp_path):
    from tidemill.queries import QUERIES

    spark.createDataFrame([(0, 1, [0.0] * 64), (1, 1, [1.0] * 64)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, QUERIES["fe10_mfcc"](spark, str(tmp_path)).collect())) == [(0, 54, -497.4, 0.0), (1, 54, -105.5, 8.5)]


def test_normalisation_and_compression():
    x = signal.mel_spectrogram(TONE, signal.Stft(512, 400, 160, rate=16000), signal.Mel(16))
    y = signal.normalise(x, signal.Norm("per_clip_mean_std"))
    assert abs(y.mean()) < 1e-4 and abs(y.std() - 1) < 1e-2
    db = signal.compress(x, signal.Log("db", ref="max", top_db=40.0))
    assert db.max() == pytest.approx(0) and db.min() >= -40
    assert (signal.compress(x, signal.Log("pcen")) >= 0).all()
    with pytest.raises(ValueError):
        signal.normalise(x, signal.Norm("none such"))


def test_resampling():
    assert np.allclose(signal.resize_matrix(10, 4).sum(1), 1)
    assert signal.resample(TONE, 16000, 8000).shape == (4000, 1)
    assert np.allclose(signal.resize_time(np.ones((100, 1)), 37), 1)
    with pytest.raises(ImportError):
        signal.resample(TONE, 16000, 8000, "soxr")
    with pytest.raises(ValueError):
        signal.resample(TONE, 16000, 8000, "identity")


@pytest.mark.parametrize("kind", ["white", "pink", "brown"])
def test_noise_has_the_stated_level(kind):
    n = signal.coloured_noise((4000, 1), kind, signal.rng_of(1))
    y = signal.at_snr(TONE[:4000, None], n, 10.0)
    ratio = 10 * np.log10((TONE[:4000] ** 2).mean() / ((y - TONE[:4000, None]) ** 2).mean())
    assert ratio == pytest.approx(10, abs=0.1) and np.sqrt((n**2).mean()) == pytest.approx(1, abs=1e-3)


def test_convolution_is_that_of_numpy():
    ir = RNG.standard_normal(9)
    assert np.allclose(signal.convolve(TONE[:200, None], ir)[:, 0], np.convolve(TONE[:200], ir)[4:204], atol=1e-5)


@pytest.mark.parametrize("name", sorted(signal.WAVEFORM_AUGMENTS))
def test_waveform_augments(name):
    spec = {"name": name, "prob": 1.0, **({"target_length": 4000} if name == "random_crop" else {})}
    run = lambda k, **o: signal.augment_waveform(TONE, 16000, [spec], key=(3, k), **o)
    assert (run(1) == run(1)).all() and (run(1, training=False) == TONE[:, None]).all()
    if name not in ("polarity_inversion", "codec_simulation"):
        assert any(not np.array_equal(run(1), run(k)) for k in range(2, 12))


@pytest.mark.parametrize("name", sorted(signal.SPECTROGRAM_AUGMENTS))
def test_spectrogram_augments(name):
    x = RNG.random((30, 16)).astype(np.float32)
    spec = {"name": name, **({"n_time_patches": 4} if name == "passt_patchout" else {})}
    run = lambda k, **o: signal.augment_spectrogram(x, [spec], key=(3, k), order="tf", **o)
    assert np.array_equal(run(1), run(1)) and np.array_equal(run(1, training=False), x)
    assert any(not np.array_equal(run(1), run(k)) for k in range(2, 12))


@pytest.mark.parametrize("name", sorted(signal.CORRUPTIONS))
def test_audio_corruptions(name):
    run = lambda s, k=1: signal.corrupt(TONE, name, s, seed=(2, k), rate=32000)
    assert run(3).shape == (8000, 1) and np.array_equal(run(3), run(3)) and np.isfinite(run(5)).all()
    assert name == "band_pass" or np.abs(run(5) - TONE[:, None]).max() > 1e-4  # the tone lies within the band
    if "noise" in name or name in ("clipping", "codec_compression", "dynamic_range_compression", "low_pass"):
        assert np.abs(run(5) - TONE[:, None]).mean() > np.abs(run(1) - TONE[:, None]).mean()
    for bad in (0, 6, True):
        with pytest.raises(ValueError):
            run(bad)


def test_png_round_trip():
    for x in (IMAGE, IMAGE[..., :1], RNG.integers(0, 65536, (5, 7, 1)).astype(np.uint16)):
        assert (images.decode_png(images.encode_png(x)) == x).all()
    assert (images.decode_mask(images.encode_png(IMAGE[..., 0])) == IMAGE[..., 0]).all()
    with pytest.raises(ValueError):
        images.decode_mask(images.encode_png(IMAGE))
    with pytest.raises(ValueError):
        images.check_image_file(images.encode_png(IMAGE), most_side=10)
    assert images.as_rgb(IMAGE.transpose(2, 0, 1)).shape == IMAGE.shape and images.as_rgb(IMAGE[..., 0] / 255.0).shape == IMAGE.shape


def test_resizing_and_views():
    assert np.allclose(images.resize(np.full((9, 7, 3), 5.0), 4, 11), 5)
    assert (images.nearest(np.arange(6).reshape(6, 1), 3, 1)[:, 0] == [1, 3, 5]).all()
    assert [v["crop_box"][:2] for v in images.eval_views(IMAGE, 20, 24)] == [(0, 0), (0, 14), (4, 0), (4, 14), (2, 7)]
    assert len(images.eval_views(IMAGE, 20, 24, flip=True)) == 10


@pytest.mark.parametrize("name", sorted(images.OPERATIONS))
def test_pixel_operations_stay_in_range(name):
    y = np.clip(images.OPERATIONS[name](IMAGE, 0.5, 1, {**images.DEFAULTS, "translate_const": 5.0}), 0, 255)
    assert y.shape == IMAGE.shape


def test_sampled_operations_follow_their_key():
    a, b = images.rand_augment(IMAGE, key=(1, 2)), images.rand_augment(IMAGE, key=(1, 2))
    assert (a == b).all() and any((images.rand_augment(IMAGE, key=(1, k)) != a).any() for k in range(3, 9))
    mask = (IMAGE[..., 0] > 99).astype(np.uint8)
    _, m = images.rand_augment(IMAGE, key=(1, 5), mask=mask, layers=4)
    assert set(np.unique(m)) <= {0, 1, 255}
    assert images.multi_crops(IMAGE, key=(1,), count=2, size=16, scale=(0.3, 1.0)).shape == (2, 16, 16, 3)


def test_mixing_and_erasing():
    x, y = RNG.random((6, 8, 8, 3)), np.eye(6)
    out, labels = images.mix_images(x, y, key=(1,))
    assert np.allclose(labels.sum(1), 1) and out.shape == x.shape
    assert (images.erase(x, key=(1,), p=1.0) == 0).any() and np.array_equal(images.erase(x, key=(1,), p=0.0), x)
    spec = x[..., :1]
    mixed, la = signal.cut_mix(spec, y, key=(1,))
    assert mixed.shape == spec.shape and np.allclose(la.sum(1), 1)
    assert signal.mix_style(spec, key=(1,)).shape == spec.shape
    assert (signal.partner_order(5, signal.rng_of(1)) != np.arange(5)).any()


@pytest.mark.parametrize("name", sorted(n for n, _ in corruptions.REGISTRY))
def test_image_corruptions(name):
    run = lambda s, k=1: corruptions.apply_corruption(IMAGE, name=name, severity=s, seed=(4, k))
    assert run(3).dtype == np.uint8 and run(3).shape == IMAGE.shape and (run(3) == run(3)).all() and (run(5) != IMAGE).any()
    d = corruptions.find(name)
    assert (corruptions.apply_stack(IMAGE, [(name, 0.0)], seed=(4, 1))[0] == IMAGE).all()
    assert all(d.at(3.0)[k] == pytest.approx(v[2], rel=1e-6) for k, v in d.parameters.items())
    if d.random:
        assert any((run(4) != run(4, k)).any() for k in range(2, 12))
    with pytest.raises(ValueError):
        run(0)


def test_stacks_round_once_and_tell_their_steps():
    out, records = corruptions.apply_stack(IMAGE, [("haze", 2.0), ("gaussian_noise", 1.0), ("gaussian_noise", 1.0)], seed=(1, 2))
    assert [r["strength"] for r in records] == [2.0, 1.0, 1.0] and out.shape == IMAGE.shape
    assert corruptions.stack_identity([("haze", 2.0)]) != corruptions.stack_identity([("haze", 2.5)])
    with pytest.raises(ValueError):
        corruptions.apply_corruption(IMAGE.astype(float), name="noise", severity=1, seed=(1, 1))
    h = corruptions.Horizon(12.0, 14.0, 3.0, 50.0)
    assert corruptions.apply_corruption(IMAGE, name="haze", severity=3, seed=(1, 1), horizon=h).shape == IMAGE.shape
    assert np.linalg.norm(corruptions.illuminant(IMAGE)) == pytest.approx(1)


def test_scene_kernels_against_plain_loops():
    rng = np.random.default_rng(8)
    x = rng.random((9, 21)) * 255
    for axis in (0, 1):
        got = scene.windowed_minimum(x, 5, axis)
        rows = x if axis else x.T
        want = np.array([[min(r[max(0, i - 2) : i + 3]) for i in range(len(r))] for r in rows])
        assert np.array_equal(got if axis else got.T, want)
    assert np.allclose(scene.box_mean(x, 1)[3, 4], x[2:5, 3:6].mean()) and np.allclose(scene.box_mean(x, 1)[0, 0], np.pad(x, 1, mode="reflect")[:3, :3].mean())
    assert scene.folded(np.array([-1.0, 0, 3.5, 4, 5, 9]), 5).tolist() == [1, 0, 3.5, 4, 3, 1]
    points, area = scene.streak(np.array([10.0, 3.0]), 1.0)
    assert area * len(points) == pytest.approx(np.hypot(10, 3)) and np.allclose(points.mean(0), [5, 1.5])
    wet = scene.rain(np.zeros((40, 30, 3)), 6.0, np.array([8.0, 2.0]), 1.0, 3.0, 1.0, 10, np.random.default_rng(1))
    more = scene.rain(np.zeros((40, 30, 3)), 9.5, np.array([8.0, 2.0]), 1.0, 3.0, 1.0, 10, np.random.default_rng(1))
    assert 0 < wet.sum() < more.sum() and (more >= wet - 1e-9).all()
    values = rng.random(50)
    assert (values >= scene.reached_by(values, 0.1)).sum() == 5 and not (values >= scene.reached_by(values, 0.01)).any()
    field = scene.patches(np.random.default_rng(2), 30, 60)
    assert field.shape == (30, 60) and 0 <= field.min() < field.max() <= 1
    near = corruptions.Horizon(4.0, 4.0, 2.0, 100.0).water_distance_m(20, 20)
    assert near[0, 0] == scene.FARTHEST_M and (np.diff(near[:, 10]) <= 0).all()
    grey = np.full((16, 16, 3), 130.0)
    assert np.abs(scene.jpeg(grey, 30) - grey).max() <= 4
    smooth = np.add.outer(np.arange(32), np.arange(32))[..., None] * np.ones(3) * 4
    errors = [np.abs(scene.jpeg(smooth, q) - smooth).mean() for q in (95, 50, 10)]
    assert errors[0] < errors[1] < errors[2] and errors[0] < 2 and scene.jpeg(rng.random((7, 13, 3)) * 255, 75).shape == (7, 13, 3)
    assert scene.quantisers(50)[0][0, 0] == 16 and scene.quantisers(100)[1].max() == 1


def test_panoptic_targets_and_overflow():
    mask = np.zeros((6, 6), int)
    mask[0], mask[1, :4], mask[2, :3], mask[3, :2], mask[4] = 1, 2, 3, 4, 5
    table = [(1, 7, False), (2, 8, False), (3, 8, False), (4, 9, False), (5, 9, True)]
    whole = images.panoptic_targets(mask, table, (7, 8, 9), (8, 9), 10)
    assert [(t[0], t[1]) for t in whole["targets"]] == [(7, 0), (8, 2), (8, 3), (9, 4)] and not whole["pixel_valid_mask"][4].any()
    with pytest.raises(ValueError, match="capacity"):
        images.panoptic_targets(mask, table, (7, 8, 9), (8, 9), 3)
    cut = images.panoptic_targets(mask, table, (7, 8, 9), (8, 9), 3, policy="exclude_supervision")
    assert [t[1] for t in cut["targets"]] == [0, 2, 3] and not cut["pixel_valid_mask"][3].any()
    merged = images.panoptic_targets(mask, table, (7, 8, 9), (8, 9), 3, policy="merge_by_category")
    assert [(t[0], t[1]) for t in merged["targets"]] == [(7, 0), (9, 4), (8, 0)] and merged["targets"][2][3].sum() == 7
    with pytest.raises(ValueError, match="disagree"):
        images.panoptic_targets(mask, table[:3], (7, 8, 9), (8, 9), 10)


def test_replay_and_restore():
    record = {"original_size": (40, 56), "resized_size": (20, 28), "crop_box": (0, 0, 20, 28), "pre_padding": (0, 0, 0, 0), "post_padding": (0, 12, 0, 4), "model_input_size": (32, 32), "image_pad_mode": 0, "horizontal_flip": False, "mask_fill_value": 255}
    v = images.replay(IMAGE, record, np.ones((40, 56), np.int64))
    assert v["image"].shape == (32, 32, 3) and v["source_valid_mask"].sum() == 20 * 28 and (v["mask"][20:] == 255).all()
    assert images.restore(np.ones((32, 32, 4)), record).shape == (40, 56, 4)
    assert [s["area"] for s in images.visible_segments(np.array([[1, 1], [2, 0]]), [(1, 5, False), (2, 5, False), (3, 5, False)])] == [2, 1]


def test_compositing():
    x = compositing.Instance(np.full((8, 8, 3), 200, np.uint8), np.ones((8, 8)), 3, "a", 0.7)
    run = lambda **o: compositing.composite(IMAGE, np.zeros((40, 56), np.uint8), [x, x], allowed=np.ones((40, 56), bool), placement=compositing.Placement(least_pixels=4, **o), seed=(1, 2), instance_map=np.zeros((40, 56), np.int64))
    a, b = run(), run()
    assert (a["image"] == b["image"]).all() and [r["status"] for r in a["records"]] == ["placed", "placed"]
    assert sum(r["visible_pixels"] for r in a["records"]) == (a["mask"] == 3).sum() == (a["instance_map"] > 0).sum()
    assert run(margin=19)["records"][0]["reason"] == "outside_margin"
    with pytest.raises(ValueError):
        compositing.Placement(scale="no such")
    assert compositing.Blending((("hard", 1.0), ("soft_edge", 3.0))).mode(0.2) == "hard"


def test_seamless_clone_solves_the_equation():
    d, lap = RNG.random((9, 11, 2)), RNG.random((9, 11, 2))
    u = compositing.solve_poisson(d, lap)
    inner = u[:-2, 1:-1] + u[2:, 1:-1] + u[1:-1, :-2] + u[1:-1, 2:] - 4 * u[1:-1, 1:-1]
    assert np.allclose(inner, lap[1:-1, 1:-1]) and np.allclose(u[0], d[0])
    m = np.pad(np.ones((12, 12)), 2)
    same = compositing.seamless_clone(IMAGE, IMAGE[5:21, 6:22], m, (5, 6))
    assert np.abs(same.astype(int) - IMAGE).max() <= 1
    with pytest.raises(ValueError):
        compositing.seamless_clone(IMAGE, IMAGE[:16, :16], m, (35, 50))

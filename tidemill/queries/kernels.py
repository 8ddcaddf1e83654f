"""Numeric kernels over arrays as queries; those that draw nothing are held against the formulas written out in SQL.

Kernels compute in 32 bits unless told otherwise, so digests are rounded to where that seldom shows; a sum next to where
rounding turns needs the 64 bits of the SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemill.kernels import compositing, corruptions, images, signal
from tidemill.operators.arrow import batch_kernel, column_kernel, stacked_kernel
from tidemill.queries._registry import query, table

SPECTRUM = signal.Stft(n_fft=32, window=32, hop=8, rate=64)
BANDS = signal.Mel(8)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding")


def _features(name: str, **options):
    def f(x):
        return signal.frontend(np.asarray(x, np.float32), name, SPECTRUM, BANDS, **options)

    # all but one treat channels alike, and take a batch of clips as channels
    return column_kernel(f, "array<double>") if name == "ast_kaldi_fbank" else stacked_kernel(f)


def _digest(df, x, total: int | None = 4, most: int | None = 4):
    rounded = lambda v, digits: v if digits is None else F.round(v, digits) + 0.0
    return df.select("vec_id", F.size(x).alias("n"), rounded(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), total).alias("total"), rounded(F.array_max(x), most).alias("most"))


def _digested(ctes: str, of: str, total: int = 4, most: int = 4) -> str:
    return f"WITH {ctes} SELECT vec_id, count(*)::INT AS n, round(sum(v), {total}) + 0.0 AS total, round(max(v), {most}) + 0.0 AS most FROM {of} GROUP BY 1"


#: Samples (vec_id, i, v); frames of 32 at steps of 8 over samples mirrored by 16 at both ends, under a periodic Hann
#: window; powers of 17 bins; triangles between points that are even in mel, for a rate of 64.
_SAMPLES = "x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_MIRRORED = "places AS (SELECT t, k, CASE WHEN p < 0 THEN -p WHEN p > {last} THEN 2 * {last} - p ELSE p END AS i FROM (SELECT a.t, b.k, 8 * a.t + b.k - 16 AS p FROM range({frames}) a(t), range(32) b(k)))"
_POWERS = """y AS (SELECT vec_id, t, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 32)) AS v FROM places JOIN x USING (i)),
p AS (SELECT vec_id, t, f, pow(sum(v * cos(2 * pi() * k * f / 32)), 2) + pow(sum(v * sin(2 * pi() * k * f / 32)), 2) AS v FROM y, range(17) b(f) GROUP BY ALL)"""
_MEL = "1127 * ln(1 + ({}) / 700.0)"
_EDGES = f"e AS (SELECT m, {_MEL.format('32')} * m / 9 AS l, {_MEL.format('32')} * (m + 1) / 9 AS c, {_MEL.format('32')} * (m + 2) / 9 AS h FROM range(8) a(m))"
_BANK = f"w AS (SELECT m, f, greatest(0, least(({_MEL.format('2 * f')} - l) / (c - l), (h - {_MEL.format('2 * f')}) / (h - c))) AS w FROM e, range(1, 17) b(f))"
_HERTZ = "700 * (exp(({}) / 1127.0) - 1)"
_HERTZ_BANK = f"w AS (SELECT m, f, greatest(0, least((2 * f - {_HERTZ.format('l')}) / ({_HERTZ.format('c')} - {_HERTZ.format('l')}), ({_HERTZ.format('h')} - 2 * f) / ({_HERTZ.format('h')} - {_HERTZ.format('c')}))) AS w FROM e, range(16) b(f))"
_BANDS = "b AS (SELECT vec_id, t, m, sum(v * w) AS v FROM p JOIN w USING (f) GROUP BY ALL)"
_FRAMED = ", ".join([_SAMPLES, _MIRRORED.format(last=63, frames=9), _POWERS])
_EMPHASISED = "x AS (SELECT vec_id, i - 1 AS i, v - 0.97 * p AS v FROM (SELECT vec_id, i, v, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)) WHERE i > 0)"


@query(_digested(_FRAMED, "p", 1, 1))
def fe02_stft(spark, d):
    v = _vectors(spark, d)
    return _digest(v, _features("stft_magnitude")(F.col("embedding")), 1, 1)


@query(_digested(f"{_FRAMED}, {_EDGES}, {_BANK}, {_BANDS}", "(SELECT vec_id, ln(greatest(v, 1e-10)) AS v FROM b)", 1, 1))
def fe08_logmel(spark, d):
    v = _vectors(spark, d)
    return _digest(v, _features("logmel", dtype=np.float64)(F.col("embedding")), 1, 1)


@query(_digested(f"{_FRAMED}, {_EDGES}, {_BANK}, {_BANDS}", "(SELECT vec_id, t, j, sum(ln(greatest(v, 1e-6)) * 0.5 * cos(pi() / 8 * (m + 0.5) * j)) AS v FROM b, range(6) a(j) GROUP BY ALL)", 1, 1))
def fe10_mfcc(spark, d):
    v = _vectors(spark, d)
    return _digest(v, _features("mfcc", count=6, c=signal.Log(amin=1e-6), dtype=np.float64)(F.col("embedding")), 1, 1)


@query()
def fe11_clip_fbank(spark, d):
    v = _vectors(spark, d)
    return _digest(v, _features("ast_kaldi_fbank")(F.col("embedding")))


@query(_digested(f"{_EMPHASISED}, {_MIRRORED.format(last=62, frames=8)}, {_POWERS}, {_EDGES}, {_HERTZ_BANK}, {_BANDS}", "(SELECT vec_id, 0.2 * ln(v + 1e-5) + 0.9 AS v FROM b)", 1, 2))
def fe12_emphasised_logmel(spark, d):
    v = _vectors(spark, d)
    return _digest(v, _features("efficientat_logmel", dtype=np.float64)(F.col("embedding")), 1, 2)


@query(_digested(f"{_SAMPLES}, w AS (SELECT o, i, greatest(0, 1 - abs(i - ((o + 0.5) / 0.375 - 0.5)) * 0.375) AS w FROM range(24) a(o), range(64) b(i))", "(SELECT vec_id, o, sum(v * w) / sum(w) AS v FROM x JOIN w USING (i) GROUP BY ALL)", 2, 2))
def arr10_resampled(spark, d):
    f = column_kernel(lambda x: signal.resample(np.asarray(x, np.float32), 64, 24), "array<double>")
    return _digest(_vectors(spark, d), f(F.col("embedding")), 2, 2)


@query(f"WITH {_SAMPLES} SELECT vec_id, count(*)::INT AS n, sum(s) AS total, max(s) AS most FROM (SELECT vec_id, least(greatest(round_even(v * 32768, 0), -32768), 32767) / 32768.0 AS s FROM x) GROUP BY 1")
def arr01_wav(spark, d):
    f = column_kernel(lambda x: signal.decode_wav(signal.encode_wav(np.clip(x, -1, 1), 64))[0], "array<double>")
    return _digest(_vectors(spark, d), f(F.col("embedding")), None, None)


@query()
def wa11_waveform_augments(spark, d):
    specs = ["random_gain", {"name": "additive_noise", "prob": 1.0}, {"name": "time_shift", "max_shift_seconds": 0.1}, {"name": "codec_simulation", "codec": "alaw"}]
    f = column_kernel(lambda x, i: signal.augment_waveform(np.asarray(x, np.float32), 64, specs, key=(7, i)), "array<double>")
    return _digest(_vectors(spark, d), f(F.col("embedding"), F.col("vec_id")))


@query()
def sa09_spectrogram_augments(spark, d):
    specs = ["frequency_mask", "time_mask", {"name": "mel_bin_shift", "max_bins": 2}, "random_eq"]
    f = column_kernel(lambda x, i: signal.augment_spectrogram(np.asarray(x, np.float32).reshape(8, 8, 1), specs, key=(7, i)), "array<double>")
    return _digest(_vectors(spark, d), f(F.col("embedding"), F.col("vec_id")))


@query()
def ac12_audio_corruptions(spark, d):
    v = _vectors(spark, d).withColumn("corruption", F.explode(F.array(*[F.lit(n) for n in sorted(signal.CORRUPTIONS)])))
    f = column_kernel(lambda x, n, i: signal.corrupt(np.asarray(x, np.float32), n, 1 + i % 5, seed=(3, i), rate=32000), "array<double>")
    x = f(F.col("embedding"), F.col("corruption"), F.col("vec_id"))
    return v.withColumn("x", x).select("vec_id", "corruption", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 3).alias("total"))


def _corrupted(names: list[str]):
    """Digests of vectors as signals at 32 kHz under each corruption, at a severity that depends on the vector."""

    def run(spark, d):
        v = _vectors(spark, d).withColumn("corruption", F.explode(F.array(*map(F.lit, names))))
        f = column_kernel(lambda x, n, i: signal.corrupt(np.asarray(x, np.float32), n, 1 + i % 5, seed=(3, i), rate=32000), "array<double>")
        x = f(F.col("embedding"), F.col("corruption"), F.col("vec_id"))
        rounded = lambda c: F.round(c, 2) + 0.0
        return v.withColumn("x", x).select("vec_id", "corruption", rounded(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("total"), rounded(F.array_max("x")).alias("most"))

    return run


def _by_severity(*columns) -> str:
    return "(VALUES " + ", ".join(f"({k}, {', '.join(map(repr, row))})" for k, row in enumerate(zip(*columns, strict=True))) + ")"


_INF = (1e9,) * 5
_LIMITS = " UNION ALL ".join(
    f"SELECT '{name}' AS corruption, k, lo, hi FROM {_by_severity(low, high)} t(k, lo, hi)"
    for name, low, high in (("low_pass", (0.0,) * 5, signal.LOW_PASS), ("high_pass", signal.HIGH_PASS, _INF), ("band_pass", [b[0] for b in signal.BAND_PASS], [b[1] for b in signal.BAND_PASS]))
)
#: Gains of the 33 bins of 64 samples at 32 kHz, and the circular kernel that they stand for.
_GAINS = f"""g AS (SELECT corruption, k, f, (500 * f >= lo AND 500 * f <= hi)::INT::DOUBLE AS g FROM ({_LIMITS}), range(33) a(f)
UNION ALL SELECT 'equalization_tilt', k, f, greatest(0.125, least(4.0, pow(10, db * log2(greatest(500.0 * f, 1) / 1000) / 20))) FROM {_by_severity(signal.TILT_DB)} t(k, db), range(33) a(f)),
h AS (SELECT corruption, k, m, sum(g * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END * cos(2 * pi() * f * m / 64)) / 64 AS h FROM g, range(64) b(m) GROUP BY ALL)"""


@query(f"WITH {_SAMPLES}, {_GAINS} SELECT vec_id, corruption, round(sum(y), 2) + 0.0 AS total, round(max(y), 2) + 0.0 AS most FROM (SELECT vec_id, corruption, o, sum(v * h) AS y FROM x, range(64) c(o) JOIN h ON m = (o - i + 64) % 64 AND k = vec_id % 5 GROUP BY ALL) GROUP BY ALL".replace("FROM x, range(64) c(o) JOIN", "FROM (SELECT * FROM x, range(64) c(o)) JOIN"))
def ac08_filters(spark, d):
    return _corrupted(["low_pass", "high_pass", "band_pass", "equalization_tilt"])(spark, d)


_LENGTHS = f"""t AS (SELECT 'time_stretch' AS corruption, k, round_even(64 * f, 0)::INT AS n FROM {_by_severity(signal.STRETCH)} s(k, f)
UNION ALL SELECT 'pitch_shift', k, round_even(64 / pow(2, f / 12), 0)::INT FROM {_by_severity(signal.SEMITONES)} s(k, f)),
w AS (SELECT corruption, k, n, o, i, greatest(0, 1 - abs(i - ((o + 0.5) * 64 / n - 0.5)) / greatest(1, 64.0 / n)) AS w FROM t, range(64) a(o), range(64) b(i) WHERE o < n)"""


@query(f"WITH {_SAMPLES}, {_LENGTHS} SELECT vec_id, corruption, round(sum(y), 2) + 0.0 AS total, round(greatest(max(y), CASE WHEN min(n) < 64 THEN 0 ELSE max(y) END), 2) + 0.0 AS most FROM (SELECT vec_id, corruption, n, o, sum(v * w) / sum(w) AS y FROM x JOIN w ON w.i = x.i AND k = vec_id % 5 WHERE w > 0 GROUP BY ALL) GROUP BY ALL")
def ac10_time(spark, d):
    return _corrupted(["time_stretch", "pitch_shift"])(spark, d)


@query()
def ba03_cut_mix(spark, d):
    v = _vectors(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 16))

    def f(key, pdf):
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["embedding"].to_numpy()).reshape(len(pdf), 8, 8, 1)
        out, labels = signal.cut_mix(x, np.eye(10)[pdf["label"].to_numpy()], key=(5, int(key[0])))
        return pdf[["vec_id"]].assign(total=out.reshape(len(pdf), -1).sum(1).round(4), top=labels.max(1))

    return batch_kernel(v, ["batch"], f, "vec_id long, total double, top double")


@query()
def sa05_mix_style(spark, d):
    v = _vectors(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 16))

    def f(key, pdf):
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["embedding"].to_numpy()).reshape(len(pdf), 8, 8, 1)
        return pdf[["vec_id"]].assign(total=signal.mix_style(x, key=(5, int(key[0]))).reshape(len(pdf), -1).sum(1).round(4))

    return batch_kernel(v, ["batch"], f, "vec_id long, total double")


def _image(x) -> np.ndarray:
    """A small picture that depends on a vector."""
    x = np.abs(np.asarray(x, np.float64))
    return (np.outer(x[:24], x[24:56]).reshape(24, 32, 1) * np.array([900.0, 600.0, 300.0]) % 256).astype(np.uint8)


def _pictured(spark, d):
    return _vectors(spark, d)


@query()
def vc15_image_corruptions(spark, d):
    names = sorted(n for n, _ in corruptions.REGISTRY)
    v = _pictured(spark, d).withColumn("corruption", F.get(F.array(*map(F.lit, names)), (F.col("vec_id") % len(names)).cast("int")))
    f = column_kernel(lambda x, n, i: float(corruptions.apply_corruption(_image(x), name=n, severity=1 + i % 5, seed=(1, i)).sum()), "double")
    return v.select("vec_id", "corruption", f(F.col("embedding"), F.col("corruption"), F.col("vec_id")).alias("total"))


@query()
def vc17_corruption_stack(spark, d):
    f = column_kernel(lambda x, i: float(corruptions.apply_stack(_image(x), [("haze", 1.5), ("rain", 2.0), ("low_light", 0.5)], seed=(2, i), episode_seed=(2, i // 10))[0].sum()), "double")
    return _pictured(spark, d).select("vec_id", f(F.col("embedding"), F.col("vec_id")).alias("total"))


@query()
def im16_sampled_ops(spark, d):
    f = column_kernel(lambda x, i: float(images.rand_augment(_image(x), key=(4, i)).sum()), "double")
    g = column_kernel(lambda x, i: float(images.trivial_augment(_image(x), key=(4, i), wide=True).sum()), "double")
    return _pictured(spark, d).select("vec_id", f(F.col("embedding"), F.col("vec_id")).alias("rand"), g(F.col("embedding"), F.col("vec_id")).alias("trivial"))


#: Pixels of ``_image`` (vec_id, y, x, c, v); 24 rows to 20 and 32 columns to 27 by triangles, rows 2 to 17 and columns 5
#: to 20 of those; channels less their mean, by their deviation.
_PICTURE = "e AS (SELECT vec_id, unnest(range(64)) AS i, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings), px AS (SELECT a.vec_id, a.i AS y, b.i - 24 AS x, c, floor((a.v * b.v * s) % 256) AS v FROM e a JOIN e b USING (vec_id), (VALUES (0, 900.0::DOUBLE), (1, 600.0), (2, 300.0)) t(c, s) WHERE a.i < 24 AND b.i BETWEEN 24 AND 55)"
_TRIANGLE = "{name} AS (SELECT o, i, greatest(0, 1 - abs(i - ((o + 0.5) * {source} / {target}::DOUBLE - 0.5)) / greatest(1, {source} / {target}::DOUBLE)) AS w FROM range({low}, {low} + 16) a(o), range({source}) b(i))"
_RESIZED = f"{_PICTURE}, {_TRIANGLE.format(name='wy', source=24, target=20, low=2)}, {_TRIANGLE.format(name='wx', source=32, target=27, low=5)}, r AS (SELECT vec_id, o AS y, x, c, sum(v * w) / sum(w) AS v FROM px JOIN wy ON wy.i = px.y WHERE w > 0 GROUP BY ALL), q AS (SELECT vec_id, y, o AS x, c, sum(v * w) / sum(w) AS v FROM r JOIN wx ON wx.i = r.x WHERE w > 0 GROUP BY ALL)"


@query(_digested(_RESIZED, "(SELECT vec_id, (v / 255 - mean) / (std + 1e-8) AS v FROM q JOIN (VALUES (0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)) t(c, mean, std) USING (c))", 0, 1))
def im07_resize_normalise(spark, d):
    f = column_kernel(lambda x: images.resize_and_normalise(_image(x), 16, 20), "array<double>")
    return _digest(_pictured(spark, d), f(F.col("embedding")), 0, 1)


@query()
def im08_eval_views(spark, d):
    f = column_kernel(lambda x: np.array([v["image"].sum() for v in images.eval_views(_image(x), 16, 20, flip=True)]), "array<double>")
    return _digest(_pictured(spark, d), f(F.col("embedding")))


@query()
def im27_heatmaps(spark, d):
    def f(x):
        b = np.sort(np.abs(np.asarray(x, np.float64))[:8].reshape(4, 2) % 1, axis=0)
        boxes = np.array([[b[0, 0], b[0, 1], b[2, 0] + 0.05, b[2, 1] + 0.05], [b[1, 0], b[1, 1], b[3, 0] + 0.05, b[3, 1] + 0.05]])
        return images.heatmaps(12, 12, boxes, np.array([0, 1]), 2, gaussian=True)

    return _digest(_pictured(spark, d), column_kernel(f, "array<double>")(F.col("embedding")))


@query()
def geo04_replay(spark, d):
    record = {"resized_size": (30, 40), "crop_box": (2, 3, 24, 24), "pre_padding": (0, 0, 0, 0), "post_padding": (0, 8, 0, 8), "image_pad_mode": 0, "horizontal_flip": True, "mask_fill_value": 255}

    def f(x):
        image = _image(x)
        v = images.replay(image, record, (image[..., 0] > 100).astype(np.int64))
        return np.array([v["image"].sum(), v["mask"].sum(), v["pixel_valid_mask"].sum()])

    return _digest(_pictured(spark, d), column_kernel(f, "array<double>")(F.col("embedding")))


@query()
def cp01_composite(spark, d):
    def f(x, i):
        image = _image(x)
        patch = compositing.Instance(image[:6, :6], np.ones((6, 6)), 3, "p", 0.8)
        got = compositing.composite(image, np.zeros(image.shape[:2], np.uint8), [patch, patch], allowed=np.ones(image.shape[:2], bool), placement=compositing.Placement(least_pixels=4), seed=(9, i))
        return np.array([got["image"].sum(), (got["mask"] == 3).sum()])

    return _digest(_pictured(spark, d), column_kernel(f, "array<double>")(F.col("embedding"), F.col("vec_id")))


@query()
def cp05_seamless_clone(spark, d):
    def f(x):
        image = _image(x)
        return compositing.seamless_clone(image, image[::-1], np.pad(np.ones((14, 14)), 1), (4, 5)).astype(float)

    return _digest(_pictured(spark, d), column_kernel(f, "array<double>")(F.col("embedding")))

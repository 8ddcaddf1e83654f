"""Signals as array columns: conversions, level, shifts, log compression, codecs, simple corruptions.

ARR02-08, ARR11, ARR14, ARR15, WIN10, WIN12, FE06, FE13, FE14, WA01-07, WA10, SA02, AC03, AC05-07, AC11. Arithmetic
is in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.hashing import draw

EPS = 1e-8
# Parameters by severity 1 to 5.
MU_LAW_LEVELS = (256, 128, 64, 32, 16)
CLIP_THRESHOLDS = (0.95, 0.8, 0.6, 0.4, 0.25)
COMPRESSION_DB = (-3.0, -6.0, -12.0, -18.0, -24.0)
COMPRESSION_RATIOS = (1.5, 2.0, 4.0, 8.0, 12.0)
DEVICE_TAPS = ((0.02, 0.08, 0.80, 0.08, 0.02), (0.04, 0.12, 0.68, 0.12, 0.04), (0.08, 0.16, 0.52, 0.16, 0.08), (0.12, 0.20, 0.36, 0.20, 0.12), (0.16, 0.22, 0.24, 0.22, 0.16))
DROPOUT_SHARES = (0.01, 0.025, 0.05, 0.10, 0.20)
DROPOUT_MS = (5.0, 10.0, 20.0, 30.0, 50.0)


def by_severity(values: tuple, severity: int):
    """AC12: the value for a severity from 1 to 5."""
    if isinstance(severity, bool) or not isinstance(severity, int) or not 1 <= severity <= len(values):
        raise ValueError(f"severity must be a whole number from 1 to {len(values)}")
    return values[severity - 1]


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once; a lambda would work out an outer expression for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def mean(x: Column, of=lambda v: v) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + of(v.cast("double")))
    return F.when(F.size(x) > 0, total / F.size(x)).otherwise(F.lit(0.0))


def from_integer(x: Column, kind: str, clip: float | None = None) -> Column:
    """ARR02: int16, int32 or uint8 samples to -1 to 1."""
    scale = {"int16": lambda v: v / 32768.0, "int32": lambda v: v / 2147483648.0, "uint8": lambda v: (v - 128.0) / 128.0}[kind]
    y = F.transform(x, lambda v: scale(v.cast("double")))
    return y if clip is None else clipped(y, clip)


def window_of(x: Column, start: Column, end: Column, rate: Column | int) -> Column:
    """ARR04: samples round(start * rate) to round(end * rate), if that is anything; else all."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    n = F.size(x)
    a, b = (F.least(F.greatest(F.rint(t.cast("double") * rate).cast("int"), F.lit(0)), n) for t in (start, end))
    return F.when(b > a, F.slice(x, a + 1, F.greatest(b - a, F.lit(0)))).otherwise(x)


def duration(samples: Column, rate: Column) -> Column:
    """ARR05: seconds; 0 without a rate."""
    return F.coalesce(samples / F.nullif(rate.cast("double"), F.lit(0.0)), F.lit(0.0))


def mono(left: Column, right: Column | None, strategy: str) -> Column:
    """ARR06: one channel of two; the right falls back to the left."""
    if strategy == "mono_left" or right is None:
        return left
    if strategy == "mono_right":
        return F.coalesce(right, left)
    if strategy == "mono_mean":
        return F.coalesce(F.zip_with(left, right, lambda a, b: (a + b) / 2), left)
    raise ValueError(f"unknown channel strategy {strategy!r}")


def without_offset(x: Column) -> Column:
    """ARR07: less its mean."""
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def leveled(x: Column, mode: str) -> Column:
    """ARR08: by the peak or the root mean square."""
    if mode == "none":
        return x
    if mode == "peak":
        level = F.array_max(F.transform(x, F.abs))
    elif mode == "rms":
        level = F.sqrt(mean(x, lambda v: v * v))
    else:
        raise ValueError(f"unknown normalisation {mode!r}")
    return let(F.greatest(level, F.lit(EPS)), lambda m: F.transform(x, lambda v: v / m))


def fitted(x: Column, n: int) -> Column:
    """ARR11: cut or padded with zeros to n samples, one at least."""
    n = max(n, 1)
    return F.slice(F.concat(doubles(x), F.array_repeat(F.lit(0.0), n)), 1, n)


def frame_count(samples: Column, window: int, hop: int, n_fft: int = 0, center: bool = False) -> Column:
    """ARR14"""
    free = samples + (2 * (n_fft // 2) if center else 0) - window
    return F.when(free < 0, F.lit(0)).otherwise(1 + F.floor(free / hop)).cast("int")


def to_multiple(x: Column, multiple: int, value: float = 0.0) -> Column:
    """ARR15: padded to the next multiple of a length."""
    return F.concat(doubles(x), F.array_repeat(F.lit(value), F.pmod(-F.size(x), F.lit(multiple)).cast("int")))


def framed(x: Column, length: int, hop: int) -> Column:
    """WIN12: whole frames, without padding at the end."""
    count = frame_count(F.size(x), length, hop)
    none = F.array().cast("array<array<double>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.slice(doubles(x), k * hop + 1, F.lit(length)))).otherwise(none)


def smoothed(x: Column, share: float) -> Column:
    """WIN10: m[0] = x[0], m[t] = (1 - s) m[t-1] + s x[t]."""
    start = F.array().cast("array<double>")
    step = lambda done, v: F.concat(done, F.array(F.coalesce((1 - share) * F.try_element_at(done, F.lit(-1)) + share * v, v)))
    return F.aggregate(doubles(x), start, step)


def hz_to_mel(f: Column) -> Column:
    """FE14"""
    return 1127.0 * F.log1p(f / 700.0)


def mel_to_hz(m: Column) -> Column:
    """FE14"""
    return 700.0 * (F.exp(m / 1127.0) - 1.0)


def log_compressed(x: Column, kind: str = "log", *, amin: float = 1e-10, offset: float = 0.0, ref: float | str = 1.0, top_db: float | None = None) -> Column:
    """FE06: log, log10 or decibels with an optional range below the peak."""
    floor = F.transform(x, lambda v: F.greatest(v.cast("double"), F.lit(amin)))
    if kind == "log":
        return F.transform(floor, lambda v: F.log(v + offset))
    if kind == "log10":
        return F.transform(floor, lambda v: F.log10(v + offset))
    if kind == "db":
        unit = F.greatest(F.array_max(floor), F.lit(1e-30)) if ref == "max" else F.lit(float(ref))
        db = let(unit, lambda u: F.transform(floor, lambda v: 10.0 * F.log10(v / u)))
        return db if top_db is None else let(db, lambda y: let(F.array_max(y) - top_db, lambda low: F.transform(y, lambda v: F.greatest(v, low))))
    raise ValueError(f"unknown compression {kind!r}")


def pcen(x: Column, *, share: float = 0.025, alpha: float = 0.98, delta: float = 2.0, r: float = 0.5, eps: float = 1e-6, amin: float = 1e-10) -> Column:
    """FE07: per-channel energy normalisation of one band over time."""
    floor = F.transform(x, lambda v: F.greatest(v.cast("double"), F.lit(amin)))
    return F.zip_with(floor, smoothed(floor, share), lambda v, m: F.greatest(F.pow(v / F.pow(eps + m, F.lit(alpha)) + delta, F.lit(r)) - delta**r, F.lit(0.0)))


def normalised(x: Column, mode: str, *, mean_value: float = 0.0, std: float = 1.0, eps: float = 1e-5, scale: float = 1.0, bias: float = 0.0) -> Column:
    """FE13: by given moments, by the array's own, or an affine map."""
    if mode == "none":
        return x
    if mode in ("dataset_mean_std", "checkpoint_mean_std"):
        return F.transform(x, lambda v: (v - mean_value) / (std + eps))
    if mode in ("per_clip_mean_std", "per_frequency_mean_std", "kaldi_cmvn"):
        spread = lambda m: F.sqrt(mean(x, lambda v: (v - m) * (v - m)) + eps)
        return let(mean(x), lambda m: let(spread(m), lambda s: F.transform(x, lambda v: (v - m) / s)))
    if mode == "affine":
        return F.transform(x, lambda v: v * scale + bias)
    raise ValueError(f"unknown normalisation {mode!r}")


def gain(x: Column, db: Column | float) -> Column:
    """WA01"""
    db = db if isinstance(db, Column) else F.lit(db)
    return F.transform(x, lambda v: v * F.pow(F.lit(10.0), db / 20.0))


def rolled(x: Column, shift: Column) -> Column:
    """WA02, SA02: circular, to the right for positive shifts."""
    n = F.size(x)
    k = F.pmod(shift, F.greatest(n, F.lit(1))).cast("int")
    return F.when(n > 0, F.concat(F.slice(x, n - k + 1, k), F.slice(x, 1, n - k))).otherwise(x)


def shifted(x: Column, shift: Column, value: float = 0.0) -> Column:
    """WA02: what moves out is lost, what moves in is ``value``."""
    n = F.size(x)
    k = F.least(F.abs(shift), n).cast("int")
    empty = F.array_repeat(F.lit(value), k)
    return F.when(shift > 0, F.concat(empty, F.slice(doubles(x), 1, n - k))).otherwise(F.concat(F.slice(doubles(x), k + 1, n - k), empty))


def clipped(x: Column, limit: Column | float) -> Column:
    """WA06, AC06"""
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.transform(x, lambda v: F.greatest(F.least(v, limit), -limit))


def inverted(x: Column) -> Column:
    """WA05"""
    return F.transform(x, lambda v: -v)


def compressed(x: Column, threshold_db: float, ratio: float) -> Column:
    """WA07, AC07: what a sample is over the threshold, in decibels, is divided by the ratio."""

    def one(v: Column) -> Column:
        over = 20.0 * F.log10(F.abs(v) + EPS) - threshold_db
        return v * F.pow(F.lit(10.0), F.when(over > 0, over / ratio - over).otherwise(F.lit(0.0)) / 20.0)

    return F.transform(x, one)


def quantised(v: Column, levels: int) -> Column:
    """A sample of -1 to 1 on the nearest of evenly spaced levels."""
    v = F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0))
    return F.rint((v + 1.0) * 0.5 * (levels - 1)) / (levels - 1) * 2.0 - 1.0


def mu_law(x: Column, levels: int, mu: float | None = None) -> Column:
    """WA10 (256 levels, mu 255), AC03 (mu: one less than the levels): companded, quantised, expanded."""
    mu = float(max(levels - 1, 1)) if mu is None else mu
    top = math.log1p(mu)

    def one(v: Column) -> Column:
        v = F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(-1.0))
        step = quantised(F.signum(v) * F.log1p(mu * F.abs(v)) / top, levels)
        return F.signum(step) * F.expm1(F.abs(step) * top) / mu

    return F.transform(x, one)


def smoothing_codec(x: Column) -> Column:
    """WA10: a three-tap filter, then 128 levels, in place of a perceptual codec."""
    return F.transform(fir(x, (0.2, 0.6, 0.2)), lambda v: quantised(v, 128))


def a_law(x: Column, levels: int = 256, a: float = 87.6) -> Column:
    """WA10"""
    d = 1.0 + math.log(a)

    def one(v: Column) -> Column:
        v = F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(-1.0))
        m = F.abs(v)
        inner = F.signum(v) * F.when(m < 1.0 / a, a * m / d).otherwise((1.0 + F.log(a * F.greatest(m, F.lit(EPS)))) / d)
        step = quantised(inner, levels)
        y = F.abs(step)
        return F.signum(step) * F.when(y < 1.0 / d, y * d / a).otherwise(F.exp(y * d - 1.0) / a)

    return F.transform(x, one)


def fir(x: Column, taps: tuple[float, ...]) -> Column:
    """AC05: a symmetric filter of odd length; samples outside are 0."""
    half = len(taps) // 2

    def at(v: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, h in enumerate(taps):
            j = i + half - k
            total = total + F.coalesce(F.when(j >= 0, F.get(x, j)), F.lit(0.0)) * h
        return total

    return F.transform(x, at)


def with_gaps(x: Column, samples: int, share: float, seed: int, position: Column) -> Column:
    """AC11: whole stretches of ``samples`` set to 0, each with probability ``share``; one if none would be."""
    n = F.greatest(F.ceil(F.size(x) / samples).cast("int"), F.lit(1))
    gone = lambda k: draw(seed, position, k.cast("long")) < share
    some = F.exists(F.sequence(F.lit(0), n - 1), gone)
    one = F.floor(draw(seed, position, "one") * n)
    alone = F.when(~some, one).otherwise(F.lit(-1))
    return let(alone, lambda k: F.transform(x, lambda v, i: F.when(gone(F.floor(i / samples)) | (F.floor(i / samples) == k), F.lit(0.0)).otherwise(v.cast("double"))))


def maybe(x: Column, y: Column, probability: float, seed: int, position: Column) -> Column:
    """FLT10: ``y`` with the given probability, else ``x``."""
    if probability <= 0:
        return x
    return y if probability >= 1 else F.when(draw(seed, position, "gate") < probability, y).otherwise(x)

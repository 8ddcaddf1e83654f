"""Waveforms [time, channels] and spectrograms [time, frequency, channels].

ARR01, ARR03, ARR09-13, ARR16, ARR17, FE01-12, FE15, FE16, WA01-10, SA01-08, BA03, BA04, AC01-11.
"""

from __future__ import annotations

import io
import wave
from dataclasses import dataclass, replace

import numpy as np

EPS = 1e-8
# Corruption parameters by severity 1 to 5.
NOISE_SNR = (30.0, 20.0, 10.0, 5.0, 0.0)
BACKGROUND_SNR = (25.0, 18.0, 12.0, 6.0, 0.0)
MU_LEVELS = (256, 128, 64, 32, 16)
INTERMEDIATE_HZ = (24000, 16000, 12000, 8000, 4000)
DEVICE_TAPS = ((0.02, 0.08, 0.80, 0.08, 0.02), (0.04, 0.12, 0.68, 0.12, 0.04), (0.08, 0.16, 0.52, 0.16, 0.08), (0.12, 0.20, 0.36, 0.20, 0.12), (0.16, 0.22, 0.24, 0.22, 0.16))
CLIP_AT = (0.95, 0.8, 0.6, 0.4, 0.25)
COMPRESS_DB = (-3.0, -6.0, -12.0, -18.0, -24.0)
COMPRESS_RATIO = (1.5, 2.0, 4.0, 8.0, 12.0)
BAND_PASS = ((80.0, 14000.0), (120.0, 10000.0), (200.0, 7000.0), (400.0, 5000.0), (800.0, 3500.0))
LOW_PASS = (12000.0, 9000.0, 6000.0, 4000.0, 2500.0)
HIGH_PASS = (40.0, 120.0, 400.0, 1000.0, 2500.0)
TILT_DB = (-1.0, -2.0, -4.0, -6.0, -9.0)
RT60 = (0.15, 0.3, 0.5, 0.8, 1.2)
STRETCH = (1.02, 1.05, 1.10, 1.20, 1.35)
SEMITONES = (0.5, 1.0, 2.0, 3.0, 4.0)
DROP_SHARE = (0.01, 0.025, 0.05, 0.10, 0.20)
DROP_MS = (5.0, 10.0, 20.0, 30.0, 50.0)


def rng_of(*key: int) -> np.random.Generator:
    """A generator that depends on its key alone."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([int(k) & (2**63 - 1) for k in key])))


def tc(x: np.ndarray, dtype: type = np.float32) -> np.ndarray:
    x = np.asarray(x, dtype)
    if x.ndim == 1:
        x = x[:, None]
    if x.ndim != 2:
        raise ValueError("a waveform has one or two dimensions")
    return x


# --- decoding and layout


def decode_wav(data: bytes, channels: int | None = None) -> tuple[np.ndarray, int]:
    """ARR01: PCM bytes to [time, channels] in -1..1, and the rate."""
    with wave.open(io.BytesIO(data)) as f:
        n, width, rate = f.getnchannels(), f.getsampwidth(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24).astype(np.float64) / 2147483648).astype(np.float32)
    else:
        x = (np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))).astype(np.float32)
    x = x.reshape(-1, n)
    if channels is not None and channels != n:
        x = x[:, :channels] if channels < n else np.pad(x, ((0, 0), (0, channels - n)))
    return x, rate


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    x, out = tc(x), io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(x.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def standard_layout(x: np.ndarray, hint: str = "auto") -> np.ndarray:
    """ARR03: [time, channels]; a short first dimension before a long one is taken for channels."""
    x = np.asarray(x)
    if x.ndim == 1:
        return x[:, None]
    if x.ndim != 2 or hint not in ("auto", "tc", "ct"):
        raise ValueError("a waveform has one or two dimensions, in order auto, tc or ct")
    return x.T if hint == "ct" or hint == "auto" and x.shape[0] <= 8 < x.shape[1] else x


def layout(x: np.ndarray, wanted: str) -> np.ndarray:
    """ARR16: without the batch: t, tc for waveforms; tf, ft, cft, tfc for features."""
    x = np.asarray(x)
    if x.ndim == 2:
        return {"t": lambda: x[:, 0] if x.shape[1] == 1 else x.mean(1), "tc": lambda: x}[wanted]()
    one = lambda: x[..., 0] if x.shape[2] == 1 else x.mean(2)
    return {"tf": one, "ft": lambda: one().T, "cft": lambda: x.transpose(2, 1, 0), "tfc": lambda: x}[wanted]()


def as_dtype(x: np.ndarray, kind: str) -> np.ndarray:
    """ARR17: values as the type holds them, in 32 bits; bfloat16 rounds to nearest even."""
    x = np.asarray(x, np.float32)
    if kind == "float16":
        return x.astype(np.float16).astype(np.float32)
    if kind == "bfloat16":
        bits = x.view(np.uint32)
        return ((bits + 0x7FFF + (bits >> 16 & 1)) & np.uint32(0xFFFF0000)).view(np.float32)
    if kind != "float32":
        raise ValueError(f"unknown dtype {kind!r}")
    return x


def fit_length(x: np.ndarray, n: int) -> np.ndarray:
    """ARR11"""
    n = max(int(n), 1)
    x = x[:n]
    return np.pad(x, [(0, n - len(x))] + [(0, 0)] * (x.ndim - 1))


def resize_matrix(source: int, target: int, antialias: bool = True) -> np.ndarray:
    """[target, source] weights of a triangle kernel with half-pixel centres, widened when shrinking."""
    scale = target / source
    support = max(1.0, 1.0 / scale) if antialias else 1.0
    centre = (np.arange(target) + 0.5) / scale - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(source)[None] - centre[:, None]) / support)
    if not antialias:
        low = np.clip(np.floor(centre), 0, source - 1).astype(int)
        high, t = np.minimum(low + 1, source - 1), np.clip(centre, 0, source - 1)
        w = np.zeros((target, source))
        np.add.at(w, (np.arange(target), low), 1 - (t - low))
        np.add.at(w, (np.arange(target), high), t - low)
    return w / w.sum(1, keepdims=True)


def resize_time(x: np.ndarray, n: int) -> np.ndarray:
    """Triangle-kernel resampling over the first axis, in pieces so that memory stays bounded."""
    source, n = len(x), max(int(n), 1)
    if n == source:
        return x
    scale = n / source
    support = max(1.0, 1.0 / scale)
    half = int(np.ceil(support))
    out = np.empty((n, *x.shape[1:]), np.float32)
    for at in range(0, n, 65536):
        centre = (np.arange(at, min(n, at + 65536)) + 0.5) / scale - 0.5
        taps = np.floor(centre)[:, None].astype(np.int64) + np.arange(-half, half + 1)
        w = np.maximum(0, 1 - np.abs(taps - centre[:, None]) / support) * ((taps >= 0) & (taps < source))
        w /= w.sum(1, keepdims=True)
        out[at : at + len(centre)] = np.einsum("nk,nk...->n...", w, x[np.clip(taps, 0, source - 1)])
    return out


def resample(x: np.ndarray, rate: int, target: int, method: str = "triangle") -> np.ndarray:
    """ARR10: to round(n * target / rate) samples. ``identity`` demands equal rates; others need packages that are absent."""
    if method in ("hf_audio", "identity"):
        if rate != target:
            raise ValueError(f"{method} expects audio at {target} Hz, not {rate}")
        return x
    if method in ("soxr", "kaiser_best"):
        raise ImportError(f"resampling by {method} needs an optional package that is not installed")
    if method not in ("triangle", "tensorflow"):
        raise ValueError(f"unknown resampling method {method!r}")
    return x if rate == target else resize_time(tc(x), max(1, int(np.rint(len(x) * target / rate))))


def preprocess(x: np.ndarray, rate: int, *, target: int, channels: str = "mono_mean", dc: bool = False, level: str = "none", clip: float | None = None, hint: str = "auto", method: str = "triangle") -> np.ndarray:
    """ARR09: layout, rate, channels, offset, level, clipping."""
    x = resample(standard_layout(np.asarray(x, np.float32), hint), rate, target, method)
    if channels == "mono_mean":
        x = x.mean(1, keepdims=True)
    elif channels in ("mono_left", "mono_right"):
        x = x[:, :1] if channels == "mono_left" or x.shape[1] == 1 else x[:, 1:2]
    elif channels != "keep":
        raise ValueError(f"unknown channel strategy {channels!r}")
    if dc:
        x = x - x.mean(0, keepdims=True)
    if level == "peak":
        x = x / max(np.abs(x).max(initial=0), EPS)
    elif level == "rms":
        x = x / max(np.sqrt(np.mean(x**2)) if x.size else 0, EPS)
    elif level != "none":
        raise ValueError(f"unknown normalisation {level!r}")
    return np.clip(x, -clip, clip) if clip is not None else x


# --- frontends


@dataclass(frozen=True)
class Stft:
    n_fft: int = 1024
    window: int = 1024
    hop: int = 320
    kind: str = "hann"
    periodic: bool = True
    center: bool = True
    pad: str = "reflect"
    power: float = 2.0
    normalized: bool = False
    onesided: bool = True
    rate: int = 32000


@dataclass(frozen=True)
class Mel:
    bins: int = 64
    low: float = 0.0
    high: float | None = None
    bank: str = "htk"
    norm: str = "none"


def window_of(s: Stft, n: int) -> np.ndarray:
    m = s.window + (1 if s.periodic else 0)
    t = np.arange(s.window) * 2 * np.pi / max(m - 1, 1)
    shapes = {"rectangular": np.ones(s.window), "hann": 0.5 - 0.5 * np.cos(t), "hamming": 0.54 - 0.46 * np.cos(t)}
    w = shapes["hann"] ** 0.85 if s.kind == "povey" else shapes[s.kind]
    left = (n - s.window) // 2
    return np.pad(w, (left, n - s.window - left))


def frames(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """WIN12: [frames, length, channels], without padding at the end."""
    if len(x) < length:
        return np.empty((0, length, x.shape[1]), x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, length, axis=0)[::hop].transpose(0, 2, 1)


def power_spectrogram(x: np.ndarray, s: Stft, *, emphasis: float = 0.0, frame: int | None = None, dtype: type = np.float32) -> np.ndarray:
    """FE02: [time, bins, channels]."""
    x = tc(x, dtype)
    if emphasis:
        x = x[1:] - dtype(emphasis) * x[:-1]
    if s.center and s.n_fft > 1:
        half = s.n_fft // 2
        x = np.pad(x, ((half, half), (0, 0)), mode="reflect" if s.pad == "reflect" and len(x) > half else "constant")
    n = frame or s.window
    f = frames(x, n, s.hop) * window_of(s, n)[None, :, None]
    spectrum = np.fft.rfft(f, s.n_fft, axis=1)
    if s.normalized:
        spectrum = spectrum / np.sqrt(s.window)
    magnitude = np.abs(spectrum)
    out = magnitude if s.power == 1 else magnitude**2 if s.power == 2 else np.maximum(magnitude, 1e-10) ** s.power
    if not s.onesided:
        mirror = out[:, 1:-1] if s.n_fft % 2 == 0 else out[:, 1:]
        out = np.concatenate([out, mirror[:, ::-1]], 1)
    return out.astype(dtype)


def hz_to_mel(f):
    """FE14"""
    return 1127.0 * np.log1p(np.asarray(f, np.float64) / 700.0)


def mel_to_hz(m):
    return 700.0 * np.expm1(np.asarray(m, np.float64) / 1127.0)


def _slaney(f):
    f = np.asarray(f, np.float64)
    return np.where(f < 1000, 3 * f / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))


def _slaney_hz(m):
    m = np.asarray(m, np.float64)
    return np.where(m < 15, 200 * m / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


def mel_bank(s: Stft, m: Mel, dtype: type = np.float32) -> np.ndarray:
    """FE04: [bins, mel]. Banks: htk (triangles in mel), hertz (triangles in Hz), slaney, no_nyquist (hertz without the last bin)."""
    n, top = s.n_fft // 2 + 1, s.rate / 2 if m.high is None else m.high
    if top > s.rate / 2:
        raise ValueError("the bank ends above half the rate")
    freq = np.linspace(0, s.rate / 2, n)
    if m.bank == "htk":
        edges, at = np.linspace(hz_to_mel(m.low), hz_to_mel(top), m.bins + 2), hz_to_mel(freq)
    elif m.bank == "slaney":
        edges, at = _slaney_hz(np.linspace(_slaney(m.low), _slaney(top), m.bins + 2)), freq
    elif m.bank in ("hertz", "no_nyquist"):
        edges, at = mel_to_hz(np.linspace(hz_to_mel(m.low), hz_to_mel(top), m.bins + 2)), freq
    else:
        raise ValueError(f"unknown mel bank {m.bank!r}")
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    w = np.maximum(0, np.minimum((at[:, None] - low) / np.maximum(mid - low, 1e-12), (high - at[:, None]) / np.maximum(high - mid, 1e-12)))
    if m.bank == "htk":
        w[0] = 0  # the constant bin belongs to no band
    if m.bank == "no_nyquist":
        w[-1] = 0
    if m.norm == "slaney":
        w = w * (2.0 / (edges[2:] - edges[:-2]))
    return w.astype(dtype)


def mel_spectrogram(x: np.ndarray, s: Stft, m: Mel, *, dtype: type = np.float32, **options) -> np.ndarray:
    """FE05: [time, mel, channels]."""
    if not s.onesided:
        raise ValueError("mel bands need a one-sided spectrum")
    return np.einsum("tfc,fm->tmc", power_spectrogram(x, s, dtype=dtype, **options), mel_bank(s, m, dtype))


@dataclass(frozen=True)
class Log:
    kind: str = "log"
    amin: float = 1e-10
    offset: float = 0.0
    ref: float | str = 1.0
    top_db: float | None = None
    smooth: float = 0.025
    alpha: float = 0.98
    delta: float = 2.0
    r: float = 0.5
    eps: float = 1e-6


def compress(x: np.ndarray, c: Log, dtype: type = np.float32) -> np.ndarray:
    """FE06, FE07"""
    floor = np.maximum(np.asarray(x, dtype), c.amin)
    if c.kind == "log":
        return np.log(floor + c.offset)
    if c.kind == "log10":
        return np.log10(floor + c.offset)
    if c.kind == "db":
        db = 10 * np.log10(floor / (max(floor.max(initial=0), 1e-30) if c.ref == "max" else c.ref))
        return db if c.top_db is None or not db.size else np.maximum(db, db.max() - c.top_db)
    if c.kind == "pcen":
        m = np.empty_like(floor)
        for t in range(len(floor)):  # a recursion over time, all bands at once
            m[t] = floor[0] if t == 0 else (1 - c.smooth) * m[t - 1] + c.smooth * floor[t]
        return np.maximum((floor / (c.eps + m) ** c.alpha + c.delta) ** c.r - c.delta**c.r, 0)
    raise ValueError(f"unknown compression {c.kind!r}")


@dataclass(frozen=True)
class Norm:
    kind: str = "none"
    mean: tuple[float, ...] | float = 0.0
    std: tuple[float, ...] | float = 1.0
    eps: float = 1e-5
    scale: float = 1.0
    bias: float = 0.0
    axes: tuple[str, ...] = ()


def _along(x: np.ndarray, v) -> np.ndarray:
    v = np.asarray(v, x.dtype)
    if v.size == 1:
        return v.reshape(-1)[0]
    if x.ndim == 3 and v.size == x.shape[1]:
        return v[None, :, None]
    if v.size == x.shape[-1]:
        return v
    raise ValueError(f"{v.size} values fit no axis of {x.shape}")


def normalise(x: np.ndarray, n: Norm, dtype: type = np.float32) -> np.ndarray:
    """FE13"""
    x = np.asarray(x, dtype)
    if n.kind == "none":
        return x
    if n.kind in ("dataset_mean_std", "checkpoint_mean_std"):
        return (x - _along(x, n.mean)) / (_along(x, n.std) + dtype(n.eps))
    if n.kind == "affine":
        return x * n.scale + n.bias
    names = {"time": 0, "frequency": 1, "channel": 2} if x.ndim == 3 else {"time": 0, "channel": 1}
    default = {"per_clip_mean_std": tuple(names), "per_frequency_mean_std": ("time",), "kaldi_cmvn": ("time",)}
    if n.kind not in default:
        raise ValueError(f"unknown normalisation {n.kind!r}")
    axes = tuple(names[a] for a in (n.axes if n.axes and n.kind != "per_frequency_mean_std" else default[n.kind]))
    return (x - x.mean(axes, keepdims=True)) / np.sqrt(x.var(axes, keepdims=True) + n.eps)


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi / n * (k[None] + 0.5) * k[:, None]) * np.sqrt(2.0 / n)


def mfcc(x: np.ndarray, s: Stft, m: Mel, count: int, c: Log = Log(amin=1e-6), dtype: type = np.float32) -> np.ndarray:
    """FE10: the first ``count`` cosine coefficients of log-mel bands."""
    return np.einsum("tmc,km->tkc", compress(mel_spectrogram(x, s, m, dtype=dtype), c, dtype), dct_matrix(m.bins))[:, :count]


def kaldi_fbank(x: np.ndarray, s: Stft, m: Mel, c: Log = Log(amin=1e-6), dtype: type = np.float32) -> np.ndarray:
    """FE09"""
    return compress(mel_spectrogram(x, s, replace(m, bank="hertz"), dtype=dtype), c, dtype)


def clip_fbank(x: np.ndarray, s: Stft, m: Mel, dtype: type = np.float32) -> np.ndarray:
    """FE11: clip and frame means removed, pre-emphasis, a window that is not periodic, mel triangles from 20 Hz."""
    size = 1 << (s.window - 1).bit_length()
    if s.n_fft != size:
        raise ValueError("n_fft must be the next power of two of the window")
    x = tc(x, dtype)[:, :1]
    f = frames(x - x.mean(), s.window, s.hop)[:, :, 0]
    f = f - f.mean(1, keepdims=True)
    f = f - dtype(0.97) * np.concatenate([f[:, :1], f[:, :-1]], 1)
    f = f * np.hanning(s.window)
    power = np.abs(np.fft.rfft(f, size, axis=1)) ** 2
    low = m.low or 20.0
    edges = np.linspace(hz_to_mel(low), hz_to_mel(m.high or s.rate / 2), m.bins + 2)
    at = hz_to_mel(np.arange(size // 2) * s.rate / size)[:, None]
    w = np.maximum(0, np.minimum((at - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - at) / (edges[2:] - edges[1:-1])))
    return np.log(np.maximum(power[:, :-1] @ w, 1.1920928955078125e-07)).astype(dtype)[:, :, None]


def emphasised_logmel(x: np.ndarray, s: Stft, m: Mel, dtype: type = np.float32) -> np.ndarray:
    """FE12: pre-emphasis, frames of n_fft, a bank without the last bin, log(x + 1e-5), mapped to about -1..1."""
    got = mel_spectrogram(x, s, replace(m, bank="no_nyquist"), emphasis=0.97, frame=s.n_fft, dtype=dtype)
    return np.log(got + 1e-5) * dtype(0.2) + dtype(0.9)


def frontend(x: np.ndarray, name: str, s: Stft = Stft(), m: Mel = Mel(), c: Log = Log(), n: Norm = Norm(), count: int = 40, dtype: type = np.float32) -> np.ndarray:
    """FE01-12 by name, then FE13; worked out and returned in ``dtype``."""
    make = {
        "raw_waveform": lambda: tc(x, dtype),
        "stft_magnitude": lambda: power_spectrogram(x, s, dtype=dtype),
        "mel_power": lambda: mel_spectrogram(x, s, m, dtype=dtype),
        "logmel": lambda: compress(mel_spectrogram(x, s, m, dtype=dtype), c, dtype),
        "kaldi_fbank": lambda: kaldi_fbank(x, s, m, c, dtype),
        "mfcc": lambda: mfcc(x, s, m, count, c, dtype),
        "ast_kaldi_fbank": lambda: clip_fbank(x, s, m, dtype),
        "efficientat_logmel": lambda: emphasised_logmel(x, s, m, dtype),
    }
    if name not in make:
        raise ValueError(f"unknown frontend {name!r}")
    return normalise(make[name](), n, dtype)


def fit_frames(x: np.ndarray, frames_wanted: int) -> np.ndarray:
    """ARR15, FE15"""
    x = x[:frames_wanted]
    return np.pad(x, [(0, frames_wanted - len(x))] + [(0, 0)] * (x.ndim - 1))


def fbank_for_model(x: np.ndarray, frames_wanted: int, mean: float, std: float, *, training: bool = False, freq_mask: int = 0, time_mask: int = 0, noise: bool = False, key: tuple = (0,)) -> np.ndarray:
    """FE15: fitted, masked in training, (x - mean) / (2 std), with noise and a roll of up to ten frames if asked."""
    x, rng = fit_frames(x, frames_wanted), rng_of(*key)
    if training and freq_mask:
        x = mask_axis(x, 1, freq_mask, rng)
    if training and time_mask:
        x = mask_axis(x, 0, time_mask, rng)
    x = (x - mean) / (2 * std)
    if training and noise:
        x = np.roll(x + rng.random(x.shape) * rng.random() / 10, int(rng.integers(-10, 10)), 0)
    return x.astype(np.float32)


def mix_waveforms(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """FE16: both less their means, the partner fitted to the first; the result less its mean."""
    x = tc(x) - tc(x).mean()
    y = fit_length(tc(y) - tc(y).mean(), len(x))
    z = share * x + (1 - share) * y
    return z - z.mean()


# --- noise, filters


def unit_noise(x: np.ndarray) -> np.ndarray:
    x = x - x.mean()
    return x / max(float(np.sqrt(np.mean(x**2))), EPS)


def coloured_noise(shape: tuple[int, int], kind: str, rng) -> np.ndarray:
    """ARR13, WIN11"""
    x = rng.standard_normal(shape)
    if kind == "brown":
        x = np.cumsum(x, 0)
    elif kind == "pink":
        spectrum = np.fft.rfft(x, axis=0)
        f = np.arange(len(spectrum), dtype=float)
        spectrum *= np.where(f > 0, 1 / np.sqrt(np.maximum(f, 1)), 0)[:, None]
        x = np.fft.irfft(spectrum, shape[0], axis=0)
    elif kind != "white":
        raise ValueError(f"unknown noise {kind!r}")
    return unit_noise(x)


def at_snr(x: np.ndarray, noise: np.ndarray, db: float) -> np.ndarray:
    """ARR13"""
    down = float(np.mean(noise**2)) * 10 ** (db / 10)
    return x + noise * (np.sqrt(np.mean(x**2) / down) if down > 0 else 0.0)


def convolve(x: np.ndarray, ir: np.ndarray, compensate: bool = False) -> np.ndarray:
    """ARR12"""
    start = int(np.argmax(np.abs(ir))) if compensate else (len(ir) - 1) // 2
    n = len(x) + len(ir) - 1
    size = 1 << max(n - 1, 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size, axis=0) * np.fft.rfft(ir, size)[:, None], size, axis=0)[:n]
    return fit_length(full[start:], len(x)).astype(np.float32)


def spectral_gain(x: np.ndarray, gain) -> np.ndarray:
    n = len(x)
    return np.fft.irfft(np.fft.rfft(x, axis=0) * gain(n)[:, None], n, axis=0).astype(np.float32)


def _bins(n: int, rate: int) -> np.ndarray:
    return np.arange(n // 2 + 1) * rate / n


def compress_level(x: np.ndarray, threshold: float, ratio: float) -> np.ndarray:
    over = 20 * np.log10(np.abs(x) + EPS) - threshold
    return x * 10 ** (np.where(over > 0, over / ratio - over, 0) / 20)


def quantise(x: np.ndarray, levels: int) -> np.ndarray:
    return np.rint((np.clip(x, -1, 1) + 1) * 0.5 * (levels - 1)) / (levels - 1) * 2 - 1


def mu_law(x: np.ndarray, levels: int, mu: float | None = None) -> np.ndarray:
    mu = max(levels - 1, 1) if mu is None else mu
    step = quantise(np.sign(x) * np.log1p(mu * np.abs(x)) / np.log1p(mu), levels)
    return np.sign(step) * np.expm1(np.abs(step) * np.log1p(mu)) / mu


def a_law(x: np.ndarray, levels: int = 256, a: float = 87.6) -> np.ndarray:
    d, m = 1 + np.log(a), np.abs(x)
    step = quantise(np.sign(x) * np.where(m < 1 / a, a * m / d, (1 + np.log(a * np.maximum(m, EPS))) / d), levels)
    y = np.abs(step)
    return np.sign(step) * np.where(y < 1 / d, y * d / a, np.exp(y * d - 1) / a)


def zero_shift(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    n = int(np.clip(n, -len(x), len(x)))
    if n >= 0:
        out[n:] = x[: len(x) - n]
    else:
        out[:n] = x[-n:]
    return out


# --- waveform augmentations: each takes (waveform, rate, generator, options)


def _gain(x, rate, rng, min_db=-12.0, max_db=12.0):
    return x * 10 ** (rng.uniform(min_db, max_db) / 20)


def _time_shift(x, rate, rng, max_shift_seconds=0.5, mode="roll", shift_samples=None):
    most = int(np.rint(max_shift_seconds * rate))
    n = int(rng.integers(-most, most + 1)) if shift_samples is None else shift_samples
    if mode not in ("roll", "zero"):
        raise ValueError(f"unknown shift {mode!r}")
    return np.roll(x, n, 0) if mode == "roll" else zero_shift(x, n)


def _crop(x, rate, rng, target_length=None, crop_duration=None):
    if target_length is None:
        if crop_duration is None:
            raise ValueError("a crop needs a length or a duration")
        target_length = max(int(np.rint(crop_duration * rate)), 1)
    start = int(rng.integers(0, max(len(x) - target_length, 0) + 1))
    return fit_length(x[start:], target_length)


def _noise(x, rate, rng, noise_kind="white", snr_db_min=5.0, snr_db_max=30.0):
    return at_snr(x, coloured_noise(x.shape, noise_kind, rng), rng.uniform(snr_db_min, snr_db_max))


def _clip(x, rate, rng, min_threshold=0.2, max_threshold=1.0):
    t = rng.uniform(min_threshold, max_threshold)
    return np.clip(x, -t, t)


def _compress(x, rate, rng, threshold_db_min=-30.0, threshold_db_max=-10.0, ratio_min=2.0, ratio_max=8.0):
    return compress_level(x, rng.uniform(threshold_db_min, threshold_db_max), rng.uniform(ratio_min, ratio_max))


def _reverb(x, rate, rng, rir=None, rir_dataset=None, normalize_ir=True, compensate_delay=True, taps=64):
    if rir_dataset is not None:
        raise NotImplementedError("impulse responses come from the caller or are synthetic")
    ir = np.asarray(rir, np.float32) if rir is not None else rng.standard_normal(taps) * np.exp(-np.arange(taps) / (taps / 6))
    if normalize_ir:
        ir = ir / max(float(np.sqrt((ir**2).sum())), EPS)
    return convolve(x, ir, compensate_delay)


def _speed(x, rate, rng, rates=(0.9, 1.0, 1.1)):
    r = rates[int(rng.integers(len(rates)))]
    return fit_length(resize_time(x, max(1, int(np.rint(len(x) / r)))), len(x))


def _codec(x, rate, rng, codec="mulaw", bitrate=None):
    if codec == "mulaw":
        return mu_law(np.clip(x, -1, 1), 256, 255.0)
    if codec == "alaw":
        return a_law(np.clip(x, -1, 1))
    if codec == "mp3_proxy":
        return quantise(convolve(x, np.array([0.2, 0.6, 0.2])), 128)
    raise ValueError(f"unknown codec {codec!r}")


#: name -> (kernel, probability)
WAVEFORM_AUGMENTS = {
    "random_gain": (_gain, 0.5),
    "time_shift": (_time_shift, 0.5),
    "random_crop": (_crop, 1.0),
    "additive_noise": (_noise, 0.5),
    "colored_noise": (lambda x, rate, rng, noise_kind="pink", **o: _noise(x, rate, rng, noise_kind, **o), 0.5),
    "polarity_inversion": (lambda x, rate, rng: -x, 0.5),
    "random_clipping": (_clip, 0.5),
    "dynamic_range_compression": (_compress, 0.5),
    "rir_convolution": (_reverb, 0.5),
    "speed_perturb": (_speed, 0.5),
    "codec_simulation": (_codec, 0.5),
}


def parsed(specs, table: dict) -> list[tuple[str, dict]]:
    """WA11, SA09, BA05: a name, a list of names, or mappings with a name and options."""
    out = []
    for s in [specs] if isinstance(specs, (str, dict)) else specs or []:
        name, options = (s, {}) if isinstance(s, str) else (s["name"], {k: v for k, v in s.items() if k != "name"})
        if name not in table:
            raise ValueError(f"unknown augmentation {name!r}")
        out.append((name, options))
    return out


def augment_waveform(x: np.ndarray, rate: int, specs, *, key: tuple, training: bool = True, augment_eval: bool = False) -> np.ndarray:
    """WA11: one after the other, each with draws of its own; nothing outside training."""
    x = tc(x)
    if not (training or augment_eval):
        return x
    for i, (name, options) in enumerate(parsed(specs, WAVEFORM_AUGMENTS)):
        f, p = WAVEFORM_AUGMENTS[name]
        options = dict(options)
        rng = rng_of(*key, i)
        if rng.random() < options.pop("prob", p):
            x = f(x, rate, rng, **options).astype(np.float32)
    return x


# --- spectrogram augmentations on [time, frequency, channels]


def _filled(x: np.ndarray, fill) -> float:
    return {"mean": lambda: float(x.mean()), "min": lambda: float(x.min())}[fill]() if isinstance(fill, str) else float(fill)


def mask_axis(x: np.ndarray, axis: int, most: int, rng, fill=0.0) -> np.ndarray:
    """SA01: a stretch of up to ``most`` places along an axis."""
    n = x.shape[axis]
    w = min(int(rng.integers(0, most + 1)), n)
    a = int(rng.integers(0, n - w + 1))
    out = x.copy()
    out[(slice(None),) * axis + (slice(a, a + w),)] = _filled(x, fill)
    return out


def _mel_shift(x, rng, max_bins=4, shift=None, zero_pad=True):
    n = int(rng.integers(-max_bins, max_bins + 1)) if shift is None else shift
    return np.moveaxis(zero_shift(np.moveaxis(x, 1, 0), n), 0, 1) if zero_pad else np.roll(x, n, 1)


def _erase(x, rng, max_time_width=32, max_freq_width=16, fill_value=0.0):
    out = x.copy()
    place = []
    for axis, most in ((0, max_time_width), (1, max_freq_width)):
        w = min(int(rng.integers(0, most + 1)), x.shape[axis])
        a = int(rng.integers(0, x.shape[axis] - w + 1))
        place.append(slice(a, a + w))
    out[tuple(place)] = _filled(x, fill_value)
    return out


def _equaliser(x, rng, num_bands=4, min_db=-6.0, max_db=6.0, min_band_width=1):
    n = x.shape[1]
    edges = np.sort(rng.choice(np.arange(1, n), min(num_bands - 1, n - 1), replace=False)) if n > 1 else np.array([], int)
    gain = np.concatenate([np.full(b - a, rng.uniform(min_db, max_db)) for a, b in zip([0, *edges], [*edges, n], strict=True)])
    return x + gain[None, :, None]


def patchout(x: np.ndarray, rng, n_freq: int = 0, n_time: int = 0, n_patches: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """SA07: whole rows of time and frequency left out, or single cells; the kept ones stay in order. Returns kept places too."""
    t, f = (np.sort(rng.permutation(n)[: max(n - gone, 1)]) for n, gone in ((x.shape[0], n_time), (x.shape[1], n_freq)))
    x = x[np.ix_(t, f)]
    if n_patches:
        flat = x.reshape(-1, x.shape[2])
        kept = np.sort(rng.permutation(len(flat))[: max(len(flat) - n_patches, 1)])
        return flat[kept], kept
    return x, t


SPECTROGRAM_AUGMENTS = {
    "frequency_mask": (lambda x, rng, max_width=16, fill_value=0.0: mask_axis(x, 1, max_width, rng, fill_value), 1.0),
    "time_mask": (lambda x, rng, max_width=32, fill_value=0.0: mask_axis(x, 0, max_width, rng, fill_value), 1.0),
    "spectrogram_time_roll": (lambda x, rng, max_shift=16, shift=None: np.roll(x, int(rng.integers(-max_shift, max_shift + 1)) if shift is None else shift, 0), 1.0),
    "mel_bin_shift": (_mel_shift, 1.0),
    "time_frequency_erasing": (_erase, 1.0),
    "random_eq": (_equaliser, 1.0),
    "passt_patchout": (lambda x, rng, n_freq_patches=0, n_time_patches=0, n_patches=0: patchout(x, rng, n_freq_patches, n_time_patches, n_patches)[0], 1.0),
}


def augment_spectrogram(x: np.ndarray, specs, *, key: tuple, training: bool = True, augment_eval: bool = False, order: str = "tfc") -> np.ndarray:
    """SA09, SA08: on [time, frequency, channels], given and returned as ``order`` says."""
    axes = [order.index(c) for c in "tfc" if c in order]
    y = np.transpose(np.asarray(x, np.float32), axes)
    y = y[..., None] if y.ndim == 2 else y
    if training or augment_eval:
        for i, (name, options) in enumerate(parsed(specs, SPECTROGRAM_AUGMENTS)):
            f, p = SPECTROGRAM_AUGMENTS[name]
            options = dict(options)
            rng = rng_of(*key, i)
            if rng.random() < options.pop("prob", p):
                y = f(y, rng, **options).astype(np.float32)
    if y.ndim < 3:
        return y
    y = y[..., 0] if "c" not in order else y
    return np.transpose(y, np.argsort(axes))


# --- batches [rows, time, frequency, channels]


def partner_order(n: int, rng) -> np.ndarray:
    """JOIN08"""
    p = rng.permutation(n)
    return np.roll(np.arange(n), -1) if n > 1 and (p == np.arange(n)).all() else p


def mix_style(x: np.ndarray, *, key: tuple, alpha: float = 0.1, over: str = "frequency") -> np.ndarray:
    """SA05, BA04: each row keeps its shape but takes moments between its own and its partner's."""
    axes = {"global": (1, 2, 3), "frequency": (1, 3), "channel": (1, 2)}[over]
    rng = rng_of(*key)
    mean, std = x.mean(axes, keepdims=True), np.sqrt(x.var(axes, keepdims=True) + 1e-6)
    p, share = partner_order(len(x), rng), rng.beta(alpha, alpha, (len(x), 1, 1, 1))
    return ((x - mean) / std * (share * std + (1 - share) * std[p]) + share * mean + (1 - share) * mean[p]).astype(np.float32)


def cut_mix(x: np.ndarray, y: np.ndarray, *, key: tuple, alpha: float = 1.0, axes: str = "both", events: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """BA03: a rectangle of the partner; labels by what is left, event frames by the frames that were taken."""
    rng = rng_of(*key)
    share, p = rng.beta(alpha, alpha), partner_order(len(x), rng)
    share = max(share, 1 - share)
    t, f = x.shape[1:3]
    cut = 1 - share
    h = int(np.rint(t * (cut if axes == "time" else np.sqrt(cut)))) if axes != "frequency" else t
    w = int(np.rint(f * (cut if axes == "frequency" else np.sqrt(cut)))) if axes != "time" else f
    a, b = int(rng.integers(0, t - h + 1)), int(rng.integers(0, f - w + 1))
    out = x.copy()
    out[:, a : a + h, b : b + w] = x[p][:, a : a + h, b : b + w]
    if events:
        labels = y.copy()
        n = y.shape[1]
        lo, hi = int(np.floor(a / t * n)), int(np.ceil((a + h) / t * n))
        labels[:, lo:hi] = y[p][:, lo:hi]
        return out, labels
    left = 1 - h * w / (t * f)
    return out, left * y + (1 - left) * y[p]


# --- corruptions: (waveform, severity, generator, rate)


def _background(x, k, rng, rate, clip=None):
    if clip is None:
        n = np.arange(len(x))[:, None]
        hum = np.sin(2 * np.pi * n / max(len(x), 1) * int(rng.integers(1, 9)))
        clip = coloured_noise(x.shape, "pink", rng) + 0.25 * hum
    return at_snr(x, unit_noise(fit_length(np.asarray(clip, np.float32).reshape(-1, 1), len(x))), BACKGROUND_SNR[k])


def _tilt(x, k, rng, rate):
    f = np.maximum(_bins(len(x), rate), 1.0)
    return spectral_gain(x, lambda n: np.clip(10 ** (TILT_DB[k] * np.log2(f / 1000.0) / 20), 0.125, 4.0))


def _band(low, high):
    def run(x, k, rng, rate):
        f = _bins(len(x), rate)
        return spectral_gain(x, lambda n: ((f >= (low[k] if low else 0)) & (f <= (high[k] if high else np.inf))).astype(float))

    return run


def _room(x, k, rng, rate, rir=None):
    if rir is None:
        n = min(max(int(RT60[k] * rate), 1), 4096)
        rir = rng.standard_normal(n) * np.exp(-6.907755 * np.arange(n) / (RT60[k] * rate))
        rir[0] = 1.0
        rir = rir / np.sqrt((rir**2).sum())
    return convolve(x, np.asarray(rir), True)


def _dropouts(x, k, rng, rate):
    n = max(int(np.rint(rate * DROP_MS[k] / 1000)), 1)
    count = max(-(-len(x) // n), 1)
    gone = rng.random(count) < DROP_SHARE[k]
    if not gone.any():
        gone[int(rng.integers(count))] = True
    return np.where(np.repeat(gone, n)[: len(x), None], 0, x)


CORRUPTIONS = {
    "additive_white_noise": lambda x, k, rng, rate: at_snr(x, coloured_noise(x.shape, "white", rng), NOISE_SNR[k]),
    "additive_pink_noise": lambda x, k, rng, rate: at_snr(x, coloured_noise(x.shape, "pink", rng), NOISE_SNR[k]),
    "additive_brown_noise": lambda x, k, rng, rate: at_snr(x, coloured_noise(x.shape, "brown", rng), NOISE_SNR[k]),
    "background_noise": _background,
    "codec_compression": lambda x, k, rng, rate: np.clip(mu_law(np.clip(x, -1, 1), MU_LEVELS[k]), -1, 1),
    "resampling_degradation": lambda x, k, rng, rate: fit_length(resize_time(resize_time(x, max(1, int(np.rint(len(x) * min(INTERMEDIATE_HZ[k] / 32000, 1))))), len(x)), len(x)),
    "device_ir": lambda x, k, rng, rate: convolve(x, np.array(DEVICE_TAPS[k])),
    "clipping": lambda x, k, rng, rate: np.clip(x, -CLIP_AT[k], CLIP_AT[k]),
    "dynamic_range_compression": lambda x, k, rng, rate: compress_level(x, COMPRESS_DB[k], COMPRESS_RATIO[k]),
    "low_pass": _band(None, LOW_PASS),
    "high_pass": _band(HIGH_PASS, None),
    "band_pass": _band([b[0] for b in BAND_PASS], [b[1] for b in BAND_PASS]),
    "equalization_tilt": _tilt,
    "reverb_rir": _room,
    "time_stretch": lambda x, k, rng, rate: fit_length(resize_time(x, int(np.rint(len(x) * STRETCH[k]))), len(x)),
    "pitch_shift": lambda x, k, rng, rate: fit_length(resize_time(x, int(np.rint(len(x) / 2 ** (SEMITONES[k] / 12)))), len(x)),
    "packet_dropout_gaps": _dropouts,
}


def corrupt(x: np.ndarray, name: str, severity: int, *, seed: tuple[int, int], rate: int, **config) -> np.ndarray:
    """AC12: a corruption by name at a severity from 1 to 5."""
    if isinstance(severity, bool) or not isinstance(severity, (int, np.integer)) or not 1 <= severity <= 5:
        raise ValueError("severity must be a whole number from 1 to 5")
    if name not in CORRUPTIONS:
        raise ValueError(f"unknown corruption {name!r}")
    return np.asarray(CORRUPTIONS[name](tc(x), int(severity) - 1, rng_of(*seed), rate, **config), np.float32)

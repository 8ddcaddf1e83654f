"""Dataset, pipeline and preset registries with the merge rule for defaults (CTL01-12, FE15, FE17-19)."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from tidemill.functions.hashing import digest_of
from tidemill.functions.strings import SCENES
from tidemill.kernels.signal import Log, Mel, Norm, Stft
from tidemill.sources.registry import Registry

DATASETS, PIPELINES, PRESETS = Registry("dataset"), Registry("pipeline"), Registry("preset")
#: CTL05, CTL06: components by kind.
COMPONENTS = {kind: Registry(kind) for kind in ("decoder", "resampler", "channel", "segment", "frontend", "waveform_augment", "spectrogram_augment", "batch_augment", "normalization", "eval_view", "postprocessor", "corruption", "crop", "augment")}


@dataclass(frozen=True)
class Dataset:
    """CTL01"""

    name: str
    task: str | None = None
    modality: str = "core"
    pipeline: str | None = None
    preset: str | None = None


def register_dataset(name: str, task: str | None = None, *, modality: str = "core", pipeline: str | None = None, preset: str | None = None) -> Dataset:
    return DATASETS.register(name, Dataset(name, task, modality, pipeline, preset))


def register_pipeline(name: str, resolver: Callable | None = None):
    """CTL02: a factory of four stages, and what states its configuration."""

    def register(factory):
        PIPELINES.register(name, (factory, resolver))
        return factory

    return register


def component(kind: str, name: str):
    """CTL05: decorator."""

    def register(f):
        COMPONENTS[kind].register(name, f)
        return f

    return register


def register_preset(name: str, config: dict, *, modality: str = "core") -> dict:
    """CTL03"""
    return PRESETS.register(f"{modality}/{name}", config)


def find_preset(name: str, modality: str) -> dict:
    """CTL03: exact, then the longest prefix, then the modality's default, then nothing."""
    got = PRESETS.resolve(f"{modality}/{name}")
    return got if got is not None else PRESETS.get(f"{modality}/_default", {})


def merged(user: dict, preset: dict, defaults: dict, overrides: dict | None = None) -> dict:
    """CTL03: the preset over the defaults, the user's values over both unless they equal the default; overrides win.

    A value that equals the default cannot be told from one that was not given, so the preset's holds there.
    """
    out = dict(defaults)
    for k, v in preset.items():
        out[k] = merged({}, v, defaults.get(k, {})) if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v
    for k, v in user.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(v, preset.get(k, {}) if isinstance(preset.get(k), dict) else {}, defaults.get(k, {}) if isinstance(defaults.get(k), dict) else {})
        elif k not in preset or v != defaults.get(k):
            out[k] = v
    for k, v in (overrides or {}).items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve_config(f: Callable, given: dict, path: str, omit: tuple[str, ...] = ()) -> dict:
    """CTL04: a callable's defaults with what is given; unknown names are errors."""
    known = {n: p for n, p in inspect.signature(f).parameters.items() if n not in omit}
    wild = any(p.kind is p.VAR_KEYWORD for p in known.values())
    if bad := set(given) - set(known):
        if not wild:
            raise ValueError(f"{path}: unknown {sorted(bad)}")
    return {n: p.default for n, p in known.items() if p.default is not p.empty} | given


@dataclass(frozen=True)
class Audio:
    """CTL07: everything that makes a model's input of a waveform."""

    rate: int = 32000
    seconds: float | None = None
    frontend: str = "logmel"
    stft: Stft = field(default_factory=Stft)
    mel: Mel = field(default_factory=Mel)
    log: Log = field(default_factory=Log)
    norm: Norm = field(default_factory=Norm)
    layout: str = "tfc"
    dtype: str = "float32"
    classes: int | None = None

    def __post_init__(self):
        if self.rate <= 0 or (self.seconds is not None and self.seconds <= 0):
            raise ValueError("rate and seconds must be positive")
        if self.stft.rate != self.rate:
            raise ValueError("the transform's rate is not the input's")

    def frames(self) -> int | None:
        """CTL12: the input's frames, as its length is fixed."""
        if self.seconds is None:
            return None
        n = round(self.seconds * self.rate) + (2 * (self.stft.n_fft // 2) if self.stft.center else 0) - self.stft.window
        return 0 if n < 0 else 1 + n // self.stft.hop

    def identity(self) -> str:
        from dataclasses import asdict

        return digest_of(asdict(self))


def _audio(rate: int, hop: int, window: int, n_fft: int, mel: Mel, frontend: str = "logmel", *, seconds: float | None = None, classes: int | None = None, log: Log = Log(), norm: Norm = Norm(), **stft) -> Audio:
    return Audio(rate, seconds, frontend, Stft(n_fft, window, hop, rate=rate, **stft), mel, log, norm, classes=classes)


# What published models take (CTL08, FE15, FE17, FE18).
CED = _audio(16000, 160, 512, 512, Mel(64, 0.0, 8000.0, "hertz"), log=Log("db", top_db=120.0), classes=527)
PANNS_16K = _audio(16000, 160, 512, 512, Mel(64, 50.0, 8000.0, "slaney", "slaney"), log=Log("db"), seconds=10.0, classes=527)
PANNS_32K = _audio(32000, 320, 1024, 1024, Mel(64, 50.0, 14000.0, "slaney", "slaney"), log=Log("db"), seconds=10.0, classes=527)
EMPHASISED = _audio(32000, 320, 800, 1024, Mel(128, 0.0, 15000.0, "no_nyquist"), "efficientat_logmel", seconds=10.0, classes=527, periodic=False)
#: Of each recipe: frames, frequency mask, time mask, mixing share, mean, deviation, noise, seconds, classes.
CLIP_RECIPES = {
    "audioset": (1024, 48, 192, 0.5, -4.2677393, 4.5689974, False, 10.0, 527),
    "esc50": (512, 24, 96, 0.0, -6.6268077, 5.358466, False, 5.0, 50),
    "speechcommands": (128, 48, 48, 0.6, -6.845978, 5.5654526, True, 1.0, 35),
}


def clip_preset(name: str) -> Audio:
    """FE15: (x - mean) / (2 std) of filter banks without centring."""
    _, _, _, _, mean, std, _, seconds, classes = CLIP_RECIPES[name]
    return _audio(16000, 160, 400, 512, Mel(128, 20.0), "ast_kaldi_fbank", seconds=seconds, classes=classes, norm=Norm("dataset_mean_std", mean, 2 * std, 0.0), center=False)


def scene_preset(base: Audio, seconds: float) -> Audio:
    """A model's frontend on recordings of scenes."""
    return Audio(base.rate, seconds, base.frontend, base.stft, base.mel, base.log, base.norm, base.layout, base.dtype, len(SCENES))


def _acoustic() -> dict[str, Audio]:
    out = {"audio_default_16k_waveform": Audio(16000, None, "raw_waveform", Stft(rate=16000))}
    for bins in (64, 128):
        out[f"audio_default_32k_logmel{bins}"] = _audio(32000, 320, 1024, 1024, Mel(bins))
        out[f"audioset_32k_10s_logmel{bins}"] = _audio(32000, 320, 800, 1024, Mel(bins, 0.0, 15000.0), seconds=10.0, classes=527)
    out["audioset_16k_10s_logmel64"] = _audio(16000, 160, 400, 400, Mel(64, 0.0, 8000.0), seconds=10.0, classes=527)
    out |= {f"ced_{size}_16k_logmel64": CED for size in ("tiny", "mini", "small", "base")}
    out |= {"panns_cnn14_32k_10s_logmel64": PANNS_32K, "panns_cnn14_16k_10s_logmel64": PANNS_16K}
    out |= {f"{model}_32k_10s_logmel128": EMPHASISED for model in ("efficientat", "dymn", "passt")}
    out |= {f"dcase2025_task1_{model}_32k_1s": scene_preset(EMPHASISED, 1.0) for model in ("efficientat", "dymn", "passt")}
    for model in ("efficientat", "passt"):  # one second padded or repeated to the ten that a model was trained on
        out |= {f"dcase2025_task1_{model}_32k_1s_{how}_to_10s": scene_preset(EMPHASISED, 10.0) for how in ("zero_pad", "repeat")}
    out["dcase2025_task1_ced_16k_1s"] = scene_preset(CED, 1.0)
    out |= {f"ast_{name}_16k_{CLIP_RECIPES[name][7]:.0f}s_fbank128": clip_preset(name) for name in CLIP_RECIPES}
    return out


for _name, _config in _acoustic().items():
    register_preset(_name, _config, modality="acoustic")

# Channel moments and recipes of image datasets (CTL09).
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
CIFAR10 = ((0.4914, 0.4822, 0.4465), (0.2023, 0.1994, 0.2010))
CIFAR100 = ((0.5071, 0.4867, 0.4408), (0.2675, 0.2565, 0.2761))


def image_preset(size: int, *, augment: dict | None = None, late: dict | None = None, post: dict | None = None, moments=IMAGENET) -> dict:
    """The four stages' options; what is not given is left to the stages' defaults."""
    return {"preprocess": {}, "augment": {"image_size": size, **(augment or {})}, "late": late or {}, "postprocess": {"image_size": size, "moments": moments, **(post or {})}}


def sampled_ops(magnitude: float, translate: float, cutout: float = 40.0) -> dict:
    return {"interpolation": "bicubic", "augment_type": "rand_augment", "rand_augment": {"layers": 2, "magnitude": magnitude, "cutout_const": cutout, "translate_const": translate}}


def mixing(mixup: float, erasing: float, **more) -> dict:
    return {"mixup_alpha": mixup, "cutmix_alpha": 1.0, "prob": 1.0, "switch_prob": 0.5, "random_erasing_prob": erasing, **more}


def multi_crop(size: int, scale: tuple[float, float], blur, solarize) -> dict:
    return {"size": size, "scale": scale, "brightness": 0.4, "contrast": 0.4, "saturation": 0.2, "hue": 0.1, "p_color_jitter": 0.8, "p_grayscale": 0.2, "p_gaussian_blur": blur, "p_solarize": solarize}


_CROP = {"crop_type": "random_pad", "padding": 4, "pad_mode": "CONSTANT", "augment_type": "trivial_augment_wide"}
_RXRX1 = {"enable": True, "crop_type": "random_rot90_hflip", "augment_type": "none"}
_VISION = {
    "_default": image_preset(224, augment=sampled_ops(9.0, 101.0), late=mixing(0.8, 0.25)),
    "cifar": image_preset(32, augment=_CROP, late=mixing(0.8, 0.25), post={"resize": None}, moments=CIFAR10),
    "cifar100": image_preset(32, augment=_CROP, late=mixing(0.8, 0.25), post={"resize": None}, moments=CIFAR100),
    "kitti_road": image_preset(224, augment={"crop_type": "random_resized", "augment_type": "rand_augment"}),
    "imagenet_resnet": image_preset(224, augment={"interpolation": "bicubic", "augment_type": "color_jitter", "color_jitter": {"brightness": 0.4, "contrast": 0.4, "saturation": 0.4, "hue": 0.1}}, late=mixing(0.2, 0.25, bce_target=False)),
    "imagenet_a1": image_preset(224, augment=sampled_ops(7.0, 101.0), late=mixing(0.2, 0.35), post={"resize": None}),
    "imagenet_a2": image_preset(224, augment=sampled_ops(6.0, 101.0), late=mixing(0.2, 0.25), post={"resize": None}),
    "imagenet_a3": image_preset(160, augment=sampled_ops(6.0, 72.0), late=mixing(0.1, 0.0, bce_target=False), post={"image_size": 224, "train_image_size": 160, "resize": 236}),
    "dinov2": image_preset(224, augment={"mode": "ssl", "global_count": 2, "local_count": 8, "global": multi_crop(224, (0.32, 1.0), (1.0, 0.1), (0.0, 0.2)), "local": multi_crop(96, (0.05, 0.32), 0.5, 0.0)}),
    "wilds:camelyon17": image_preset(96, augment={"enable": False}, late={"enable": False}, post={"resize": None}),
    "wilds:fmow": image_preset(224, augment={"enable": False}, late={"enable": False}, post={"resize": None}),
    "wilds:iwildcam": image_preset(448, augment={"enable": False}, late={"enable": False}, post={"resize": None}),
    "wilds:rxrx1": image_preset(256, augment=_RXRX1, late={"enable": False}, post={"resize": None, "mode": "per_image"}, moments=None),
    "wilds:camelyon17_strong": image_preset(96, augment={"enable": True, "crop_type": "random_rot90_hflip", "augment_type": "color_jitter", "color_jitter": {"brightness": 0.2, "contrast": 0.2, "saturation": 0.2, "hue": 0.05}}, late={"enable": False}, post={"resize": None}),
    "wilds:fmow_strong": image_preset(224, augment={"enable": True, "crop_type": "resize_random_hflip", **sampled_ops(9.0, 101.0)}, late={"enable": False}, post={"resize": None}),
    "wilds:iwildcam_strong": image_preset(448, augment={"enable": True, "crop_type": "resize_random_hflip", **sampled_ops(9.0, 203.0, 80.0)}, late={"enable": False}, post={"resize": None}),
    "wilds:rxrx1_strong": image_preset(256, augment=_RXRX1, late={"enable": True, "mixup_alpha": 0.0, "cutmix_alpha": 0.0, "random_erasing_prob": 0.25}, post={"resize": None, "mode": "per_image"}, moments=None),
}
for _name, _range, _photometric in (("segmentation_a3", (0.8, 1.25), False), ("segmentation_a2", (0.5, 2.0), True), ("segmentation_a1", (0.1, 2.0), True)):
    _VISION[_name] = {
        "geometry": {"crop": 512, "resize_range": None, "scale_range": _range, "flip_probability": 0.5, "long_side": 1024, "upscale": False, "patch": 16, "pad_mode": "CONSTANT"},
        "photometric": {"brightness": 32 / 255, "contrast_by": 0.5, "saturation": 0.5, "hue": 0.05, "p": 0.5} if _photometric else None,
        "postprocess": {"moments": IMAGENET, "channels_first": True},
    }
for _name, _config in _VISION.items():
    register_preset(_name, _config, modality="vision")

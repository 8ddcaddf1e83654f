"""Runnable stages from presets and names: acoustic and vision pipelines (CTL10, CTL11, CTL11b, CTL11c, ARR18, FE19, BA04b).

Tensors travel as struct<data: array<float>, shape: array<int>>, images as struct<data: binary, height: int, width: int>.
Kernels run in numpy over Arrow batches, a row at a time; draws depend on the stage's seed and the row's position alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.labels import one_hot, transform_label
from tidemill.kernels import images, signal
from tidemill.operators.positions import POS
from tidemill.plans.pipeline import Stages
from tidemill.plans.presets import IMAGENET, Audio, find_preset, register_pipeline

TENSOR = "struct<data: array<float>, shape: array<int>>"
PIXELS = "struct<data: binary, height: int, width: int>"

# --- FE19


def output_kind(frontend: str) -> str:
    """What a frontend makes: a waveform, or features."""
    return "waveform" if frontend == "raw_waveform" else "features"


def output_key(frontend: str) -> str:
    """The column that a model takes it from, unless another is named."""
    return "audio" if output_kind(frontend) == "waveform" else "features"


def with_channel(x: np.ndarray) -> np.ndarray:
    """[time] -> [time, 1]; more dimensions stay."""
    return x[:, None] if x.ndim == 1 else x


# --- BA04b


def _share(name: str, value: float) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must be from 0 to 1")


@dataclass(frozen=True)
class AudioMixup:
    """``label_mode``: ``mix`` adds labels by their shares, ``either`` takes the larger value of each."""

    alpha: float = 0.2
    prob: float = 1.0
    label_mode: str = "mix"

    def __post_init__(self):
        _share("prob", self.prob)
        if self.alpha < 0 or self.label_mode not in ("mix", "either"):
            raise ValueError("alpha must not be negative, label_mode mix or either")


@dataclass(frozen=True)
class CutMixSpec:
    alpha: float = 1.0
    prob: float = 0.5
    axes: str = "both"

    def __post_init__(self):
        _share("prob", self.prob)
        if self.alpha < 0 or self.axes not in ("time", "frequency", "both"):
            raise ValueError("alpha must not be negative, axes time, frequency or both")


@dataclass(frozen=True)
class WavMix:
    alpha: float = 10.0
    prob: float = 1.0

    def __post_init__(self):
        _share("prob", self.prob)


@dataclass(frozen=True)
class MixStyle:
    prob: float = 0.5
    mix: float = 0.1

    def __post_init__(self):
        _share("prob", self.prob)


# --- kernels on columns


def _tensor(x: np.ndarray | None) -> tuple:
    return (None, None) if x is None else (np.ascontiguousarray(x, np.float32).reshape(-1), list(x.shape))


def tensor_kernel(f: Callable, returns: str = TENSOR, pack: Callable = _tensor) -> Callable[..., Column]:
    """A function of a row's values to an array -> a function of columns to a tensor. A null value gives null."""

    def run(columns) -> pd.DataFrame:
        rows = [pack(None if any(v is None for v in row) else f(*row)) for row in zip(*columns, strict=True)]
        names = [part.split(":")[0].strip() for part in returns[len("struct<") : -1].split(", ")]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    def one(*columns: Column) -> Column:
        shapes = {1: lambda a: run([a]), 2: lambda a, b: run([a, b]), 3: lambda a, b, c: run([a, b, c])}
        g = shapes[len(columns)]
        g.__annotations__ = {**dict.fromkeys("abc"[: len(columns)], pd.Series), "return": pd.DataFrame}
        got = F.pandas_udf(g, returns)(*columns)
        return F.when(got["data"].isNotNull(), got)

    return one


def array_of(data, shape) -> np.ndarray:
    return np.asarray(data, np.float32).reshape([int(n) for n in shape])


def _pixels(x: np.ndarray | None) -> tuple:
    return (None, 0, 0) if x is None else (np.ascontiguousarray(x, np.uint8).tobytes(), x.shape[0], x.shape[1])


def pixels_of(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width), 3)


def pixel_kernel(f: Callable) -> Callable[..., Column]:
    return tensor_kernel(f, PIXELS, _pixels)


def seeded(seed: int) -> Column:
    """What a row draws from: the stage's seed and its position."""
    return F.xxhash64(F.lit(seed), F.col(POS))


def _key(seed) -> tuple[int, int]:
    return int(seed) & 0xFFFFFFFF, (int(seed) >> 32) & 0x7FFFFFFF


# --- ARR18


def model_input(config: Audio, *, column: str = "waveform", output: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A stage: waveforms at the configuration's rate -> what its model takes, in its layout and dtype.

    A column of views (an array of waveforms) gives an array of tensors. The output column is the frontend's own
    (FE19), unless named; the waveform goes where it is not the output. A stated length fixes the shape (CTL12).
    """
    name = output or output_key(config.frontend)
    length = None if config.seconds is None else round(config.seconds * config.rate)

    def make(x) -> np.ndarray:
        x = with_channel(np.asarray(x, np.float32))
        x = x if length is None else signal.fit_length(x, length)
        got = signal.frontend(x, config.frontend, config.stft, config.mel, config.log, config.norm)
        got = got if output_kind(config.frontend) == "waveform" else signal.layout(got, config.layout)
        return signal.as_dtype(got, config.dtype)

    def stage(df: DataFrame) -> DataFrame:
        views = df.schema[column].dataType.simpleString().startswith("array<array")
        if views:
            rest = [F.col(c) for c in df.columns if c != column]
            each = df.select("*", F.posexplode(column).alias("_view", "_x")).withColumn("_made", tensor_kernel(make)("_x"))
            made = each.groupBy(POS).agg(F.array_sort(F.collect_list(F.struct("_view", "_made"))).alias("_all"))
            made = made.select(POS, F.transform("_all", lambda v: v["_made"]).alias(name))
            return df.select(*rest).join(made, POS)
        out = df.withColumn("_made", tensor_kernel(make)(F.col(column)))
        return out.drop(column).withColumnRenamed("_made", name) if name != column else out.drop(column).withColumnRenamed("_made", column)

    return stage


# --- acoustic pipelines (CTL10)


def acoustic_preprocess(config: Audio, *, channels: str = "mono_mean", level: str = "none", dc: bool = False) -> Callable[[DataFrame], DataFrame]:
    """CTL11b: waveform (array<float>, or of channels) and sample_rate -> one waveform at the configuration's rate."""

    def make(x, rate) -> np.ndarray:
        x = np.stack(x) if len(x) and np.ndim(x[0]) else np.asarray(x, np.float32)
        return signal.preprocess(x, int(rate), target=config.rate, channels=channels, dc=dc, level=level).reshape(-1)

    def stage(df: DataFrame) -> DataFrame:
        return df.withColumn("waveform", tensor_kernel(make)("waveform", "sample_rate")["data"]).withColumn("sample_rate", F.lit(config.rate))

    return stage


def acoustic_augment(config: Audio, specs) -> Callable[[DataFrame, int], DataFrame]:
    """CTL11b: waveform augmentations; the seed also goes to what follows the frontend."""

    def stage(df: DataFrame, seed: int) -> DataFrame:
        def make(x, s) -> np.ndarray:
            return signal.augment_waveform(np.asarray(x, np.float32), config.rate, specs, key=_key(s)).reshape(-1)

        out = df.withColumn("_seed", seeded(seed))
        return out.withColumn("waveform", tensor_kernel(make)("waveform", "_seed")["data"])

    return stage


def acoustic_postprocess(config: Audio, *, spectrogram=None, label: str = "index", classes: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """CTL11b: the frontend, spectrogram augmentations of rows that were augmented, the label."""
    name = output_key(config.frontend)

    def augmented(x, s) -> np.ndarray:
        return signal.augment_spectrogram(array_of(*x.values()) if isinstance(x, dict) else array_of(*x), spectrogram, key=(*_key(s), 1), order=config.layout)

    def stage(df: DataFrame) -> DataFrame:
        out = model_input(config)(df)
        if "_seed" in out.columns:
            if spectrogram and output_kind(config.frontend) == "features":
                on = tensor_kernel(lambda d, shape, s: signal.augment_spectrogram(array_of(d, shape), spectrogram, key=(*_key(s), 1), order=config.layout))
                out = out.withColumn(name, on(F.col(name)["data"], F.col(name)["shape"], F.col("_seed")))
            out = out.drop("_seed")
        if "label" in out.columns:
            out = out.withColumn("label", transform_label(F.col("label"), label, classes=classes or config.classes))
        return out

    return stage


def acoustic_pipeline(preset: str | Audio, *, waveform=None, spectrogram=None, batch: AudioMixup | WavMix | None = None, label: str = "index", classes: int | None = None, channels: str = "mono_mean") -> Stages:
    """CTL10, CTL11c: the four stages of a preset, by its name or its configuration."""
    config = preset if isinstance(preset, Audio) else find_preset(preset, "acoustic")
    if not isinstance(config, Audio):
        raise KeyError(f"no acoustic preset {preset!r}")
    late = None if batch is None else mixed_batches(output_key(config.frontend), "label" if label in ("one_hot", "multi_hot") else None, batch)
    return Stages(
        preprocess=acoustic_preprocess(config, channels=channels),
        augment=acoustic_augment(config, waveform) if waveform or spectrogram else None,
        postprocess=acoustic_postprocess(config, spectrogram=spectrogram, label=label, classes=classes),
        late_augment=late,
    )


def mixed_batches(tensor: str, label: str | None, how: AudioMixup | WavMix) -> Callable[[DataFrame, int], DataFrame]:
    """CTL11b: batches whose rows are mixed with a partner of the same batch, all in the JVM.

    The partner is a seeded number of places further on; one share for a batch, its larger side the row's own. With
    alpha 1 that is uniform on 0.5 to 1; other values bend it towards 1 (small) or 0.5 (large).
    """

    def stage(batches: DataFrame, seed: int) -> DataFrame:
        n = F.size("rows")
        draw = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.col("batch_id"), F.lit(what)), F.lit(1 << 30)).cast("double") / float(1 << 30)
        bent = F.lit(1.0) - F.pow(draw("share"), F.lit(1.0 / max(how.alpha, 1e-6))) / 2 if how.alpha < 1 else F.lit(0.5) + F.pow(draw("share"), F.lit(how.alpha)) / 2
        share = F.when((draw("gate") < how.prob) & (n > 1) & (how.alpha > 0), bent).otherwise(1.0)
        step = F.lit(1) + F.floor(draw("step") * F.greatest(n - 1, F.lit(1))).cast("int")
        out = batches.withColumn("_share", share).withColumn("_step", step)
        fields = [f.name for f in batches.schema["rows"].dataType.elementType.fields]
        either = isinstance(how, AudioMixup) and how.label_mode == "either"

        def blended(a: Column, b: Column) -> Column:
            return F.zip_with(a, b, lambda x, y: (F.col("_share") * x + (1 - F.col("_share")) * y).cast("float"))

        def one(r: Column, i: Column) -> Column:
            other = F.get(F.col("rows"), (i + F.col("_step")) % n)
            made = []
            for f in fields:
                if f == tensor:
                    made.append(F.struct(blended(r[f]["data"], other[f]["data"]).alias("data"), r[f]["shape"].alias("shape")).alias(f))
                elif f == label:
                    made.append((F.zip_with(r[f], other[f], lambda x, y: F.greatest(x, y)) if either else blended(r[f], other[f])).alias(f))
                else:
                    made.append(r[f].alias(f))
            return F.struct(*made)

        return out.withColumn("rows", F.when(F.col("_share") < 1, F.transform("rows", one)).otherwise(F.col("rows").cast(_floats(batches, label)))).drop("_share", "_step")

    return stage


def _floats(batches: DataFrame, label: str | None):
    """The rows' type with mixed labels as floats."""
    from pyspark.sql import types as T

    kind = batches.schema["rows"].dataType
    fields = [T.StructField(f.name, T.ArrayType(T.FloatType()) if f.name == label else f.dataType) for f in kind.elementType.fields]
    return T.ArrayType(T.StructType(fields))


# --- vision pipelines (CTL11)


def vision_preprocess(column: str = "image") -> Callable[[DataFrame], DataFrame]:
    """CTL11b: encoded images -> pixels, checked before they are decoded."""

    def make(data) -> np.ndarray:
        images.check_image_file(bytes(data))
        return images.as_rgb(images.decode_png(bytes(data)))

    return lambda df: df.withColumn(column, pixel_kernel(make)(F.col(column)))


def vision_augment(options: dict, column: str = "image") -> Callable[[DataFrame, int], DataFrame]:
    """CTL11b: a crop and a policy, by name."""
    size, crop, policy = options.get("image_size", 224), options.get("crop_type", "random_resized"), options.get("augment_type", "none")

    def cropped(x: np.ndarray, rng) -> np.ndarray:
        if crop == "random_pad":
            return images.crop_with_pad(images.resize(x, size, size), size, options.get("padding", 4), rng, options.get("pad_mode", "reflect").lower())
        if crop == "random_rot90_hflip":
            x = np.rot90(x, int(rng.integers(0, 4)))
        elif crop == "resize_random_hflip":
            x = images.resize(x, size, size)
        else:
            x = images.random_resized_crop(x, size, rng)
            x = x[0] if isinstance(x, tuple) else x
        return x[:, ::-1] if rng.random() < 0.5 else x

    def make(data, shape, s) -> np.ndarray:
        key = _key(s)
        x = np.clip(np.rint(cropped(pixels_of(data, *shape), signal.rng_of(*key, 0))), 0, 255).astype(np.uint8)
        if policy == "rand_augment":
            x = images.rand_augment(x, key=(*key, 1), **options.get("rand_augment", {}))
        elif policy.startswith("trivial_augment"):
            x = images.trivial_augment(x, key=(*key, 1), wide=policy.endswith("wide"))
        elif policy == "color_jitter":
            jitter = {("contrast_by" if k == "contrast" else k): v for k, v in options.get("color_jitter", {}).items()}
            x = images.colour_jitter(x, signal.rng_of(*key, 1), **jitter)
        return np.clip(np.rint(x), 0, 255)

    def stage(df: DataFrame, seed: int) -> DataFrame:
        if not options.get("enable", True):
            return df
        return df.withColumn(column, pixel_kernel(make)(F.col(column)["data"], F.array(F.col(column)["height"], F.col(column)["width"]), seeded(seed)))

    return stage


def vision_postprocess(options: dict, *, column: str = "image", classes: int | None = None, smoothing: float = 0.0, channels_first: bool = True) -> Callable[[DataFrame], DataFrame]:
    """CTL11b: resized, normalised by channel or by image, in the model's layout; labels one-hot where classes are given."""
    size, moments = options.get("image_size", 224), options.get("moments", IMAGENET)

    def make(data, shape) -> np.ndarray:
        x = pixels_of(data, *shape)
        short = options.get("resize", round(size * 256 / 224))
        x = images.eval_image(x, size, short) if short else images.resize(x, size, size)
        if moments is None:
            x = (x - x.mean()) / max(float(x.std()), 1e-8)
        else:
            x = (x / 255 - np.asarray(moments[0])) / (np.asarray(moments[1]) + 1e-8)
        return images.channels_first(x) if channels_first else x

    def stage(df: DataFrame) -> DataFrame:
        out = df.withColumn(column, tensor_kernel(make)(F.col(column)["data"], F.array(F.col(column)["height"], F.col(column)["width"])))
        if classes and "label" in out.columns:
            out = out.withColumn("label", one_hot(F.col("label"), classes, smoothing))
        return out

    return stage


def vision_pipeline(preset: str | dict, *, classes: int | None = None, channels_first: bool = True) -> Stages:
    """CTL11, CTL11c: the four stages of a classification preset; batches are mixed where labels are vectors."""
    config = preset if isinstance(preset, dict) else find_preset(preset, "vision")
    if "augment" not in config:
        raise KeyError(f"no classification preset {preset!r}")
    late = config.get("late", {})
    mix = late.get("enable", True) and late.get("mixup_alpha", 0) > 0 and classes
    return Stages(
        preprocess=vision_preprocess(),
        augment=vision_augment(config["augment"]),
        postprocess=vision_postprocess(config["postprocess"], classes=classes, channels_first=channels_first),
        late_augment=mixed_batches("image", "label", AudioMixup(late["mixup_alpha"], late.get("prob", 1.0))) if mix else None,
    )


def identity_pipeline() -> Stages:
    """CTL11b: rows as they are."""
    return Stages()


# --- CTL11c


def qualified_name(f: Callable) -> str:
    """Module and name of a callable, of what a partial wraps, or of an instance's class."""
    while isinstance(f, functools.partial):
        f = f.func
    owner = f if hasattr(f, "__qualname__") else type(f)
    return f"{owner.__module__}.{owner.__qualname__}"


def with_augmentation(df: DataFrame, name: str, **parameters) -> DataFrame:
    """Adds to metadata.augmentations what was done to a row: its name and parameters."""
    done = F.struct(F.lit(name).alias("name"), F.create_map(*[F.lit(str(x)) for kv in sorted(parameters.items()) for x in kv]).cast("map<string,string>").alias("parameters"))
    if "metadata" not in df.columns:
        return df.withColumn("metadata", F.struct(F.array(done).alias("augmentations")))
    there = "augmentations" in df.schema["metadata"].dataType.names
    every = F.concat(F.coalesce(F.col("metadata.augmentations"), F.array().cast(df.schema["metadata"].dataType["augmentations"].dataType)), F.array(done)) if there else F.array(done)
    return df.withColumn("metadata", F.col("metadata").withField("augmentations", every))


def as_batch(x: np.ndarray) -> tuple[np.ndarray, int]:
    """An image or a batch of images -> a batch, and how many dimensions it had."""
    if x.ndim not in (3, 4):
        raise ValueError("an image has three dimensions, a batch four")
    return (x[None], 3) if x.ndim == 3 else (x, 4)


def as_before(x: np.ndarray, dimensions: int) -> np.ndarray:
    return x[0] if dimensions == 3 else x


register_pipeline("acoustic/classification")(acoustic_pipeline)
register_pipeline("acoustic/identity")(identity_pipeline)
register_pipeline("vision/classification")(vision_pipeline)

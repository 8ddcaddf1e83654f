"""Geometry records of dense views as struct columns: sampled once, replayed anywhere (GEO01-03)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.hashing import draw

PAD_MODES = ("CONSTANT", "REFLECT", "SYMMETRIC")


@dataclass(frozen=True)
class Geometry:
    """What a view's size, crop and padding follow from. Exactly one of the two training ranges is given."""

    crop: int = 512
    resize_range: tuple[int, int] | None = (512, 1024)
    scale_range: tuple[float, float] | None = None
    flip_probability: float = 0.5
    long_side: int = 1024
    upscale: bool = False
    patch: int = 16
    pad_mode: str = "CONSTANT"
    classes: tuple[int, ...] = ()
    fill: int = 255

    def __post_init__(self):
        if min(self.crop, self.long_side, self.patch) <= 0:
            raise ValueError("crop, long_side and patch must be positive")
        if (self.resize_range is None) == (self.scale_range is None):
            raise ValueError("give either a resize range or a scale range")
        low, high = self.resize_range or self.scale_range
        if not 0 < low <= high:
            raise ValueError("a range goes from a positive number to one not smaller")
        if not 0 <= self.flip_probability <= 1:
            raise ValueError("flip_probability must be in 0..1")
        if self.pad_mode not in PAD_MODES:
            raise ValueError(f"pad_mode is none of {PAD_MODES}")


def _round(v: Column) -> Column:
    return F.greatest(F.floor(v + 0.5), F.lit(1)).cast("int")


def sample(height: Column, width: Column, g: Geometry, *, training: bool, seed: int = 0, position: Column | None = None, fill: int | None = None) -> Column:
    """GEO01, GEO02: the record; evaluation needs no draw. ``fill``: of a panoptic map, which declares no classes."""
    h, w = height.cast("double"), width.cast("double")
    if training:
        u = draw(seed, position, "size")
        if g.resize_range:
            low, high = g.resize_range
            scale = F.floor(low + u * (high - low + 1)) / F.least(h, w)
        else:
            low, high = g.scale_range
            scale = (low + (high - low) * u) * F.least(g.crop / h, g.crop / w)
    else:
        scale = g.long_side / F.greatest(h, w)
        scale = scale if g.upscale else F.least(scale, F.lit(1.0))
    rh, rw = _round(h * scale), _round(w * scale)
    if training:
        before = [F.greatest(F.lit(g.crop) - r, F.lit(0)) for r in (rh, rw)]
        top, left = (F.floor(draw(seed, position, n) * (r + b - g.crop + 1)).cast("int") for n, r, b in zip(("top", "left"), (rh, rw), before, strict=True))
        ch = cw = F.lit(g.crop)
        flip = draw(seed, position, "flip") < g.flip_probability
    else:
        before, top, left, ch, cw, flip = [F.lit(0), F.lit(0)], F.lit(0), F.lit(0), rh, rw, F.lit(False)
    after = [F.pmod(-c, F.lit(g.patch)) for c in (ch, cw)]
    size = [(c + a).cast("int") for c, a in zip((ch, cw), after, strict=True)]
    zero = F.lit(0)
    return F.struct(
        F.lit(2).alias("version"),
        F.array(height.cast("int"), width.cast("int")).alias("original_size"),
        F.array(rh, rw).alias("resized_size"),
        F.array(top, left, ch, cw).alias("crop_box"),
        F.array(zero, before[0], zero, before[1]).alias("pre_padding"),
        F.array(zero, after[0], zero, after[1]).alias("post_padding"),
        flip.alias("horizontal_flip"),
        F.lit(training).alias("is_training"),
        F.array(*size).alias("model_input_size"),
        F.lit(g.patch).alias("patch_size"),
        F.array(*[F.floor(s / g.patch).cast("int") for s in size]).alias("grid_size"),
        F.lit(PAD_MODES.index(g.pad_mode)).alias("image_pad_mode"),
        F.lit(g.fill if fill is None else fill).cast("long").alias("mask_fill_value"),
        F.array(*map(F.lit, g.classes if fill is None else ())).cast("array<int>").alias("class_values"),
    )


def _at(x: Column, i: int) -> Column:
    return F.get(x, F.lit(i))


def problems(r: Column) -> Column:
    """GEO03: what is wrong with a record; an empty array for a good one."""
    box, pre, post = r["crop_box"], r["pre_padding"], r["post_padding"]
    checks = {
        "version": r["version"].isin(1, 2),
        "sizes": F.array_min(F.concat(r["original_size"], r["resized_size"], r["model_input_size"], r["grid_size"])) > 0,
        "padding": F.array_min(F.concat(pre, post, box)) >= 0,
        "crop": (_at(box, 0) + _at(box, 2) <= _at(r["resized_size"], 0) + _at(pre, 0) + _at(pre, 1)) & (_at(box, 1) + _at(box, 3) <= _at(r["resized_size"], 1) + _at(pre, 2) + _at(pre, 3)),
        "input": (_at(r["model_input_size"], 0) == _at(box, 2) + _at(post, 0) + _at(post, 1)) & (_at(r["model_input_size"], 1) == _at(box, 3) + _at(post, 2) + _at(post, 3)),
        "grid": F.transform(r["grid_size"], lambda v: v * r["patch_size"]) == r["model_input_size"],
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def centered(r: Column, row: Column, column: Column, dy: int = 0, dx: int = 0) -> Column:
    """GEO03: a training record with its crop around a point of the original, moved inside if need be."""
    place = []
    for i, (at, shift) in enumerate(((row, dy), (column, dx))):
        size, pre = _at(r["crop_box"], 2 + i), r["pre_padding"]
        point = at * _at(r["resized_size"], i) / _at(r["original_size"], i) + _at(pre, 2 * i)
        corner = F.floor(point - size / 2 + 0.5) + shift
        most = _at(r["resized_size"], i) + _at(pre, 2 * i) + _at(pre, 2 * i + 1) - size
        place.append(F.greatest(F.least(corner, most), F.lit(0)).cast("int"))
    return r.withField("crop_box", F.array(*place, _at(r["crop_box"], 2), _at(r["crop_box"], 3)))

"""Images as flat arrays of interleaved RGB or single-channel values: pointwise and index arithmetic.

IM03, IM04, IM06, IM17, IM18, IM20, IM22, IM25, IM26, VC03, VC07-09, VC16, VC17b, TGT01, TGT02, TGT05, GEO05, AGG12,
WIN07. Rounding is half to even but for the families that cut fractions off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.arrays import let, mean

# Parameters by severity 1 to 5, and magnitudes of the sampled image operations.
PIXELATE = (0.6, 0.5, 0.4, 0.3, 0.25)
CONTRAST = (0.9, 0.75, 0.6, 0.45, 0.3)
BRIGHTNESS = (0.9, 0.8, 0.7, 0.6, 0.5)
OVEREXPOSURE = (1.3, 1.6, 2.0, 2.6, 3.4)
MAGNITUDES = 30.0
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def _const(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _channel(values, i: Column) -> Column:
    return F.get(_const(values), i % len(values))


def clip_round(v: Column, how: str = "even") -> Column:
    """VC15, Q18: to 0..255, half to even or with fractions cut off."""
    v = F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0))
    return (F.rint(v) if how == "even" else F.floor(v)).cast("int")


def normalised(x: Column, means=MEAN, std=STD) -> Column:
    """IM03: of 0..255 to 0..1, less the channel's mean, by its deviation."""
    return F.transform(x, lambda v, i: (v / 255.0 - _channel(means, i)) / (_channel(std, i) + 1e-8))


def standardised(x: Column, channels: int = 3) -> Column:
    """IM04: each channel by its own moments; 0 where it hardly varies."""
    of = lambda c: F.filter(x, lambda v, i: i % channels == c)
    own = F.array(*map(of, range(channels)))
    spread = lambda y, m: F.sqrt(mean(y, lambda v: (v - m) * (v - m)))
    moments = F.transform(own, lambda y: let(mean(y), lambda m: F.struct(m.alias("m"), spread(y, m).alias("s"))))

    def one(ms: Column, v: Column, i: Column) -> Column:
        at = F.get(ms, i % channels)
        return F.when(at["s"] > 1e-6, (v - at["m"]) / at["s"]).otherwise(F.lit(0.0))

    return let(moments, lambda ms: F.transform(x, lambda v, i: one(ms, v, i)))


def patch_padding(size: Column, patch: int) -> Column:
    """IM06: what a side lacks to the next multiple."""
    return F.pmod(-size, F.lit(patch))


def operation_argument(name: str, magnitude: Column, *, rotate: float = 30.0, shear: float = 0.3, enhance: float = 0.9, posterize: int = 4, translate: float = 100.0) -> Column:
    """IM17: what a magnitude of 0..30 means to an operation."""
    share = magnitude / MAGNITUDES
    return {
        "rotate": share * rotate,
        "shear": share * shear,
        "enhance": 1.0 + share * enhance,
        "translate": share * translate,
        "posterize": (8 - F.rint(share * posterize)).cast("double"),
        "solarize": 255.0 * (1.0 - share),
    }[name]


def blended(a: Column, b: Column, factor: Column | float) -> Column:
    """IM18: from a (0) to b (1) and beyond, in 0..255."""
    return F.zip_with(a, b, lambda x, y: F.greatest(F.least(x + (y - x) * factor, F.lit(255.0)), F.lit(0.0)))


def solarized(x: Column, threshold: int = 128) -> Column:
    """IM15, IM18: inverted from the threshold on."""
    return F.transform(x, lambda v: F.when(v < threshold, v).otherwise(255 - v))


def posterized(x: Column, bits: int) -> Column:
    """IM18: only the upper bits."""
    return F.transform(x, lambda v: F.shiftleft(F.shiftright(v, 8 - bits), 8 - bits))


def gray(x: Column) -> Column:
    """IM18: luminance of each RGB triple."""
    n = F.floor(F.size(x) / 3).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(x, 3 * k) * 0.2989 + F.get(x, 3 * k + 1) * 0.5870 + F.get(x, 3 * k + 2) * 0.1140)


def clipped_boxes(boxes: Column, least: float = 0.05) -> Column:
    """IM20: (y0, x0, y1, x1) in 0..1, each side of a minimal length."""

    def one(b: Column) -> Column:
        y0, x0, y1, x1 = (F.greatest(F.least(b[k], F.lit(1.0)), F.lit(0.0)) for k in ("y0", "x0", "y1", "x1"))
        wide = lambda a, z: (F.when(z - a < least, F.least(a, F.lit(1.0 - least))).otherwise(a), F.when(z - a < least, F.least(a, F.lit(1.0 - least)) + least).otherwise(z))
        (y0, y1), (x0, x1) = wide(y0, y1), wide(x0, x1)
        return F.struct(y0.alias("y0"), x0.alias("x0"), y1.alias("y1"), x1.alias("x1"))

    return F.transform(boxes, one)


def moved_boxes(boxes: Column, dy: Column | float, dx: Column | float) -> Column:
    """IM20: shifted, then clipped."""
    shift = lambda b: F.struct((b["y0"] + dy).alias("y0"), (b["x0"] + dx).alias("x0"), (b["y1"] + dy).alias("y1"), (b["x1"] + dx).alias("x1"))
    return clipped_boxes(F.transform(boxes, shift))


def to_linear(v: Column) -> Column:
    """IM22: of an sRGB value in 0..1."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(v: Column) -> Column:
    """IM22"""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """IM22: L, a, b under D65 of sRGB in 0..1."""
    r, g, b = (to_linear(v) for v in (r, g, b))
    # Linear RGB to XYZ over the white point.
    xyz = (
        (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456,
        0.212671 * r + 0.715160 * g + 0.072169 * b,
        (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754,
    )
    f = lambda t: F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)
    x, y, z = (f(t) for t in xyz)
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def below_horizon(row: Column, column: Column, left: Column, right: Column, width: Column) -> Column:
    """IM25: pixels from a line (given by its rows at both sides) to a point, positive below, along the normal."""
    slope = (right - left) / (width - 1)
    return (row - (left + slope * column)) / F.sqrt(1.0 + slope * slope)


def prepared_depth(x: Column, low: float = 0.1, high: float = 10.0, normalize: bool = True) -> Column:
    """IM26: clipped, then from least to largest on 0..1."""
    y = F.transform(x, lambda v: F.greatest(F.least(v.cast("double"), F.lit(high)), F.lit(low)))
    if not normalize:
        return y
    scaled = lambda z, a, b: F.transform(z, lambda v: F.when(b > a, (v - a) / (b - a)).otherwise(F.lit(0.0)))
    return let(y, lambda z: let(F.array_min(z), lambda a: let(F.array_max(z), lambda b: scaled(z, a, b))))


def nearest_index(k: Column, length: Column | int, size: Column | int) -> Column:
    """GEO05: the source place of output place k."""
    return F.least(F.floor((k + 0.5) * length / size), F.lit(length) - 1 if isinstance(length, int) else length - 1).cast("int")


def resampled(x: Column, size: int) -> Column:
    """GEO05 in one dimension."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get(x, nearest_index(k, F.size(x), size)))


def pixelated(x: Column, ratio: float) -> Column:
    """VC03 in one dimension: down to a share of the length and up again, by the nearest."""
    small = F.greatest(F.floor(F.size(x) * ratio), F.lit(1)).cast("int")
    down = F.transform(F.sequence(F.lit(0), small - 1), lambda k: F.get(x, nearest_index(k, F.size(x), small)))
    return let(down, lambda d: F.transform(x, lambda v, i: F.get(d, nearest_index(i, F.size(d), F.size(x)))))


def less_contrast(x: Column, factor: float) -> Column:
    """VC07"""
    return F.transform(x, lambda v: clip_round((v - 127.5) * factor + 127.5))


def less_bright(x: Column, factor: float) -> Column:
    """VC07"""
    return F.transform(x, lambda v: clip_round(v * factor))


def overexposed(x: Column, gain: float) -> Column:
    """VC08: a gain on linear light."""
    return F.transform(x, lambda v: clip_round(255.0 * to_srgb(F.least(to_linear(v / 255.0) * gain, F.lit(1.0)))))


def white_balanced(x: Column, red: float, blue: float) -> Column:
    """VC09: gains on linear red and blue."""
    gains = (red, 1.0, blue)
    return F.transform(x, lambda v, i: clip_round(255.0 * to_srgb(F.least(to_linear(v / 255.0) * _channel(gains, i), F.lit(1.0)))))


def at_strength(values: tuple[float, ...], strength: Column, scale: str = "linear", neutral: float | None = None) -> Column:
    """VC16: between the rows of a severity table (row 0: what changes nothing); whole strengths are the rows."""
    rows = [values[0] if neutral is None else neutral, *values]
    low = F.greatest(F.least(F.floor(strength), F.lit(len(values) - 1)), F.lit(0)).cast("int")
    t = strength - low
    a, b = F.get(_const(rows), low), F.get(_const(rows), low + 1)
    if scale == "nearest":
        return F.get(_const(rows), F.rint(strength).cast("int"))
    return a + (b - a) * t if scale == "linear" else F.exp(F.log(a) + (F.log(b) - F.log(a)) * t)


def unit(x: Column) -> Column:
    """VC17b: 0..255 to 0..1."""
    return F.transform(x, lambda v: F.greatest(F.least(v / 255.0, F.lit(1.0)), F.lit(0.0)))


def segment_number(r: Column, g: Column, b: Column) -> Column:
    """TGT01: the number that an RGB-coded map holds."""
    return (r.cast("long") + 256 * g.cast("long") + 65536 * b.cast("long")).cast("long")


def class_masks(mask: Column, classes: tuple[int, ...], ignore: int, valid: Column) -> Column:
    """TGT02: for each declared class whether a pixel is of it; invalid and ignored pixels are of none."""
    return F.transform(F.array(*map(F.lit, classes)), lambda c: F.transform(mask, lambda m, i: (m == c) & (m != ignore) & F.get(valid, i)))


def undeclared(mask: Column, classes: tuple[int, ...], ignore: int) -> Column:
    """AGG12: labels that are neither classes nor the one to ignore; should be empty."""
    return F.array_except(F.array_distinct(mask), F.array(*map(F.lit, (*classes, ignore))))


def padded_table(rows: Column, capacity: int, zero: Column) -> Column:
    """TGT05: ``capacity`` rows, the valid first."""
    return F.slice(F.concat(rows, F.array_repeat(zero, capacity)), 1, capacity)


def sorted_segments(segments: Column, number: str = "segment_id", valid: str = "valid") -> Column:
    """WIN07: valid rows by their number."""
    return F.array_sort(F.filter(segments, lambda s: s[valid]), lambda a, b: F.when(a[number] < b[number], -1).when(a[number] > b[number], 1).otherwise(0))

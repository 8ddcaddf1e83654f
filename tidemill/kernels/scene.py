"""Conditions of a scene: haze, rain, droplets on the lens, sun glitter; and the loss of a JPEG (VC06, VC10, VC11, VC13, VC14).

A condition is where it lies (a layout in pixels, drawn from the episode's or the frame's seed), how much of each pixel
it covers (a mask in 0..1), and how that is laid over the image (mixing, adding, screening). Images are in 0..255.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tidemill.kernels.images import blur, correlate, nearest, reflect_pad, resize, rotate, splat

# --- compositing


def mixed(below: np.ndarray, above: np.ndarray, share: np.ndarray) -> np.ndarray:
    """``share`` of what is above, the rest of what is below (the over operator of Porter and Duff, 1984)."""
    return below + share * (above - below)


def screened(below: np.ndarray, light: np.ndarray) -> np.ndarray:
    """Both in 0..1: what each leaves dark is left dark by both."""
    return below + light - below * light


def centres(n: int) -> np.ndarray:
    return np.arange(n) + 0.5


def ramp(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


# --- haze

#: The dark channel's window and share, the weights of grey, the farthest water.
DARK_WINDOW, BRIGHTEST_SHARE, GREY, FARTHEST_M = 15, 1000, (0.2989, 0.5870, 0.1140), 2000.0
#: Side, first step and decay of the field of patches.
FIELD_SIDE, FIELD_STEP, FIELD_DECAY = 256, 100.0, 3.0
DIAGONAL, STRAIGHT = ((-1, -1), (-1, 1), (1, -1), (1, 1)), ((-1, 0), (0, -1), (0, 1), (1, 0))


def windowed_minimum(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Of ``size`` (odd) values around each, as far as there are any: windows grow by doubling."""
    x = np.moveaxis(x, axis, 0)
    p = np.concatenate([np.full((size // 2, *x.shape[1:]), np.inf), x, np.full((size // 2, *x.shape[1:]), np.inf)])
    reach = 1
    while 2 * reach <= size:
        p, reach = np.minimum(p[:-reach], p[reach:]), 2 * reach
    rest = size - reach
    return np.moveaxis(np.minimum(p[: len(p) - rest], p[rest:]), 0, axis)


def airlight(image: np.ndarray) -> np.ndarray:
    """The light that haze adds: of an odd number of the brightest places of the dark channel (He, Sun and Tang, 2009),
    the pixel whose grey is in the middle."""
    dark = image.min(axis=-1)
    for axis in (0, 1):
        dark = windowed_minimum(dark, DARK_WINDOW, axis)
    n = dark.size // BRIGHTEST_SHARE | 1
    brightest = image.reshape(-1, 3)[np.argsort(-dark, axis=None, kind="stable")[:n]]
    grey = brightest @ np.array(GREY)
    return brightest[np.flatnonzero(grey == np.median(grey))[0]]


def patches(rng, h: int, w: int) -> np.ndarray:
    """A random field in 0..1 by midpoint displacement on a torus (Fournier, Fussell and Carpenter, 1982)."""
    field, stride, step = np.zeros((FIELD_SIDE, FIELD_SIDE)), FIELD_SIDE, FIELD_STEP
    while stride > 1:
        half = stride // 2
        grid = np.arange(0, FIELD_SIDE, stride)
        for rows, columns, around in ((grid + half, grid + half, DIAGONAL), (grid, grid + half, STRAIGHT), (grid + half, grid, STRAIGHT)):
            near = [field[np.ix_((rows + a * half) % FIELD_SIDE, (columns + b * half) % FIELD_SIDE)] for a, b in around]
            field[np.ix_(rows, columns)] = np.mean(near, axis=0) + step * rng.uniform(-step, step, near[0].shape)
        stride, step = half, step / FIELD_DECAY
    field -= field.min()
    field /= max(field.max(), 1e-12)
    used = [max(1, math.ceil(FIELD_SIDE * side / max(h, w))) for side in (h, w)]
    return resize(field[: used[0], : used[1]], h, w, antialias=False)


def optical_depth(mode: str, shape: tuple[int, int], attenuation_per_m: float, transmission: float, depth_m, horizon) -> np.ndarray | float:
    """By Koschmieder's law: attenuation times distance, or what a stated transmission stands for."""
    if mode == "homogeneous":
        return -math.log(transmission)
    if mode == "depth":
        return attenuation_per_m * np.asarray(depth_m, np.float64)
    return attenuation_per_m * horizon.water_distance_m(*shape)


def haze(image: np.ndarray, depth: np.ndarray | float, patchiness: float, rng) -> np.ndarray:
    thickness = 1 + patchiness * (patches(rng, *image.shape[:2]) - 0.5)
    return mixed(airlight(image), image, np.exp(-thickness * depth)[..., None])


# --- rain

#: What a drop adds, the most drops for a row, samples of a pixel's side.
DROP_VALUE, DROPS_POOL, SAMPLES_PER_PIXEL = 200.0, 4.0, 2
DROPS_AT_ONCE = 256


def box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    """Of the square around each pixel, mirrored at the borders, by running sums."""
    size = 2 * radius + 1
    x = reflect_pad(x, radius, radius)
    for axis in (0, 1):
        total = np.insert(np.cumsum(x, axis=axis), 0, 0, axis=axis)
        x = (np.take(total, range(size, total.shape[axis]), axis) - np.take(total, range(total.shape[axis] - size), axis)) / size
    return x


def cells(side: float) -> np.ndarray:
    """Centres of the cells that a side is cut into."""
    n = max(1, math.ceil(SAMPLES_PER_PIXEL * side))
    return centres(n) * side / n


def streak(fall: np.ndarray, width: float) -> tuple[np.ndarray, float]:
    """Cells of a band of ``width`` along ``fall``, as seen from its start, and the area of each."""
    length = math.hypot(*fall)
    y, x = fall / max(length, 1e-6)
    band = np.stack(np.meshgrid(cells(length), cells(width) - width / 2, indexing="ij"), -1).reshape(-1, 2)
    return band @ np.array([[y, x], [-x, y]]), length * width / len(band)


def rain(image: np.ndarray, drops: float, fall: np.ndarray, width: float, blur_size: float, brightness: float, pool: int, rng) -> np.ndarray:
    """``drops`` streaks, the last of them in part; those of a lighter rain are among those of a heavier one."""
    h, w = image.shape[:2]
    heads = rng.random((pool, 2)) * (max(h - fall[0], 0.0), w)
    share = ramp(drops - np.arange(pool))
    points, area = streak(fall, width)
    cover = np.zeros((h, w))
    for at in range(0, int(np.count_nonzero(share)), DROPS_AT_ONCE):
        some = heads[at : at + DROPS_AT_ONCE, None] + points
        cover += splat(some.reshape(-1, 2), np.repeat(share[at : at + DROPS_AT_ONCE] * area, len(points)), h, w)
    cover = box_mean(ramp(cover), max(0, round((blur_size - 1) / 2)))
    return np.clip(image + DROP_VALUE * cover[..., None], 0, 255) * brightness


# --- defocus and snow

#: Taps of the blur that softens a disk's edge; deviations and taps of a flake's trail down and across,
#: its angle; the threshold of the noise that flakes are cut from, its fall with intensity, and how much coarser it is.
SOFTENING_TAPS, TRAIL_DOWN, TRAIL_ACROSS, TRAIL_DEGREES = 5, (4.0, 17), (0.5, 3), -15.0
FLAKES_OVER, MORE_FLAKES, FLAKE_PIXELS = 2.5, 0.5, 4


def bell(sigma: float, taps: int) -> np.ndarray:
    """An odd number of weights of a Gaussian, that add up to one."""
    k = np.exp(-0.5 * ((np.arange(taps) - taps // 2) / sigma) ** 2)
    return k / k.sum()


def spread(x: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Correlated along both sides with odd kernels; nothing lies outside."""
    for axis, kernel in ((0, down), (1, across)):
        x = np.apply_along_axis(np.convolve, axis, np.pad(x, [(len(kernel) // 2,) * 2 if a == axis else (0, 0) for a in range(x.ndim)]), kernel[::-1], "valid")
    return x


def defocus(image: np.ndarray, radius: float, softening: float) -> np.ndarray:
    """The mean over a disk (a round aperture's point spread), then a slight blur; mirrored borders."""
    side = math.ceil(2 * radius) + 1 | 1
    off_axis = np.abs(np.arange(side) - side // 2)
    disk = (np.hypot(off_axis, off_axis[:, None]) <= radius).astype(np.float64)
    soft = bell(softening, SOFTENING_TAPS)
    return correlate(correlate(image, disk / (disk.sum() + 1e-8)), np.outer(soft, soft))


def snow(image: np.ndarray, intensity: float, whiteness: float, rng) -> np.ndarray:
    """Flakes are peaks of coarse noise that leave slanted trails; they are added to a whitened image."""
    h, w = image.shape[:2]
    peaks = rng.standard_normal((max(h // FLAKE_PIXELS, 1), max(w // FLAKE_PIXELS, 1))) > FLAKES_OVER - MORE_FLAKES * intensity
    trails = rotate(spread(nearest(peaks.astype(np.float64), h, w), bell(*TRAIL_DOWN), bell(*TRAIL_ACROSS)), TRAIL_DEGREES)
    return mixed(image, 255.0, whiteness) + 255 * intensity * trails[..., None]


# --- motion


def trail(image: np.ndarray, angle: float, radius: float, sigma: float) -> np.ndarray:
    """What a moving camera sees: the image now and where it was, a pixel apart, ever fainter, over twice the radius.

    The farthest place counts by the part of its pixel that is still within reach.
    """
    reach = 2 * radius + 1
    back = np.arange(math.ceil(reach))
    share = np.exp(-0.5 * (back / sigma) ** 2) * np.minimum(reach - back, 1.0)
    rows, columns = (np.arange(n, dtype=np.float64) for n in image.shape[:2])
    seen = sum(w * bilinear(image, rows + t * math.sin(angle), columns + t * math.cos(angle)) for t, w in zip(back, share, strict=True))
    return seen / share.sum()


# --- droplets on the lens

#: How many are laid out, their aspects, how much smaller they show the scene, their blur, their rim.
DROPLETS, ASPECTS, MINIFIED, DROPLET_BLUR, RIM = 45, (0.8, 1.25), 3.0, 0.25, 0.25


@dataclass(frozen=True)
class Droplet:
    """Centre, half axes and radius in pixels."""

    y: float
    x: float
    ry: float
    rx: float
    radius: float

    def cover(self, h: int, w: int, feather: float) -> np.ndarray:
        apart = np.hypot((centres(h)[:, None] - self.y) / self.ry, (centres(w) - self.x) / self.rx)
        return ramp(0.5 - (apart - 1) * self.radius / feather)

    def scene(self, image: np.ndarray, rows: slice, columns: slice) -> np.ndarray:
        """What it shows at those pixels: the image upside down, smaller, mirrored on and on, blurred."""
        sigma = DROPLET_BLUR * self.radius
        reach = math.ceil(3 * sigma)
        h, w = image.shape[:2]
        wide = [range(max(0, s.start - reach), min(n, s.stop + reach)) for s, n in ((rows, h), (columns, w))]
        at = [c - 0.5 - MINIFIED * (np.array(r) - (c - 0.5)) for c, r in zip((self.y, self.x), wide, strict=True)]
        seen = blur(bilinear(image, *at), sigma)
        return seen[rows.start - wide[0].start :, columns.start - wide[1].start :][: rows.stop - rows.start, : columns.stop - columns.start]


def folded(t: np.ndarray, n: int) -> np.ndarray:
    """Places on an endless line, mirrored at the first and last of n pixels, as places among them."""
    period = max(2 * (n - 1), 1)
    t = np.mod(t, period)
    return np.minimum(np.minimum(t, period - t), n - 1)


def bilinear(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The image at each of the rows ``y`` and columns ``x``."""
    for axis, t in ((0, y), (1, x)):
        t = folded(t, image.shape[axis])
        low = np.floor(t).astype(int)
        share = (t - low).reshape([-1 if a == axis else 1 for a in range(3)])
        image = mixed(np.take(image, low, axis), np.take(image, np.minimum(low + 1, image.shape[axis] - 1), axis), share)
    return image


def droplets_of(rng, h: int, w: int, smallest: float, largest: float) -> list[Droplet]:
    """Radii and aspects are uniform in their logarithms."""
    u = rng.random((DROPLETS, 4))
    between = lambda a, b, t: math.exp(math.log(a) + t * (math.log(b) - math.log(a)))
    out = []
    for a, b, c, d in u.tolist():
        radius, stretch = between(smallest, largest, c), math.sqrt(between(*ASPECTS, d))
        out.append(Droplet(a * h, b * w, radius / stretch, radius * stretch, radius))
    return out


def steepness(x: np.ndarray) -> np.ndarray:
    """Length of the central differences; none across a mirrored border."""
    slopes = [np.gradient(x, axis=a) if x.shape[a] > 1 else np.zeros_like(x) for a in (0, 1)]
    slopes[0][[0, -1]] = slopes[1][:, [0, -1]] = 0
    return np.hypot(*slopes)


def lens_droplets(image: np.ndarray, layout: list[Droplet], count: float, feather: float, opacity: float) -> np.ndarray:
    """``count`` of the layout, each over those before it, the last in part; rims are darker."""
    h, w = image.shape[:2]
    covered, shown = np.zeros((h, w, 1)), np.zeros_like(image)
    for droplet, share in zip(layout, ramp(count - np.arange(len(layout))).tolist(), strict=True):
        cover = share * droplet.cover(h, w, feather)
        at = [np.flatnonzero(cover.any(axis=a)) for a in (1, 0)]
        if not len(at[0]):
            continue
        box = tuple(slice(int(a[0]), int(a[-1]) + 1) for a in at)
        part = cover[box][..., None]
        covered[box] = mixed(covered[box], 1.0, part)
        shown[box] = mixed(shown[box], droplet.scene(image, *box), part)
    dark = RIM * ramp(feather * steepness(covered[..., 0]))[..., None]
    return (image * (1 - opacity * covered) + opacity * shown) * (1 - dark)


# --- sun glitter

#: Where the sun's column may be, what is left of its light at the bottom, from where on the envelope
#: calibrates, and the light's colour.
SUN_COLUMNS, BOTTOM_LIGHT, CALIBRATING, SUNLIGHT = (0.2, 0.8), 0.3, 0.5, (1.0, 0.98, 0.92)


def reached_by(values: np.ndarray, share: float) -> float:
    """WIN09: the value that the largest ``share`` of the values, cut to a whole number, reach; infinite for none."""
    n = int(share * values.size)
    return np.partition(values, -n)[-n] if n else np.inf


def glitter_envelope(shore: np.ndarray, h: int, w: int, sun: float, band: float) -> np.ndarray:
    """A band below the sun that fades from the line ``shore`` (a row for each column) to the bottom."""
    room = np.where(shore == h, np.inf, h - shore)
    fade = mixed(1.0, BOTTOM_LIGHT, ramp((centres(h)[:, None] - shore) / room))
    return fade * np.exp(-(((centres(w) / w - sun) / band) ** 2) / 2)


def sun_glitter(image: np.ndarray, water: np.ndarray, envelope: np.ndarray, noise: np.ndarray, share: float, bloom: float, bloom_sigma: float, veil: float) -> np.ndarray:
    """Glints where the noise is highest, their bloom screened over the image, all of it veiled by airlight."""
    lit = water & (noise >= reached_by(noise[water & (envelope > CALIBRATING)], share))
    glints = np.where(lit, envelope, 0.0)
    light = ramp(glints + bloom * blur(glints, bloom_sigma))[..., None] * np.array(SUNLIGHT)
    return mixed(airlight(image), 255 * screened(image / 255, light), veil)


# --- what a JPEG loses

#: Quantisation of luminance and chrominance at quality 50 (ITU-T T.81, tables K.1 and K.2), by rows.
LUMINANCE = """16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99"""
CHROMINANCE = """17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99"""
#: Luminance, blue and red differences (ITU-T T.871).
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])


def quantisers(quality: float) -> tuple[np.ndarray, np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = (np.array(t.split(), np.float64).reshape(8, 8) for t in (LUMINANCE, CHROMINANCE))
    return tuple(np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in tables)


def coded_plane(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A plane after quantisation of its 8 x 8 cosine transforms, padded by its last row and column."""
    h, w = plane.shape
    k = np.arange(8)
    basis = np.cos(np.pi * (2 * k + 1) * k[:, None] / 16) * np.where(k == 0, math.sqrt(1 / 8), 0.5)[:, None]
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3) - 128
    waves = np.rint(basis @ blocks @ basis.T / steps) * steps
    return (basis.T @ waves @ basis + 128).transpose(0, 2, 1, 3).reshape(p.shape)[:h, :w]


def jpeg(image: np.ndarray, quality: float) -> np.ndarray:
    """The image that a baseline JPEG of this quality decodes to, chrominance at half size; entropy coding loses nothing."""
    h, w = image.shape[:2]
    luminance, chrominance = quantisers(quality)
    ycc = np.rint(image) @ TO_YCC.T + (0, 128, 128)
    out = [coded_plane(np.clip(np.rint(ycc[..., 0]), 0, 255), luminance)]
    for c in (1, 2):
        even = np.pad(ycc[..., c], ((0, h % 2), (0, w % 2)), mode="edge")
        half = even.reshape(even.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3))
        small = np.clip(np.rint(coded_plane(np.clip(np.rint(half), 0, 255), chrominance)), 0, 255)
        out.append(np.repeat(np.repeat(small, 2, axis=0), 2, axis=1)[:h, :w])
    decoded = (np.stack([np.clip(np.rint(out[0]), 0, 255), *out[1:]], -1) - (0, 128, 128)) @ np.linalg.inv(TO_YCC).T
    return np.clip(np.rint(decoded), 0, 255)

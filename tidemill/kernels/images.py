"""Images [height, width, channels]: resampling, transforms, sampled augmentations, heat maps, geometry replay.

IM01, IM02, IM05-19, IM21, IM24, IM27, IM28, AGG14, SRC19, GEO04, GEO07-09, TGT04, BA06, BA07.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tidemill.kernels.signal import partner_order, resize_matrix, rng_of

LUMA = np.array([0.2989, 0.5870, 0.1140])


# --- files and layout


def png_header(data: bytes) -> tuple[int, int, int, int]:
    """GEO09, SRC17: width, height, bit depth and colour type; ValueError for what is no PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    w, h, depth, colour = struct.unpack(">IIBB", data[16:26])
    return w, h, depth, colour


def check_image_file(data: bytes, most_bytes: int = 256 << 20, most_side: int = 32768, most_pixels: int = 64_000_000) -> None:
    """SRC17"""
    if len(data) > most_bytes:
        raise ValueError("the file is too large")
    w, h, _, _ = png_header(data)
    if max(w, h) > most_side or w * h > most_pixels or min(w, h) < 1:
        raise ValueError("the image's sides are out of bounds")


def decode_png(data: bytes) -> np.ndarray:
    """8- and 16-bit gray, RGB and RGBA without interlacing -> [height, width, channels]."""
    w, h, depth, colour = png_header(data)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or data[28]:
        raise ValueError("only gray, RGB and RGBA of 8 or 16 bits, not interlaced")
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + chunk) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * step, np.int64)
        if kind == 0:
            got = line
        elif kind == 2:
            got = line + up
        elif kind == 1:
            got = np.cumsum(line.reshape(w, step), 0).reshape(-1)
        else:  # these need the byte to the left as it comes
            got = np.zeros(w * step, np.int64)
            for x in range(w * step):
                a, b = got[x - step] if x >= step else 0, up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[x - step] if x >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                got[x] = (line[x] + guess) & 255
        out[y] = got & 255
    return out.reshape(h, w, channels) if depth == 8 else out.view(">u2").astype(np.uint16).reshape(h, w, channels)


def encode_png(x: np.ndarray) -> bytes:
    x = np.asarray(x)
    x = x[..., None] if x.ndim == 2 else x
    h, w, c = x.shape
    depth = 16 if x.dtype == np.uint16 else 8
    raw = x.astype(">u2").tobytes() if depth == 16 else x.astype(np.uint8).tobytes()
    line = len(raw) // h
    body = zlib.compress(b"".join(b"\0" + raw[y * line : (y + 1) * line] for y in range(h)))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, depth, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def decode_mask(data: bytes, depth: int = 8) -> np.ndarray:
    """GEO09: a gray PNG of exactly this depth -> [height, width]."""
    _, _, d, colour = png_header(data)
    if colour != 0 or d != depth:
        raise ValueError(f"a mask must be a {depth}-bit gray PNG")
    return decode_png(data)[..., 0]


def as_rgb(x: np.ndarray) -> np.ndarray:
    """IM01, SRC19: [height, width, 3] uint8 of what comes as gray, RGBA, channels first, or 0..1 floats."""
    x = np.asarray(x)
    if x.ndim == 2:
        x = x[..., None]
    if x.ndim != 3:
        raise ValueError("an image has two or three dimensions")
    if x.shape[0] in (1, 3) and x.shape[-1] > 4:
        x = x.transpose(1, 2, 0)
    if x.dtype.kind == "f":
        x = np.clip(np.rint(x * 255 if x.size and x.max() <= 1 else x), 0, 255)
    x = np.clip(x, 0, 255).astype(np.uint8)
    return np.repeat(x, 3, 2) if x.shape[2] == 1 else x[..., :3]


def channels_first(x: np.ndarray) -> np.ndarray:
    """IM05"""
    return np.moveaxis(x, -1, -3)


# --- resampling


def nearest(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """GEO05"""
    at = lambda n, size: np.minimum(((np.arange(size) + 0.5) * n / size).astype(int), n - 1)
    return x[at(x.shape[0], h)][:, at(x.shape[1], w)]


def resize(x: np.ndarray, h: int, w: int, method: str = "bilinear", antialias: bool = True) -> np.ndarray:
    """IM02: half-pixel centres."""
    if method == "nearest":
        return nearest(x, h, w)
    a, b = resize_matrix(x.shape[0], h, antialias), resize_matrix(x.shape[1], w, antialias)
    return np.einsum("yi,ij...,xj->yx...", a, np.asarray(x, np.float64), b, optimize=True).astype(np.float32)


def resize_short(x: np.ndarray, size: int, method: str = "bilinear") -> np.ndarray:
    """IM02: the shorter side to ``size``."""
    scale = size / min(x.shape[:2])
    return resize(x, int(np.rint(x.shape[0] * scale)), int(np.rint(x.shape[1] * scale)), method)


def center_crop(x: np.ndarray, h: int, w: int) -> np.ndarray:
    a, b = (x.shape[0] - h) // 2, (x.shape[1] - w) // 2
    return x[a : a + h, b : b + w]


def eval_image(x: np.ndarray, size: int, short: int = 256) -> np.ndarray:
    """IM02"""
    return center_crop(resize_short(x, short), size, size)


def pad_to_patch(x: np.ndarray, patch: int, mode: str = "constant") -> np.ndarray:
    """IM06: at the bottom and the right."""
    return np.pad(x, ((0, -x.shape[0] % patch), (0, -x.shape[1] % patch)) + ((0, 0),) * (x.ndim - 2), mode=mode)


def resize_and_normalise(x: np.ndarray, size: int, short: int | None = None, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225), first: bool = True) -> np.ndarray:
    """IM07"""
    y = eval_image(x, size, short) if short else resize(x, size, size)
    y = (y / 255 - np.asarray(mean)) / (np.asarray(std) + 1e-8)
    return channels_first(y) if first else y


def view_boxes(h: int, w: int, size: int, mode: str = "multi_crop", count: int = 5) -> list[tuple[int, int, int, int]]:
    """IM08: (top, left, height, width): the centre; or corners and centre for five views, else along the diagonal."""
    if mode != "multi_crop" or count == 1:
        return [((h - size) // 2, (w - size) // 2, size, size)]
    if count == 5:
        return [(a, b, size, size) for a, b in ((0, 0), (0, w - size), (h - size, 0), (h - size, w - size), ((h - size) // 2, (w - size) // 2))]
    t = np.linspace(0, 1, count)
    return [(int(np.rint(k * (h - size))), int(np.rint(k * (w - size))), size, size) for k in t]


def eval_views(x: np.ndarray, size: int, short: int, mode: str = "multi_crop", count: int = 5, flip: bool = False) -> list[dict]:
    """IM08: each view with its box and flip."""
    y = resize_short(x, short)
    out = [{"view_index": i, "crop_box": b, "flip": False, "image": y[b[0] : b[0] + b[2], b[1] : b[1] + b[3]]} for i, b in enumerate(view_boxes(*y.shape[:2], size, mode, count))]
    if flip:
        out += [{**v, "view_index": len(out) + i, "flip": True, "image": v["image"][:, ::-1]} for i, v in enumerate(out)]
    return out


# --- sampled geometry


def _box_of(h: int, w: int, rng, scale, ratio) -> tuple[int, int, int, int]:
    area = rng.uniform(*scale) * h * w
    r = np.exp(rng.uniform(np.log(ratio[0]), np.log(ratio[1])))
    bh, bw = int(np.clip(np.rint(np.sqrt(area / r)), 1, h)), int(np.clip(np.rint(np.sqrt(area * r)), 1, w))
    return int(rng.integers(0, h - bh + 1)), int(rng.integers(0, w - bw + 1)), bh, bw


def boxes_in(boxes: np.ndarray, top: float, left: float, h: float, w: float) -> np.ndarray:
    """Boxes (y0, x0, y1, x1) in 0..1 of a crop (in 0..1) of what they were in."""
    return np.clip((boxes - np.array([top, left, top, left])) / np.array([h, w, h, w]), 0, 1)


def random_resized_crop(x: np.ndarray, size: int, rng, scale=(0.08, 1.0), ratio=(0.75, 4 / 3), boxes: np.ndarray | None = None, method: str = "bilinear"):
    """IM09"""
    h, w = x.shape[:2]
    a, b, bh, bw = _box_of(h, w, rng, scale, ratio)
    y = resize(x[a : a + bh, b : b + bw], size, size, method)
    return y if boxes is None else (y, boxes_in(boxes, a / h, b / w, bh / h, bw / w))


def flipped(x: np.ndarray, boxes: np.ndarray | None = None, vertical: bool = False):
    """IM10"""
    y = x[::-1] if vertical else x[:, ::-1]
    if boxes is None:
        return y
    z = boxes.copy()
    i = 0 if vertical else 1
    z[:, i], z[:, i + 2] = 1 - boxes[:, i + 2], 1 - boxes[:, i]
    return y, z


def crop_with_pad(x: np.ndarray, size: int, padding: int, rng, mode: str = "reflect") -> np.ndarray:
    """IM11"""
    y = np.pad(x, ((padding, padding), (padding, padding), (0, 0)), mode=mode)
    a, b = int(rng.integers(0, y.shape[0] - size + 1)), int(rng.integers(0, y.shape[1] - size + 1))
    return y[a : a + size, b : b + size]


def _maybe_flip(x, rng, p=0.5, vertical=False):
    return flipped(x, vertical=vertical) if rng.random() < p else x


#: IM12: name -> (image, size, generator) -> image
CROPS = {
    "random_resized": lambda x, n, rng, **o: _maybe_flip(random_resized_crop(x, n, rng, **o), rng),
    "random_resized_hvflip": lambda x, n, rng, **o: _maybe_flip(_maybe_flip(random_resized_crop(x, n, rng, **o), rng), rng, vertical=True),
    "random_pad": lambda x, n, rng, padding=4: _maybe_flip(crop_with_pad(x, n, padding, rng), rng),
    "random_hflip": lambda x, n, rng: _maybe_flip(x, rng),
    "resize_random_hflip": lambda x, n, rng: _maybe_flip(resize(x, n, n), rng),
    "random_rot90_hflip": lambda x, n, rng: _maybe_flip(np.rot90(x, int(rng.integers(4))), rng),
    "none": lambda x, n, rng: x,
}


def co_transform(image: np.ndarray, mask: np.ndarray, f, *, key: tuple):
    """IM28: the same draws for both."""
    return f(image, rng_of(*key)), f(mask, rng_of(*key))


# --- pixel operations (IM18) and affine ones (IM19)


def _u8(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def blend(a: np.ndarray, b: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(a.astype(np.float32) + factor * (b.astype(np.float32) - a), 0, 255)


def gray(x: np.ndarray) -> np.ndarray:
    return np.repeat((x[..., :3] @ LUMA)[..., None], 3, -1)


def contrast(x: np.ndarray, f: float) -> np.ndarray:
    return blend(np.full_like(x, gray(x).mean(), np.float32), x, f)


def autocontrast(x: np.ndarray) -> np.ndarray:
    lo, hi = x.min((0, 1)).astype(np.float32), x.max((0, 1)).astype(np.float32)
    return np.where(hi > lo, np.clip((x - lo) * (255 / np.maximum(hi - lo, 1e-6)), 0, 255), x)


def equalise(x: np.ndarray) -> np.ndarray:
    """AGG14: each channel by its histogram's running sum."""
    out = x.copy()
    for c in range(x.shape[-1]):
        h = np.bincount(x[..., c].reshape(-1), minlength=256)
        used = h[h > 0]
        step = (used.sum() - used[-1]) // 255
        if step:
            lut = np.clip((np.cumsum(h) - h + step // 2) // step, 0, 255)
            out[..., c] = lut[x[..., c]]
    return out


def sharpness(x: np.ndarray, f: float) -> np.ndarray:
    k = np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13
    soft = x.astype(np.float32).copy()
    if min(x.shape[:2]) > 2:
        view = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32), (3, 3), axis=(0, 1))
        soft[1:-1, 1:-1] = np.einsum("yxcij,ij->yxc", view, k)
    return blend(soft, x, f)


def affine(x: np.ndarray, m: np.ndarray, fill: float = 0, method: str = "nearest") -> np.ndarray:
    """Output (x, y) shows input m @ (x, y, 1); what lies outside is ``fill``."""
    h, w = x.shape[:2]
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
    sx, sy = m[0, 0] * xx + m[0, 1] * yy + m[0, 2], m[1, 0] * xx + m[1, 1] * yy + m[1, 2]
    padded = np.pad(x.astype(np.float32), ((1, 1), (1, 1)) + ((0, 0),) * (x.ndim - 2), constant_values=fill)
    pick = lambda a, b: padded[np.clip(a + 1, 0, h + 1).astype(int), np.clip(b + 1, 0, w + 1).astype(int)]
    if method == "nearest":
        return pick(np.rint(sy), np.rint(sx))
    y0, x0 = np.floor(sy), np.floor(sx)
    ty, tx = ((v if x.ndim == 2 else v[..., None]) for v in (sy - y0, sx - x0))
    return (pick(y0, x0) * (1 - tx) + pick(y0, x0 + 1) * tx) * (1 - ty) + (pick(y0 + 1, x0) * (1 - tx) + pick(y0 + 1, x0 + 1) * tx) * ty


def rotation(h: int, w: int, degrees: float) -> np.ndarray:
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    cx, cy = (w - 1) / 2, (h - 1) / 2
    return np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy]])


def rotate(x, degrees, fill=0):
    return affine(x, rotation(*x.shape[:2], degrees), fill)


def shear_x(x, level, fill=0):
    return affine(x, np.array([[1, level, 0], [0, 1, 0.0]]), fill)


def shear_y(x, level, fill=0):
    return affine(x, np.array([[1, 0.0, 0], [level, 1, 0]]), fill)


def translate(x, dx, dy, fill=0):
    return affine(x, np.array([[1, 0, -dx], [0, 1, -dy]], float), fill)


#: IM16, IM17: the pool; each takes (image, magnitude share 0..1, sign, options, is it a mask).
def _enhance(f):
    return lambda x, s, sign, o: f(x, 1 + sign * s * o["enhance_max"])


OPERATIONS = {
    "autocontrast": lambda x, s, sign, o: autocontrast(x),
    "equalize": lambda x, s, sign, o: equalise(_u8(x)),
    "invert": lambda x, s, sign, o: 255 - x,
    "rotate": lambda x, s, sign, o: rotate(x, sign * s * o["rotate_max"], o["fill"]),
    "posterize": lambda x, s, sign, o: (_u8(x) >> (b := int(np.rint(s * o["posterize_max_bits"])))) << b,
    "solarize": lambda x, s, sign, o: np.where(x < 255 * (1 - s), x, 255 - x),
    "color": _enhance(lambda x, f: blend(gray(x), x, f)),
    "contrast": _enhance(contrast),
    "brightness": _enhance(lambda x, f: blend(np.zeros_like(x), x, f)),
    "sharpness": _enhance(sharpness),
    "shear_x": lambda x, s, sign, o: shear_x(x, sign * s * o["shear_max"], o["fill"]),
    "shear_y": lambda x, s, sign, o: shear_y(x, sign * s * o["shear_max"], o["fill"]),
    "translate_x": lambda x, s, sign, o: translate(x, sign * s * o["translate_const"], 0, o["fill"]),
    "translate_y": lambda x, s, sign, o: translate(x, 0, sign * s * o["translate_const"], o["fill"]),
}
GEOMETRIC = {"rotate", "shear_x", "shear_y", "translate_x", "translate_y"}
DEFAULTS = {"rotate_max": 30.0, "shear_max": 0.3, "enhance_max": 0.9, "posterize_max_bits": 4, "translate_const": 100.0, "fill": 0}


def rand_augment(x: np.ndarray, *, key: tuple, layers: int = 2, magnitude: float = 9.0, magnitude_std: float = 0.0, exclude: tuple = (), mask: np.ndarray | None = None, mask_fill: int = 255, **options):
    """IM16: operations at random; a paired mask follows the geometric ones."""
    rng, o = rng_of(*key), {**DEFAULTS, **options}
    pool = [n for n in OPERATIONS if n not in exclude]
    for _ in range(layers):
        name, sign = pool[int(rng.integers(len(pool)))], 1 if rng.random() < 0.5 else -1
        s = float(np.clip(magnitude + magnitude_std * rng.standard_normal(), 0, 30)) / 30
        x = np.clip(OPERATIONS[name](x, s, sign, o), 0, 255)
        if mask is not None and name in GEOMETRIC:
            mask = OPERATIONS[name](mask, s, sign, {**o, "fill": mask_fill})
    out = _u8(x)
    return out if mask is None else (out, mask)


def trivial_augment(x: np.ndarray, *, key: tuple, wide: bool = False, **options):
    """IM16: one operation, its magnitude uniform over 0..30."""
    m = int(rng_of(*key, 1).integers(31))
    own = {"rotate_max": 135.0, "shear_max": 0.99, "enhance_max": 0.99, "translate_const": 32.0} if wide else {"translate_const": 150 / 331 * x.shape[1]}
    return rand_augment(x, key=key, layers=1, magnitude=m, **{**own, **options})


# --- colour


def _hsv_shift(x: np.ndarray, hue: float, saturation: float) -> np.ndarray:
    """x in 0..1: hue turned by a share of the circle, saturation scaled."""
    hi, lo = x.max(-1), x.min(-1)
    d = hi - lo
    safe = np.where(d > 0, d, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.where(hi == r, (g - b) / safe % 6, np.where(hi == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    h = (np.where(d > 0, h, 0) + hue) % 1
    s = np.clip(np.where(hi > 0, d / np.where(hi > 0, hi, 1), 0) * saturation, 0, 1)
    k = (np.array([5, 3, 1]) + h[..., None] * 6) % 6
    return hi[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))


def photometric(x: np.ndarray, rng, brightness=32 / 255, contrast_by=0.5, saturation=0.5, hue=0.05, p=0.5) -> np.ndarray:
    """IM13: each gated; contrast first or last."""
    y = x.astype(np.float32) / 255
    if rng.random() < p:
        y = y + rng.uniform(-brightness, brightness)
    early, c = rng.random() < 0.5, rng.uniform(1 - contrast_by, 1 + contrast_by)
    gate = rng.random() < p
    change = lambda v: (v - v.mean((0, 1))) * c + v.mean((0, 1)) if gate else v
    y = change(y) if early else y
    y = np.clip(y, 0, 1)
    s = rng.uniform(1 - saturation, 1 + saturation) if rng.random() < p else 1.0
    t = rng.uniform(-hue, hue) if rng.random() < p else 0.0
    y = _hsv_shift(y, t, s)
    return np.clip((y if early else change(y)) * 255, 0, 255)


def colour_jitter(x: np.ndarray, rng, brightness=0.0, contrast_by=0.0, saturation=0.0, hue=0.0, p=1.0, p_gray=0.0) -> np.ndarray:
    """IM14"""
    y = x.astype(np.float32)
    if rng.random() < p:
        y = np.clip(y * rng.uniform(max(0, 1 - brightness), 1 + brightness), 0, 255)
        y = contrast(y, rng.uniform(max(0, 1 - contrast_by), 1 + contrast_by))
        s, h = rng.uniform(max(0, 1 - saturation), 1 + saturation), rng.uniform(-hue, hue)
        y = _hsv_shift(np.clip(y / 255, 0, 1), h, s) * 255
    return gray(y) if rng.random() < p_gray else y


# --- filters (IM24)


def reflect_pad(x: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """Mirrored without the edge; a single pixel is repeated."""
    out = x
    for axis, r in ((0, ry), (1, rx)):
        n = x.shape[axis]
        i = np.arange(-r, n + r)
        if n > 1:
            i = i % (2 * n - 2)
            i = np.where(i < n, i, 2 * n - 2 - i)
        else:
            i = np.zeros_like(i)
        out = np.take(out, i, axis)
    return out


def gaussian_kernel(sigma: float) -> np.ndarray:
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * max(sigma, 1e-12) ** 2)) if r else np.ones(1)
    return k / k.sum()


def blur(x: np.ndarray, sigma_y: float, sigma_x: float | None = None) -> np.ndarray:
    """Separable, kernels to three deviations, mirrored borders."""
    ky, kx = gaussian_kernel(sigma_y), gaussian_kernel(sigma_y if sigma_x is None else sigma_x)
    p = reflect_pad(np.asarray(x, np.float64), len(ky) // 2, len(kx) // 2)
    p = sum(k * p[i : i + x.shape[0]] for i, k in enumerate(ky))
    return sum(k * p[:, i : i + x.shape[1]] for i, k in enumerate(kx))


def correlate(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """By FFT, mirrored borders, same size."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = reflect_pad(np.asarray(x, np.float64), ry, rx)
    p = p[..., None] if p.ndim == 2 else p
    size = [a + b - 1 for a, b in zip(p.shape[:2], kernel.shape, strict=True)]
    f = np.fft.irfft2(np.fft.rfft2(p, size, axes=(0, 1)) * np.fft.rfft2(kernel[::-1, ::-1], size)[..., None], size, axes=(0, 1))
    out = f[2 * ry : 2 * ry + x.shape[0], 2 * rx : 2 * rx + x.shape[1]]
    return out if x.ndim == 3 else out[..., 0]


def splat(points: np.ndarray, weights: np.ndarray, h: int, w: int) -> np.ndarray:
    """Weights at (row, column) shared out over the four pixels around."""
    out = np.zeros((h, w))
    base = np.floor(points).astype(int)
    t = points - base
    for dy in (0, 1):
        for dx in (0, 1):
            y, x = base[:, 0] + dy, base[:, 1] + dx
            v = weights * (t[:, 0] if dy else 1 - t[:, 0]) * (t[:, 1] if dx else 1 - t[:, 1])
            ok = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            np.add.at(out, (y[ok], x[ok]), v[ok])
    return out


def gaussian_blur(x: np.ndarray, rng, p: float = 0.5, sigma=(0.1, 2.0)) -> np.ndarray:
    """IM15: nine taps."""
    if rng.random() >= p:
        return x
    s = rng.uniform(*sigma)
    k = np.exp(-(np.arange(-4, 5) ** 2) / (2 * s * s))
    return correlate(x, np.outer(k, k) / k.sum() ** 2)


def solarise(x: np.ndarray, rng, p: float = 0.2, threshold: int = 128) -> np.ndarray:
    """IM15"""
    return np.where(x < threshold, x, 255 - x) if rng.random() < p else x


def multi_crops(x: np.ndarray, *, key: tuple, count: int, size: int, scale: tuple, p_blur: float = 1.0, p_solarise: float = 0.2, jitter: float = 0.8, p_gray: float = 0.2) -> np.ndarray:
    """IM21: crops that differ in place, colour and sharpness."""
    out = []
    for i in range(count):
        rng = rng_of(*key, i)
        y = _maybe_flip(random_resized_crop(x, size, rng, scale), rng)
        y = colour_jitter(y, rng, 0.4, 0.4, 0.2, 0.1, jitter, p_gray)
        out.append(solarise(gaussian_blur(y, rng, p_blur), rng, p_solarise))
    return np.stack(out).astype(np.float32)


# --- targets


def heatmaps(h: int, w: int, boxes: np.ndarray, labels: np.ndarray, classes: int, gaussian: bool = False) -> np.ndarray:
    """IM27: boxes (y0, x0, y1, x1) in 0..1 -> [height, width, classes]."""
    out = np.zeros((h, w, classes), np.float32)
    for (y0, x0, y1, x1), c in zip(boxes, labels, strict=True):
        a, b = int(np.clip(np.floor(y0 * h), 0, h)), int(np.clip(np.ceil(y1 * h), 0, h))
        e, f = int(np.clip(np.floor(x0 * w), 0, w)), int(np.clip(np.ceil(x1 * w), 0, w))
        if not gaussian:
            out[a:b, e:f, c] = 1
            continue
        yy, xx = np.arange(a, b)[:, None] + 0.5, np.arange(e, f)[None] + 0.5
        sy, sx = max((y1 - y0) * h / 4, 1e-6), max((x1 - x0) * w / 4, 1e-6)
        g = np.exp(-((yy - (y0 + y1) * h / 2) ** 2) / (2 * sy**2) - (xx - (x0 + x1) * w / 2) ** 2 / (2 * sx**2))
        out[a:b, e:f, c] = np.maximum(out[a:b, e:f, c], g)
    return out


def panoptic_targets(mask: np.ndarray, segments: list[tuple[int, int, bool]], classes: tuple, things: tuple, capacity: int, valid: np.ndarray | None = None, void: int = 0, policy: str = "error") -> dict:
    """TGT04 on one map. segments: (segment id, category id, crowd)."""
    valid = np.ones(mask.shape, bool) if valid is None else valid
    table = {i: (c, crowd) for i, c, crowd in segments}
    if set(np.unique(mask).tolist()) - {void} != set(table) or len(table) != len(segments):
        raise ValueError("map and segment table disagree")
    ids = np.array(sorted(table) or [0])
    at = np.minimum(np.searchsorted(ids, mask), len(ids) - 1)
    crowd = np.array([table[i][1] if i in table else False for i in ids.tolist()])[at] & (mask != void)
    valid = valid & (mask != void) & ~crowd
    stuff, own = [], []
    for c in classes:
        members = [i for i in sorted(table) if table[i][0] == c and not table[i][1]]
        if c not in things:
            m = np.isin(mask, members) & valid
            if m.any():
                stuff.append((c, void, False, m))
        else:
            own += [(c, i, True, m) for i in members if (m := (mask == i) & valid).any()]
    room = capacity - len(stuff)
    order = sorted(range(len(own)), key=lambda k: (-int(own[k][3].sum()), k))
    rank = {k: r for r, k in enumerate(order)}

    def needed(k: int) -> int:
        rest = {own[j][0] for j in range(len(own)) if rank[j] >= k} if policy == "merge_by_category" else set()
        return k + len(rest)

    if policy == "error":
        fit = len(own)
        if fit > room:
            raise ValueError("panoptic target capacity exceeded")
    else:
        possible = [k for k in range(len(own) + 1) if needed(k) <= room]
        if not possible:
            raise ValueError("panoptic target capacity exceeded")
        fit = max(possible)
    keep = {k for k in range(len(own)) if rank[k] < fit}
    if policy == "merge_by_category":
        for c in things:
            left = [k for k in range(len(own)) if k not in keep and own[k][0] == c]
            keep |= set(left) if len(left) == 1 else set()
    over = [own[k] for k in range(len(own)) if k not in keep]
    merged = []
    if over and policy == "exclude_supervision":
        valid = valid & ~np.any([o[3] for o in over], axis=0)
    elif over and policy == "merge_by_category":
        merged = [(c, void, False, np.any([o[3] for o in over if o[0] == c], axis=0)) for c in dict.fromkeys(o[0] for o in over)]
    targets = stuff + [own[k] for k in range(len(own)) if k in keep] + merged
    return {"targets": targets, "pixel_valid_mask": valid, "num_targets": len(targets), "num_overflow_things": len(over), "supervision_valid": bool(valid.any())}


# --- recorded geometry


def replay(image: np.ndarray, record: dict, mask: np.ndarray | None = None, image_fill=(0, 0, 0)) -> dict:
    """GEO04: the view that a record tells: bilinear image, nearest mask, what is source and what is padding."""
    (h, w), box = record["resized_size"], record["crop_box"]
    pre, post, modes = record["pre_padding"], record["post_padding"], ("constant", "reflect", "symmetric")
    mode = modes[record["image_pad_mode"]]

    def view(x, fill, kind, method):
        y = resize(x, h, w, method, record.get("image_antialias", True)) if method != "nearest" else nearest(x, h, w)
        for pad, crop in ((pre, box), (post, None)):
            width = ((pad[0], pad[1]), (pad[2], pad[3])) + ((0, 0),) * (y.ndim - 2)
            if kind == "constant" and y.ndim == 3 and np.ndim(fill):
                y = np.stack([np.pad(y[..., c], width[:2], constant_values=fill[c]) for c in range(y.shape[2])], -1)
            else:
                y = np.pad(y, width, constant_values=fill) if kind == "constant" else np.pad(y, width, mode=kind)
            if crop is not None:
                y = y[crop[0] : crop[0] + crop[2], crop[1] : crop[1] + crop[3]]
        return y[:, ::-1] if record["horizontal_flip"] else y

    out = {"image": view(image, image_fill, mode, "bilinear"), "source_valid_mask": view(np.ones(image.shape[:2], np.uint8), 0, "constant", "nearest").astype(bool)}
    if mask is not None:
        out["mask"] = view(mask, record["mask_fill_value"], "constant", "nearest")
        out["pixel_valid_mask"] = out["source_valid_mask"] & (out["mask"] != record["mask_fill_value"])
    return out


def visible_segments(mask: np.ndarray, segments: list[tuple[int, int, bool]]) -> list[dict]:
    """GEO07: segments that still have pixels, with area and box (x, y, width, height)."""
    out = []
    for i, c, crowd in sorted(segments):
        y, x = np.nonzero(mask == i)
        if len(y):
            out.append({"segment_id": i, "category_id": c, "is_crowd": crowd, "area": len(y), "bbox": [int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)]})
    return out


def restore(scores: np.ndarray, record: dict) -> np.ndarray:
    """GEO08: [height, width, classes] of an evaluation view -> of the original."""
    (h, w), (oh, ow) = record["resized_size"], record["original_size"]
    ih, iw = record["model_input_size"]
    y = scores if scores.shape[:2] == (ih, iw) else resize(scores, ih, iw, antialias=False)
    return resize(y[:h, :w], oh, ow, antialias=False)


# --- batches


def mix_images(x: np.ndarray, y: np.ndarray, *, key: tuple, mixup: float = 0.8, cutmix: float = 1.0, p: float = 1.0, switch: float = 0.5, either: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """BA06: [rows, h, w, c] and label vectors; a share of its own for each row."""
    rng = rng_of(*key)
    q, out, labels = partner_order(len(x), rng), x.astype(np.float32).copy(), y.astype(np.float32).copy()
    h, w = x.shape[1:3]
    for i in range(len(x)):
        if rng.random() >= p:
            continue
        if cutmix > 0 and (mixup <= 0 or rng.random() < switch):
            cut = np.sqrt(1 - rng.beta(cutmix, cutmix))
            cy, cx = rng.integers(h), rng.integers(w)
            a, b = (int(np.clip(cy + s * cut * h / 2, 0, h)) for s in (-1, 1))
            e, f = (int(np.clip(cx + s * cut * w / 2, 0, w)) for s in (-1, 1))
            out[i, a:b, e:f] = x[q[i], a:b, e:f]
            share = 1 - (b - a) * (f - e) / (h * w)
        else:
            share = rng.beta(mixup, mixup)
            out[i] = share * x[i] + (1 - share) * x[q[i]]
        labels[i] = np.maximum(y[i], y[q[i]]) if either else share * y[i] + (1 - share) * y[q[i]]
    return out, labels


def erase(x: np.ndarray, *, key: tuple, p: float = 0.25, scale=(0.02, 0.33), ratio=(0.3, 3.3), fill: float = 0.0) -> np.ndarray:
    """BA07"""
    out, rng = x.copy(), rng_of(*key)
    for i in range(len(x)):
        if rng.random() < p:
            a, b, h, w = _box_of(*x.shape[1:3], rng, scale, ratio)
            out[i, a : a + h, b : b + w] = fill
    return out

"""Page images as arrays of (height, width, 3) bytes in blue, green, red order.

Every cleaning step may decline: it then returns the very array that it was given.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def to_gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    weights = np.array([0.114, 0.587, 0.299], np.float32)
    return np.clip(image[..., :3].astype(np.float32) @ weights + 0.5, 0, 255).astype(np.uint8)


def to_bgr(image: np.ndarray) -> np.ndarray:
    """Three channels from gray, from three, or from four (the fourth is dropped)."""
    if image.ndim == 2 or image.shape[2] == 1:
        return np.repeat(image.reshape(image.shape[0], image.shape[1], 1), 3, axis=2)
    return np.ascontiguousarray(image[..., :3])


def paper_colour(image: np.ndarray) -> np.ndarray:
    """The median of each channel over the four border lines."""
    pixels = to_bgr(image)
    border = np.concatenate([pixels[0], pixels[-1], pixels[:, 0], pixels[:, -1]])
    return np.median(border, axis=0).astype(np.uint8)


def background_size(height: int, width: int) -> int:
    """An odd filter size of about 5 % of the short side, from 3 to 101."""
    return min(101, max(3, int(min(height, width) * 0.05) | 1))


def _shrink_axis(values: np.ndarray, size: int) -> np.ndarray:
    """Area averaging along the first axis."""
    old = values.shape[0]
    edges = np.linspace(0, old, size + 1)
    low = np.floor(edges).astype(int).clip(0, old - 1)
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    share = (edges - low).reshape(-1, *[1] * (values.ndim - 1))
    at = sums[low] + share * values[low]
    return np.diff(at, axis=0) / (old / size)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = _shrink_axis(image, height)
    both = _shrink_axis(rows.swapaxes(0, 1), width).swapaxes(0, 1)
    return np.clip(both + 0.5, 0, 255).astype(np.uint8)


def limit_side(image: np.ndarray, longest: int) -> np.ndarray:
    """Downscaled so that no side is longer; never enlarged.  0 or less: as it is."""
    height, width = image.shape[:2]
    if longest <= 0 or max(height, width) <= longest:
        return image
    scale = longest / max(height, width)
    return resize_area(image, max(1, round(height * scale)), max(1, round(width * scale)))


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four neighbours at distances 1+t, t, 1-t, 2-t."""
    a = -0.75
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def _sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Bicubic values of ``image`` at real places; ``fill`` beyond its edges."""
    padded = np.empty((image.shape[0] + 6, image.shape[1] + 6, 3), np.float32)
    padded[:] = fill
    padded[3:-3, 3:-3] = image
    x, y = np.clip(x, -2, image.shape[1] + 1), np.clip(y, -2, image.shape[0] + 1)
    left, top = np.floor(x).astype(int), np.floor(y).astype(int)
    wx, wy = _cubic((x - left).astype(np.float32)), _cubic((y - top).astype(np.float32))
    out = np.zeros((*x.shape, 3), np.float32)
    for j in range(4):
        rows = np.clip(top + 2 + j, 0, padded.shape[0] - 1)
        for i in range(4):
            out += (wy[j] * wx[i])[..., None] * padded[rows, np.clip(left + 2 + i, 0, padded.shape[1] - 1)]
    return np.clip(out + 0.5, 0, 255).astype(np.uint8)


_BAND = 256


def _warp(image: np.ndarray, inverse: np.ndarray, height: int, width: int, fill: np.ndarray) -> np.ndarray:
    """``inverse`` maps places of the result to places of ``image``; in bands, so memory is bounded."""
    image = to_bgr(image)
    out = np.empty((height, width, 3), np.uint8)
    xs = np.arange(width, dtype=np.float64)
    for top in range(0, height, _BAND):
        ys = np.arange(top, min(top + _BAND, height), dtype=np.float64)[:, None]
        w = inverse[2, 0] * xs + inverse[2, 1] * ys + inverse[2, 2]
        x = (inverse[0, 0] * xs + inverse[0, 1] * ys + inverse[0, 2]) / w
        y = (inverse[1, 0] * xs + inverse[1, 1] * ys + inverse[1, 2]) / w
        out[top : top + len(ys)] = _sample(image, x, y, fill)
    return out


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise as seen; the canvas grows to hold all of it, its corners in paper colour."""
    height, width = image.shape[:2]
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    wide, high = math.ceil(abs(width * cos) + abs(height * sin)), math.ceil(abs(width * sin) + abs(height * cos))
    cx, cy, ox, oy = (width - 1) / 2, (height - 1) / 2, (wide - 1) / 2, (high - 1) / 2
    inverse = np.array([[cos, -sin, cx - cos * ox + sin * oy], [sin, cos, cy - sin * ox - cos * oy], [0, 0, 1]])
    return _warp(image, inverse, high, wide, paper_colour(image))


def otsu(gray: np.ndarray) -> int:
    """The threshold of the greatest variance between the two sides."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(spread), spread, -1)))


def _spread(mask: np.ndarray, width: int, height: int, least: bool = False) -> np.ndarray:
    """Dilation by a rectangle, or erosion if ``least``."""
    pick = np.logical_and if least else np.logical_or
    for axis, size in ((1, width), (0, height)):
        pads = [(0, 0), (0, 0)]
        pads[axis] = (size // 2, size - 1 - size // 2)
        wide = np.pad(mask, pads, constant_values=least)
        n, mask = mask.shape[axis], None
        for k in range(size):
            part = wide.take(range(k, k + n), axis=axis)
            mask = part if mask is None else pick(mask, part)
    return mask


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) points, in order around it."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points.astype(np.float64)

    def chain(ordered: list) -> list:
        held: list = []
        for p in ordered:
            while len(held) > 1 and (held[-1][0] - held[-2][0]) * (p[1] - held[-2][1]) <= (held[-1][1] - held[-2][1]) * (p[0] - held[-2][0]):
                held.pop()
            held.append(p)
        return held[:-1]

    ordered = points.tolist()
    return np.array(chain(ordered) + chain(ordered[::-1]), np.float64)


def _row_ends(mask: np.ndarray) -> np.ndarray:
    """The outermost set pixels of each row: they have the same hull as all."""
    rows = np.flatnonzero(mask.any(axis=1))
    left = mask[rows].argmax(axis=1)
    right = mask.shape[1] - 1 - mask[rows][:, ::-1].argmax(axis=1)
    return np.concatenate([np.stack([left, rows], 1), np.stack([right, rows], 1)])


def ink_angle(image: np.ndarray) -> float | None:
    """Degrees by which the ink's smallest enclosing rectangle leans, in (-45, 45]; positive where
    lines fall to the right.  None with too little ink (200 pixels) or too much (60 %)."""
    gray = to_gray(image)
    ink = gray <= otsu(gray)
    ink = _spread(_spread(ink, 9, 3), 9, 3, least=True)
    if not 200 <= np.count_nonzero(ink) <= 0.6 * ink.size:
        return None
    corners = hull(_row_ends(ink))
    if len(corners) < 3:
        return None
    best = None
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        angle = math.atan2(b[1] - a[1], b[0] - a[0])
        along = corners @ [math.cos(angle), math.sin(angle)]
        across = corners @ [-math.sin(angle), math.cos(angle)]
        area = np.ptp(along) * np.ptp(across)
        if best is None or area < best[0] - 1e-9:
            best = (area, math.degrees(angle))
    folded = best[1] % 90
    return folded - 90 if folded > 45 else folded


def deskew(image: np.ndarray, most: float = 15.0, least: float = 0.3) -> np.ndarray:
    angle = ink_angle(image)
    return image if angle is None or not least <= abs(angle) <= most else rotate(image, angle)


def order_corners(quad: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left."""
    quad = np.asarray(quad, np.float64)
    total, less = quad.sum(axis=1), quad[:, 1] - quad[:, 0]
    return quad[[total.argmin(), less.argmin(), total.argmax(), less.argmax()]]


def four_point(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quadrilateral seen from the front; its sides are the longer of opposite ones."""
    corners = order_corners(quad)
    a, b, c, d = corners
    width = round(max(math.dist(a, b), math.dist(d, c)))
    height = round(max(math.dist(a, d), math.dist(b, c)))
    if width < 2 or height < 2:
        return image
    target = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    rows, right = [], []
    for (x, y), (u, v) in zip(target, corners):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    try:
        inverse = np.append(np.linalg.solve(np.array(rows, np.float64), np.array(right)), 1).reshape(3, 3)
    except np.linalg.LinAlgError:
        return image
    return _warp(image, inverse, height, width, paper_colour(image))


def _components(mask: np.ndarray) -> list[np.ndarray]:
    """The (row, first, end) runs of each 8-connected component."""
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    rows, first = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    parent = np.arange(len(rows))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    starts = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist()
    f, e = first.tolist(), end.tolist()
    for y in range(1, mask.shape[0]):
        i, j = starts[y - 1], starts[y]
        while i < starts[y] and j < starts[y + 1]:
            if f[i] <= e[j] and f[j] <= e[i]:
                parent[root(j)] = root(i)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    label = np.array([root(i) for i in range(len(rows))], int)
    runs = np.stack([rows, first, end], 1)
    return [runs[label == k] for k in np.unique(label)]


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def _simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Corners of a closed convex outline, without those that its chords pass within ``tolerance``."""
    keep = list(range(len(points)))
    while len(keep) > 3:
        at = points[keep]
        before, after = np.roll(at, 1, axis=0), np.roll(at, -1, axis=0)
        chord = after - before
        off = np.abs(chord[:, 0] * (at - before)[:, 1] - chord[:, 1] * (at - before)[:, 0]) / np.maximum(np.hypot(*chord.T), 1e-9)
        if off.min() > tolerance:
            break
        keep.pop(int(off.argmin()))
    return points[keep]


def _edges(gray: np.ndarray) -> np.ndarray:
    """Strong gradients and the weaker ones that touch them, after smoothing."""
    kernel = np.array([1, 4, 6, 4, 1], np.float32) / 16
    wide = np.pad(gray.astype(np.float32), 2, mode="edge")
    soft = sum(k * wide[:, i : i + gray.shape[1]] for i, k in enumerate(kernel))
    soft = sum(k * soft[i : i + gray.shape[0]] for i, k in enumerate(kernel))
    p = np.pad(soft, 1, mode="edge")
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    return (size > 50) & _spread(size > 150, 3, 3)


def _inside(quad: np.ndarray, height: int, width: int) -> np.ndarray:
    ys, xs = np.mgrid[0:height, 0:width]
    sides = [(b[0] - a[0]) * (ys - a[1]) - (b[1] - a[1]) * (xs - a[0]) for a, b in zip(quad, np.roll(quad, -1, axis=0))]
    return np.all([s >= 0 for s in sides], axis=0) | np.all([s <= 0 for s in sides], axis=0)


def crop_to_document(image: np.ndarray, least: float = 0.25, most: float = 0.98, contrast: float = 20.0) -> np.ndarray:
    """The sheet that lies on a background, seen from the front.

    Declines below 40 pixels, and where the greatest outline is no quadrilateral of a share of the
    picture between ``least`` and ``most``, is not drawn along all its sides, or does not differ
    from what surrounds it (a printed frame)."""
    height, width = image.shape[:2]
    if min(height, width) < 40:
        return image
    small = limit_side(to_gray(image), 800)
    drawn = _spread(_edges(small), 5, 5)
    outlines = []
    for runs in _components(drawn):
        points = np.concatenate([runs[:, [1, 0]], np.stack([runs[:, 2] - 1, runs[:, 0]], 1)])
        corners = hull(points)
        if len(corners) > 3:
            outlines.append((polygon_area(corners), corners))
    if not outlines:
        return image
    corners = max(outlines, key=lambda o: o[0])[1]
    around = float(np.hypot(*(np.roll(corners, -1, axis=0) - corners).T).sum())
    quad = _simplify(corners, 0.02 * around)
    if len(quad) != 4 or not least * small.size <= polygon_area(quad) <= most * small.size:
        return image
    near = _spread(drawn, 9, 9)
    for a, b in zip(quad, np.roll(quad, -1, axis=0)):
        along = np.rint(np.linspace(a, b, 64)).astype(int).clip(0, [small.shape[1] - 1, small.shape[0] - 1])
        if near[along[:, 1], along[:, 0]].mean() < 0.8:
            return image
    within = _inside(quad, *small.shape)
    if within.all() or abs(float(np.median(small[within])) - float(np.median(small[~within]))) < contrast:
        return image
    return four_point(image, quad * [width / small.shape[1], height / small.shape[0]])


def _stretch(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear enlargement of a gray picture."""
    y = np.clip((np.arange(height) + 0.5) * values.shape[0] / height - 0.5, 0, values.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * values.shape[1] / width - 0.5, 0, values.shape[1] - 1)
    top, left = y.astype(int), x.astype(int)
    low, right = np.minimum(top + 1, values.shape[0] - 1), np.minimum(left + 1, values.shape[1] - 1)
    fy, fx = (y - top)[:, None].astype(np.float32), (x - left).astype(np.float32)
    rows = values[top] * (1 - fy) + values[low] * fy
    return rows[:, left] * (1 - fx) + rows[:, right] * fx


def background(gray: np.ndarray) -> np.ndarray:
    """The paper's own brightness: a wide median, taken on a reduced copy."""
    height, width = gray.shape
    size = background_size(height, width)
    scale = max(1, size // 9)
    small = resize_area(gray, max(1, height // scale), max(1, width // scale))
    reach = max(3, (size // scale) | 1)
    around = sliding_window_view(np.pad(small, reach // 2, mode="edge"), (reach, reach))
    return _stretch(np.median(around, axis=(2, 3)).astype(np.float32), height, width)


def equalise(gray: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation in tiles, their curves blended between tile centres."""
    height, width = gray.shape
    ys, xs = np.linspace(0, height, tiles + 1).astype(int), np.linspace(0, width, tiles + 1).astype(int)
    curves = np.zeros((tiles, tiles, 256), np.float32)
    for i in range(tiles):
        for j in range(tiles):
            tile = gray[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            counts = np.bincount(tile.ravel(), minlength=256).astype(np.float64)
            limit = max(1.0, clip * tile.size / 256)
            over = np.maximum(counts - limit, 0).sum()
            curves[i, j] = np.cumsum(np.minimum(counts, limit) + over / 256) * 255 / max(tile.size, 1)
    y = np.clip((np.arange(height) + 0.5) * tiles / height - 0.5, 0, tiles - 1)
    x = np.clip((np.arange(width) + 0.5) * tiles / width - 0.5, 0, tiles - 1)
    top, left = np.minimum(y.astype(int), tiles - 2), np.minimum(x.astype(int), tiles - 2)
    fy, fx = (y - top)[:, None], x - left
    t, m = top[:, None], left[None, :]
    mixed = (1 - fy) * ((1 - fx) * curves[t, m, gray] + fx * curves[t, m + 1, gray]) + fy * ((1 - fx) * curves[t + 1, m, gray] + fx * curves[t + 1, m + 1, gray])
    return np.clip(mixed + 0.5, 0, 255).astype(np.uint8)


def denoise(gray: np.ndarray, strength: float = 7.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: every pixel a mean of those around it, weighted by how alike their patches are."""
    height, width = gray.shape
    half, reach = patch // 2, search // 2
    wide = np.pad(gray, half + reach, mode="reflect" if min(gray.shape) > half + reach else "edge").astype(np.float32)
    out = np.empty(gray.shape, np.uint8)
    for top in range(0, height, _BAND):
        n = min(_BAND, height - top)
        home = wide[top + reach : top + reach + n + 2 * half, reach : reach + width + 2 * half]
        total, weights = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32)
        for dy in range(search):
            for dx in range(search):
                other = wide[top + dy : top + dy + n + 2 * half, dx : dx + width + 2 * half]
                sums = np.pad(np.cumsum(np.cumsum((home - other) ** 2, axis=0, dtype=np.float64), axis=1), ((1, 0), (1, 0)))
                box = sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]
                w = np.exp(-box / (patch * patch * strength * strength)).astype(np.float32)
                total += w * other[half : half + n, half : half + width]
                weights += w
        out[top : top + n] = np.clip(total / weights + 0.5, 0, 255).astype(np.uint8)
    return out


def normalise_lighting(image: np.ndarray, search: int = 21) -> np.ndarray:
    """Shadows divided out, contrast evened, noise averaged; shades of gray stay.  ``search`` 0
    leaves the noise, which takes most of the time."""
    gray = to_gray(image)
    if min(gray.shape) < 8:
        return image
    flat = np.clip(gray / np.maximum(background(gray), 1) * 255 + 0.5, 0, 255).astype(np.uint8)
    even = equalise(flat)
    return to_bgr(denoise(even, search=search) if search > 0 else even)


def clean_page(image: np.ndarray, crop: bool = True, straighten: bool = True, lighting: bool = True, longest: int = 2500, search: int = 21) -> np.ndarray:
    """Crop, deskew, limit the side, then even the light."""
    image = crop_to_document(image) if crop else image
    image = deskew(image) if straighten else image
    image = limit_side(image, longest)
    return normalise_lighting(image, search) if lighting else image


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """Lossless PNG."""
    pixels = to_bgr(image)[..., ::-1]
    height, width = pixels.shape[:2]
    if not height or not width:
        raise ValueError("an image without pixels cannot be encoded")
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), level)) + part(b"IEND", b"")


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


def tiff_frames(content: bytes, limit: int = 20) -> tuple[list[np.ndarray], int]:
    """(the first ``limit`` frames, how many there are) of a TIFF in strips: gray, black and white,
    palette or RGB(A), plain, PackBits or deflated.  ValueError for others."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(content[:4])
    if order is None:
        raise ValueError("not a TIFF")
    frames: list[np.ndarray] = []
    count, seen = 0, set()
    try:
        (at,) = struct.unpack_from(order + "I", content, 4)
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", content, at)
            tags: dict[int, tuple[int, ...]] = {}
            for k in range(n):
                where = at + 2 + 12 * k
                tag, kind, size = struct.unpack_from(order + "HHI", content, where)
                if kind in _SIZES:
                    code, wide = _SIZES[kind]
                    place = where + 8 if size * wide <= 4 else struct.unpack_from(order + "I", content, where + 8)[0]
                    tags[tag] = struct.unpack_from(f"{order}{size}{code}", content, place)
            count += 1
            if count <= max(1, limit):
                frames.append(_tiff_frame(content, tags))
            (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * n)
    except (struct.error, KeyError, zlib.error) as broken:
        raise ValueError(f"damaged TIFF: {broken}") from broken
    if not frames:
        raise ValueError("a TIFF without frames")
    return frames, count


def _tiff_frame(content: bytes, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    width, height = tags[256][0], tags[257][0]
    bits, packing, kind = tags.get(258, (1,)), tags.get(259, (1,))[0], tags[262][0]
    samples = tags.get(277, (1,))[0]
    unpack = {1: bytes, 32773: _packbits, 8: zlib.decompress, 32946: zlib.decompress}.get(packing)
    if unpack is None or tags.get(284, (1,))[0] != 1 or 322 in tags or kind > 3 or set(bits) - {1, 8} or tags.get(317, (1,))[0] not in (1, 2):
        raise ValueError("this kind of TIFF is not read")
    data = b"".join(unpack(content[a : a + n]) for a, n in zip(tags[273], tags[279]))
    line = (width * samples * bits[0] + 7) // 8
    if len(data) < line * height or not width or not height:
        raise ValueError("damaged TIFF: too few bytes")
    rows = np.frombuffer(data, np.uint8, line * height).reshape(height, line)
    pixels = np.unpackbits(rows, axis=1)[:, :width] * np.uint8(255) if bits[0] == 1 else rows.reshape(height, width, samples)
    if tags.get(317, (1,))[0] == 2:
        pixels = np.cumsum(pixels, axis=1, dtype=np.uint8)
    if kind == 3:
        colours = (np.array(tags[320], np.uint32).reshape(3, -1) >> 8).astype(np.uint8)
        return np.ascontiguousarray(colours[::-1].T[pixels.reshape(height, width) if bits[0] == 8 else pixels // 255])
    if kind == 0:
        pixels = 255 - pixels
    return to_bgr(pixels) if samples < 3 or bits[0] == 1 else np.ascontiguousarray(pixels[..., 2::-1])

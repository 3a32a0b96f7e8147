"""NumPy kernels on images: arrays (height, width) or (height, width, channels), 8-bit unless said otherwise.

Borders mirror without repeating the edge pixel, sampling has half-pixel centres, and results are rounded to even and
clamped, by the documented conventions of common image libraries. Bit-equality with any of them is not claimed.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from lumaframe.errors import FormatError, ParameterError, require

BORDERS = {"reflect_101": "reflect", "replicate": "edge", "reflect": "symmetric", "constant": "constant", "wrap": "wrap"}
SHAPES = ("rect", "cross", "ellipse")


def saturated(a: np.ndarray, like: np.ndarray | None = None) -> np.ndarray:
    """Whole 8-bit values; a float image stays float."""
    if like is not None and like.dtype.kind == "f":
        return a.astype(np.float32)
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def per_channel(f, img: np.ndarray) -> np.ndarray:
    return f(img) if img.ndim == 2 else np.stack([f(img[..., c]) for c in range(img.shape[2])], axis=2)


def framed(img: np.ndarray, top: int, bottom: int, left: int, right: int, border: str = "reflect_101", value: float = 0) -> np.ndarray:
    """The image with a margin; a mirror of more than the image's size mirrors again."""
    if border not in BORDERS:
        raise ParameterError(f"border must be one of {', '.join(BORDERS)}")
    widths = [(top, bottom), (left, right)] + [(0, 0)] * (img.ndim - 2)
    if border == "reflect_101" and 1 in img.shape[:2]:
        border = "replicate"
    return np.pad(img, widths, mode=BORDERS[border], **({"constant_values": value} if border == "constant" else {}))


# --- colour -----------------------------------------------------------------------------------------------------------


def gray(bgr: np.ndarray) -> np.ndarray:
    return saturated(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299)


def bgr_from_gray(img: np.ndarray) -> np.ndarray:
    return np.repeat(img[..., None], 3, axis=2)


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue from 0 to 179, saturation and value from 0 to 255."""
    b, g, r = (bgr[..., k].astype(float) for k in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    h = np.where(d == 0, 0, h)
    h = np.rint(np.where(h < 0, h + 180, h)) % 180
    return np.stack([h.astype(np.uint8), saturated(np.where(v == 0, 0, 255 * d / np.where(v == 0, 1, v))), v.astype(np.uint8)], axis=2)


def bgr_from_hsv(img: np.ndarray) -> np.ndarray:
    h, s, v = img[..., 0] / 30.0, img[..., 1] / 255.0, img[..., 2].astype(float)
    k = np.floor(h).astype(int) % 6
    f = h - np.floor(h)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    r, g, b = (np.choose(k, c) for c in ([v, q, p, p, t, v], [t, v, v, q, p, p], [p, p, t, v, v, q]))
    return saturated(np.stack([b, g, r], axis=2))


def ycrcb(bgr: np.ndarray) -> np.ndarray:
    y = bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299
    return saturated(np.stack([y, (bgr[..., 2] - y) * 0.713 + 128, (bgr[..., 0] - y) * 0.564 + 128], axis=2))


def bgr_from_ycrcb(img: np.ndarray) -> np.ndarray:
    y, cr, cb = img[..., 0].astype(float), img[..., 1] - 128.0, img[..., 2] - 128.0
    return saturated(np.stack([y + 1.773 * cb, y - 0.714 * cr - 0.344 * cb, y + 1.403 * cr], axis=2))


#: Linear RGB to XYZ for the D65 white point, and the white point.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def lab(bgr: np.ndarray) -> np.ndarray:
    """CIE L*a*b*, L scaled to 255, a and b moved by 128."""
    c = bgr[..., ::-1] / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ XYZ.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    level = np.where(t[..., 1] > 0.008856, 116 * np.cbrt(t[..., 1]) - 16, 903.3 * t[..., 1])
    return saturated(np.stack([level * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=2))


def bgr_from_lab(img: np.ndarray) -> np.ndarray:
    level, a, b = img[..., 0] * (100 / 255.0), img[..., 1] - 128.0, img[..., 2] - 128.0
    fy = np.where(level > 7.9996, (level + 16) / 116, level / 903.3 * 7.787 + 16 / 116)
    f = np.stack([fy + a / 500, fy, fy - b / 200], axis=2)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * WHITE
    linear = np.clip(t @ np.linalg.inv(XYZ).T, 0, 1)
    c = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return saturated(c[..., ::-1] * 255)


def convert(img: np.ndarray, source: str, target: str) -> np.ndarray:
    """One of the legal conversions between formats."""
    from lumaframe.schema import check_conversion

    check_conversion(source, target)
    steps = {
        ("BGR", "Gray"): gray, ("Gray", "BGR"): bgr_from_gray, ("BGR", "HSV"): hsv, ("HSV", "BGR"): bgr_from_hsv, ("BGR", "LAB"): lab, ("LAB", "BGR"): bgr_from_lab, ("BGR", "YCrCb"): ycrcb, ("YCrCb", "BGR"): bgr_from_ycrcb,
        ("BGR", "BGRA"): lambda i: np.dstack([i, np.full(i.shape[:2], 255, np.uint8)]), ("BGRA", "BGR"): lambda i: i[..., :3],
    }
    if (source, target) in steps:
        return steps[source, target](img)
    if source == target:
        return img
    return (img / np.float32(255)).astype(np.float32) if target.startswith("Float") else saturated(img * 255.0)


# --- neighbourhoods ---------------------------------------------------------------------------------------------------


def convolve(img: np.ndarray, kernel: np.ndarray, anchor: tuple[int, int] = (-1, -1), delta: float = 0, border: str = "reflect_101", raw: bool = False) -> np.ndarray:
    """Correlation with a kernel; raw gives the sums as floats."""
    kernel = np.asarray(kernel, float)
    require(kernel.ndim == 2 and kernel.size > 0, "a kernel has two dimensions")
    h, w = kernel.shape
    ax, ay = (w // 2 if anchor[0] < 0 else anchor[0]), (h // 2 if anchor[1] < 0 else anchor[1])

    def one(a: np.ndarray) -> np.ndarray:
        p, out = framed(a.astype(float), ay, h - 1 - ay, ax, w - 1 - ax, border), np.zeros(a.shape)
        for y, x in zip(*np.nonzero(kernel), strict=True):
            out += kernel[y, x] * p[y : y + a.shape[0], x : x + a.shape[1]]
        return out + delta

    out = per_channel(one, img)
    return out if raw else saturated(out, img)


def odd(k: int) -> None:
    require(k > 0 and k % 2 == 1, "the size must be odd and over 0")


def gaussian(k: int, sigma: float = 0) -> np.ndarray:
    odd(k)
    small = {1: [1], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}
    if sigma <= 0 and k in small:
        return np.array(small[k])
    sigma = sigma if sigma > 0 else 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    return g / g.sum()


def separable(img: np.ndarray, row: np.ndarray, column: np.ndarray, border: str = "reflect_101") -> np.ndarray:
    return convolve(convolve(img, row[None, :], border=border, raw=True), column[:, None], border=border, raw=True)


def gaussian_blur(img: np.ndarray, k: int = 5, sigma: float = 0) -> np.ndarray:
    g = gaussian(k, sigma)
    return saturated(separable(img, g, g), img)


def median_blur(img: np.ndarray, k: int = 5) -> np.ndarray:
    odd(k)
    r = k // 2
    return per_channel(lambda a: np.median(sliding_window_view(framed(a, r, r, r, r, "replicate"), (k, k)), axis=(2, 3)).astype(a.dtype), img)


def box_filter(img: np.ndarray, k: int = 3, normalize: bool = True, border: str = "reflect_101") -> np.ndarray:
    require(k > 0, "the size must be over 0")
    out = separable(img, np.ones(k), np.ones(k), border)
    return saturated(out / (k * k) if normalize else out, img)


def bilateral_filter(img: np.ndarray, d: int = 9, sigma_color: float = 75, sigma_space: float = 75) -> np.ndarray:
    require(d > 0 and sigma_color > 0 and sigma_space > 0, "sizes and sigmas must be over 0")
    r = d // 2
    a = img.astype(float) if img.ndim == 3 else img.astype(float)[..., None]
    p, total, weight = framed(a, r, r, r, r), np.zeros(a.shape), np.zeros(a.shape[:2])
    for y in range(-r, r + 1):
        for x in range(-r, r + 1):
            if x * x + y * y > r * r:
                continue
            q = p[r + y : r + y + a.shape[0], r + x : r + x + a.shape[1]]
            w = np.exp(-(x * x + y * y) / (2 * sigma_space**2) - np.abs(q - a).sum(2) ** 2 / (2 * sigma_color**2))
            total += w[..., None] * q
            weight += w
    return saturated((total / weight[..., None]).reshape(img.shape), img)


def nl_means(img: np.ndarray, h: float = 3, template: int = 7, search: int = 21, stack: list[np.ndarray] | None = None) -> np.ndarray:
    """Mean of all pixels of the search window, weighted by how alike their surroundings are; stack: more frames to search."""
    odd(template), odd(search)
    require(h > 0, "h must be over 0")
    r, s = template // 2, search // 2
    a = img.astype(float) if img.ndim == 3 else img.astype(float)[..., None]
    total, weight = np.zeros(a.shape), np.zeros(a.shape[:2])
    for other in [img] if stack is None else stack:
        p = framed(other.astype(float).reshape(a.shape), s, s, s, s)
        for y in range(search):
            for x in range(search):
                q = p[y : y + a.shape[0], x : x + a.shape[1]]
                d2 = separable(((q - a) ** 2).mean(2), np.full(template, 1 / template), np.full(template, 1 / template))
                w = np.exp(-d2 / (h * h))
                total += w[..., None] * q
                weight += w
    return saturated((total / weight[..., None]).reshape(img.shape), img)


def nl_means_multi(frames: list[np.ndarray], h: float = 3, template: int = 7, search: int = 21) -> np.ndarray:
    """The middle frame of an odd number of three or more."""
    require(len(frames) >= 3 and len(frames) % 2 == 1, "an odd number of frames, three at least")
    return nl_means(frames[len(frames) // 2], h, template, search, frames)


def unsharp_mask(img: np.ndarray, k: int = 5, sigma: float = 1.0, strength: float = 1.0) -> np.ndarray:
    require(strength >= 0, "strength must be 0 or more")
    return saturated((1 + strength) * img.astype(float) - strength * gaussian_blur(img, k, sigma).astype(float), img)


def adaptive_threshold(img: np.ndarray, block: int = 11, c: float = 2, method: str = "mean", high: int = 255) -> np.ndarray:
    odd(block)
    require(block >= 3 and method in ("mean", "gaussian"), "block must be 3 or more, method mean or gaussian")
    k = np.full(block, 1 / block) if method == "mean" else gaussian(block)
    local = saturated(separable(img, k, k, "replicate"))
    return np.where(img.astype(float) > local - c, high, 0).astype(np.uint8)


# --- edges ------------------------------------------------------------------------------------------------------------

SMOOTH, SLOPE = {3: np.array([1.0, 2, 1]), 5: np.array([1.0, 4, 6, 4, 1])}, {3: np.array([-1.0, 0, 1]), 5: np.array([-1.0, -2, 0, 2, 1])}


def sobel_gradient(img: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    require(k in SLOPE, "the size must be 3 or 5")
    return separable(img, SLOPE[k], SMOOTH[k]).astype(np.int16), separable(img, SMOOTH[k], SLOPE[k]).astype(np.int16)


def scharr_gradient(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, d = np.array([3.0, 10, 3]), np.array([-1.0, 0, 1])
    return separable(img, d, s).astype(np.int16), separable(img, s, d).astype(np.int16)


def luminance(img: np.ndarray) -> np.ndarray:
    return gray(img) if img.ndim == 3 else img


def sobel_edge(img: np.ndarray, k: int = 3) -> np.ndarray:
    dx, dy = sobel_gradient(luminance(img), k)
    return saturated(np.hypot(dx.astype(float), dy))


def laplacian_edge(img: np.ndarray, k: int = 1) -> np.ndarray:
    odd(k)
    kernel = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]]) if k == 1 else np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]])
    return saturated(np.abs(convolve(luminance(img), kernel, raw=True)))


def corner_response(img: np.ndarray, block: int = 2, k: int = 3, free: float | None = 0.04) -> np.ndarray:
    """det - free * trace ** 2 of the gradients' covariance over blocks, or its least eigenvalue if free is None."""
    dx, dy = (g.astype(float) / (255.0 * 4 * block) for g in sobel_gradient(luminance(img), k))
    one = np.ones(block)
    a, b, c = (separable(v, one, one) for v in (dx * dx, dx * dy, dy * dy))
    if free is None:
        return (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    return a * c - b * b - free * (a + c) ** 2


def harris_corner(img: np.ndarray, block: int = 2, k: int = 3, free: float = 0.04) -> np.ndarray:
    r = corner_response(img, block, k, free)
    span = r.max() - r.min()
    return saturated((r - r.min()) * 255 / span) if span > 0 else np.zeros(r.shape, np.uint8)


def canny_edge(img: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Ridges of the gradient over low that are connected to one over high."""
    require(0 <= low <= high, "low must be from 0 to high")
    dx, dy = (g.astype(float) for g in sobel_gradient(luminance(img)))
    size = np.abs(dx) + np.abs(dy)
    p = np.pad(size, 1)
    angle = np.abs(np.degrees(np.arctan2(dy, dx))) % 180
    same = (dx * dy) >= 0
    at = lambda y, x: p[1 + y : 1 + y + size.shape[0], 1 + x : 1 + x + size.shape[1]]
    flat, steep = (angle < 22.5) | (angle > 157.5), (angle > 67.5) & (angle < 112.5)
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    ridge = (size > before) & (size >= after) & (size > low)
    labels, n = connected_components(ridge.astype(np.uint8), 8)
    strong = np.zeros(n, bool)
    strong[labels[ridge & (size > high)]] = True
    strong[0] = False
    return np.where(strong[labels], 255, 0).astype(np.uint8)


# --- morphology -------------------------------------------------------------------------------------------------------


def element(shape: str = "rect", k: int = 3) -> np.ndarray:
    if shape not in SHAPES:
        raise ParameterError(f"shape must be one of {', '.join(SHAPES)}")
    odd(k)
    r = k // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    if shape == "rect" or k == 1:
        return np.ones((k, k), bool)
    if shape == "cross":
        return (x == 0) | (y == 0)
    reach = np.rint(r * np.sqrt(np.maximum(0, 1 - (y / r) ** 2)))
    return np.abs(x) <= reach


def morph(img: np.ndarray, k: int, shape: str, iterations: int, grow: bool) -> np.ndarray:
    require(iterations > 0, "iterations must be over 0")
    e, r = element(shape, k), k // 2
    best, rest = (np.maximum, 0) if grow else (np.minimum, 255 if img.dtype == np.uint8 else np.inf)

    def one(a: np.ndarray) -> np.ndarray:
        for _ in range(iterations):
            p, out = framed(a, r, r, r, r, "constant", rest if not grow or a.dtype == np.uint8 else -np.inf), None
            for y, x in zip(*np.nonzero(e), strict=True):
                part = p[y : y + a.shape[0], x : x + a.shape[1]]
                out = part.copy() if out is None else best(out, part)
            a = out
        return a

    return per_channel(one, img)


def dilate(img: np.ndarray, k: int = 3, shape: str = "rect", iterations: int = 1) -> np.ndarray:
    return morph(img, k, shape, iterations, True)


def erode(img: np.ndarray, k: int = 3, shape: str = "rect", iterations: int = 1) -> np.ndarray:
    return morph(img, k, shape, iterations, False)


def morph_open(img: np.ndarray, k: int = 3, shape: str = "rect", iterations: int = 1) -> np.ndarray:
    return dilate(erode(img, k, shape, iterations), k, shape, iterations)


def morph_close(img: np.ndarray, k: int = 3, shape: str = "rect", iterations: int = 1) -> np.ndarray:
    return erode(dilate(img, k, shape, iterations), k, shape, iterations)


def morph_gradient(img: np.ndarray, k: int = 3, shape: str = "rect") -> np.ndarray:
    return dilate(img, k, shape) - erode(img, k, shape)


def top_hat(img: np.ndarray, k: int = 9, shape: str = "rect") -> np.ndarray:
    return img - morph_open(img, k, shape)


def black_hat(img: np.ndarray, k: int = 9, shape: str = "rect") -> np.ndarray:
    return morph_close(img, k, shape) - img


# --- regions ----------------------------------------------------------------------------------------------------------


def connected_components(img: np.ndarray, connectivity: int = 8) -> tuple[np.ndarray, int]:
    """Labels of the non-zero regions, numbered in the order of their first pixels by rows, and their number with the ground, 0."""
    require(connectivity in (4, 8), "connectivity must be 4 or 8")
    label, n = np.zeros(img.shape, np.int32), 1
    around = [(-1, 0), (0, -1), (0, 1), (1, 0)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else [])
    for y, x in zip(*np.nonzero(img), strict=True):
        if label[y, x]:
            continue
        label[y, x] = n
        queue = deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for dy, dx in around:
                c, d = a + dy, b + dx
                if 0 <= c < img.shape[0] and 0 <= d < img.shape[1] and img[c, d] and not label[c, d]:
                    label[c, d] = n
                    queue.append((c, d))
        n += 1
    return label, n


def distance_transform(img: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Exact distance of each pixel to the nearest zero pixel: l1, l2 or c. Lower envelopes, one axis after the other."""
    require(metric in ("l1", "l2", "c"), "metric must be l1, l2 or c")
    h, w = img.shape
    far = float(h + w)
    gap = np.where(img == 0, 0.0, far)
    for y in range(1, h):
        gap[y] = np.minimum(gap[y], gap[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        gap[y] = np.minimum(gap[y], gap[y + 1] + 1)
    across = np.abs(np.arange(w)[:, None] - np.arange(w)[None, :]).astype(float)
    join = {"l1": lambda g: g[:, None, :] + across, "l2": lambda g: np.hypot(g[:, None, :], across), "c": lambda g: np.maximum(g[:, None, :], across)}[metric]
    return join(gap).min(2).astype(np.float32)


def flood_fill(img: np.ndarray, seed: tuple[int, int], value, low: float = 0, high: float = 0) -> np.ndarray:
    """The region around seed (x, y) whose neighbours differ by low at most downwards and high upwards, in the new value."""
    x0, y0 = seed
    require(0 <= x0 < img.shape[1] and 0 <= y0 < img.shape[0], "the seed must lie in the image")
    a, out = img.astype(float).reshape(*img.shape[:2], -1), img.copy()
    seen, queue = np.zeros(img.shape[:2], bool), deque([(y0, x0)])
    seen[y0, x0] = True
    while queue:
        y, x = queue.popleft()
        out[y, x] = value
        for c, d in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= c < img.shape[0] and 0 <= d < img.shape[1] and not seen[c, d] and ((a[c, d] >= a[y, x] - low) & (a[c, d] <= a[y, x] + high)).all():
                seen[c, d] = True
                queue.append((c, d))
    return out


def watershed(img: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Markers grown over the image, least colour step first; -1 where two meet, and on the border."""
    import heapq

    label, heap, n = markers.astype(np.int32).copy(), [], 0
    h, w = label.shape
    a = img.astype(int).reshape(h, w, -1)
    queued = label > 0

    def push(y: int, x: int, level: int) -> None:
        nonlocal n
        for c, d in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 < c < h - 1 and 0 < d < w - 1 and not queued[c, d]:
                queued[c, d] = True
                heapq.heappush(heap, (max(level, int(np.abs(a[c, d] - a[y, x]).max())), n, c, d))
                n += 1

    for y, x in zip(*np.nonzero(label > 0), strict=True):
        push(int(y), int(x), 0)
    while heap:
        level, _, y, x = heapq.heappop(heap)
        near = {int(label[c, d]) for c, d in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if label[c, d] > 0}
        label[y, x] = near.pop() if len(near) == 1 else -1
        if label[y, x] > 0:
            push(y, x, level)
    label[[0, -1], :] = -1
    label[:, [0, -1]] = -1
    return label


def clahe(img: np.ndarray, clip: float = 40, tiles: int = 8) -> np.ndarray:
    """Equalisation by tiles with clipped histograms, blended between the tiles' centres; of a colour image the L channel."""
    require(clip > 0 and tiles > 0, "clip and tiles must be over 0")
    if img.ndim == 3:
        c = lab(img)
        return bgr_from_lab(np.dstack([clahe(c[..., 0], clip, tiles), c[..., 1:]]))
    h, w = img.shape
    p = framed(img, 0, -h % tiles, 0, -w % tiles)
    th, tw = p.shape[0] // tiles, p.shape[1] // tiles
    area, table = th * tw, np.empty((tiles, tiles, 256))
    limit = max(int(clip * area / 256), 1)
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // 256
            rest = over % 256
            if rest:
                hist[: 256 : max(256 // rest, 1)][:rest] += 1
            table[i, j] = np.rint(np.cumsum(hist) * 255.0 / area)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    clip_ = lambda k: np.clip(k, 0, tiles - 1)
    at = lambda y, x: table[clip_(y)[:, None], clip_(x)[None, :], img]
    return saturated((at(y0, x0) * (1 - ax) + at(y0, x0 + 1) * ax) * (1 - ay) + (at(y0 + 1, x0) * (1 - ax) + at(y0 + 1, x0 + 1) * ax) * ay)


def equalize(img: np.ndarray) -> np.ndarray:
    """Of a colour image the Y channel."""
    if img.ndim == 3:
        c = ycrcb(img)
        return bgr_from_ycrcb(np.dstack([equalize(c[..., 0]), c[..., 1:]]))
    hist = np.bincount(img.ravel(), minlength=256)
    first = int(np.flatnonzero(hist)[0])
    if hist[first] == img.size:
        return img.copy()
    run = np.cumsum(hist)
    return saturated((run - hist[first]) * 255.0 / (img.size - hist[first]))[img]


# --- geometry ---------------------------------------------------------------------------------------------------------


def sampled(img: np.ndarray, x: np.ndarray, y: np.ndarray, border: str = "constant", value: float = 0) -> np.ndarray:
    """Bilinear samples at (x, y)."""
    a = img.astype(float).reshape(*img.shape[:2], -1)
    h, w = a.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]

    def at(j: np.ndarray, i: np.ndarray) -> np.ndarray:
        v = a[np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)]
        if border == "replicate":
            return v
        return np.where(((j >= 0) & (j < h) & (i >= 0) & (i < w))[..., None], v, value)

    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return saturated(out.reshape(*x.shape, *img.shape[2:]), img)


def resize(img: np.ndarray, width: int | None = None, height: int | None = None) -> np.ndarray:
    """A side that isn't given follows from the aspect ratio."""
    require(bool(width or height) and all(v is None or v > 0 for v in (width, height)), "give a width or a height, over 0")
    h, w = img.shape[:2]
    width, height = width or max(1, round(w * height / h)), height or max(1, round(h * width / w))
    x, y = np.meshgrid((np.arange(width) + 0.5) * w / width - 0.5, (np.arange(height) + 0.5) * h / height - 0.5)
    return sampled(img, np.clip(x, 0, w - 1), np.clip(y, 0, h - 1), "replicate")


def resize_area(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel the mean of the area it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(n) + 1)
        return np.clip(high - low, 0, None) * m / n

    return saturated(per_channel(lambda a: weights(img.shape[0], height) @ a.astype(float) @ weights(img.shape[1], width).T, img), img)


def letter_box(img: np.ndarray, width: int, height: int, fill: int = 114) -> np.ndarray:
    """Fitted into the canvas; an odd pixel of margin goes to the bottom or right."""
    scale = min(width / img.shape[1], height / img.shape[0])
    w, h = max(1, round(img.shape[1] * scale)), max(1, round(img.shape[0] * scale))
    dx, dy = width - w, height - h
    return framed(resize(img, w, h), dy // 2, dy - dy // 2, dx // 2, dx - dx // 2, "constant", fill)


def warp_affine(img: np.ndarray, matrix: np.ndarray, width: int | None = None, height: int | None = None, value: float = 0) -> np.ndarray:
    matrix = np.asarray(matrix, float)
    require(matrix.shape == (2, 3), "an affine matrix is 2 x 3")
    return warp_perspective(img, np.vstack([matrix, [0, 0, 1]]), width, height, value)


def warp_perspective(img: np.ndarray, matrix: np.ndarray, width: int | None = None, height: int | None = None, value: float = 0) -> np.ndarray:
    matrix = np.asarray(matrix, float)
    require(matrix.shape == (3, 3), "a homography is 3 x 3")
    x, y = np.meshgrid(np.arange(width or img.shape[1], dtype=float), np.arange(height or img.shape[0], dtype=float))
    p = np.linalg.inv(matrix) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    z = np.where(p[2] == 0, np.inf, p[2])
    return sampled(img, (p[0] / z).reshape(x.shape), (p[1] / z).reshape(x.shape), "constant", value)


def rotate(img: np.ndarray, degrees: float, scale: float = 1.0) -> np.ndarray:
    """About the centre, counter-clockwise, on the same canvas."""
    require(scale > 0, "scale must be over 0")
    h, w = img.shape[:2]
    cx, cy = w / 2, h / 2
    a, b = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    return warp_affine(img, np.array([[a, b, (1 - a) * cx - b * cy], [-b, a, b * cx + (1 - a) * cy]]))


def remap(img: np.ndarray, map_x: np.ndarray, map_y: np.ndarray) -> np.ndarray:
    require(map_x.shape == map_y.shape, "maps have one size")
    return sampled(img, map_x.astype(float), map_y.astype(float))


def pyr_down(img: np.ndarray) -> np.ndarray:
    g = gaussian(5)
    return saturated(separable(img, g, g)[::2, ::2], img)


def pyr_up(img: np.ndarray) -> np.ndarray:
    big = np.zeros((2 * img.shape[0], 2 * img.shape[1], *img.shape[2:]))
    big[::2, ::2] = img
    g = 2 * gaussian(5)
    return saturated(separable(big, g, g), img)


# --- likeness and hashes ----------------------------------------------------------------------------------------------


def same_size(a: np.ndarray, b: np.ndarray) -> None:
    if a.shape != b.shape:
        raise FormatError("the images differ in size")


def mse(a: np.ndarray, b: np.ndarray) -> float:
    same_size(a, b)
    return float(((a.astype(float) - b) ** 2).mean())


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    e = mse(a, b)
    return math.inf if e < 1e-10 else 10 * math.log10(255 * 255 / e)


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over channels of the structural similarity under an 11 x 11 Gaussian of deviation 1.5."""
    same_size(a, b)
    g, c1, c2 = gaussian(11, 1.5), 6.5025, 58.5225
    x, y = a.astype(float), b.astype(float)
    blur = lambda v: separable(v, g, g)
    mx, my = blur(x), blur(y)
    vx, vy, xy = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
    return float((((2 * mx * my + c1) * (2 * xy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def gmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Population deviation of the likeness of Prewitt gradients."""
    same_size(a, b)
    s, d = np.ones(3) / 3, np.array([1.0, 0, -1])

    def size(v: np.ndarray) -> np.ndarray:
        v = luminance(v).astype(float)
        return np.hypot(separable(v, d, s), separable(v, s, d))

    x, y = size(a), size(b)
    return float(((2 * x * y + 0.0026) / (x * x + y * y + 0.0026)).std())


def bits_to_words(bits: np.ndarray) -> list[int]:
    """Signed 64-bit words, the first bit lowest."""
    data = np.packbits(bits.ravel().astype(bool), bitorder="little")
    return np.frombuffer(data.tobytes() + bytes(-len(data) % 8), "<i8").tolist()


def average_hash(img: np.ndarray) -> list[int]:
    small = resize_area(luminance(img), 8, 8)
    return bits_to_words(small > small.mean())


def p_hash(img: np.ndarray) -> list[int]:
    """63 of the lowest 8 x 8 cosine coefficients of a 32 x 32 image against their mean; the constant one is left out."""
    small = resize(luminance(img), 32, 32).astype(float)
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 64) * np.where(n[:, None] == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))
    low = (basis @ small @ basis.T)[:8, :8].ravel()[1:]
    return bits_to_words(np.append(low > low.mean(), False))


def marr_hildreth_hash(img: np.ndarray) -> list[int]:
    small = gaussian_blur(resize(luminance(img), 24, 24), 5, 1.0)
    return bits_to_words(convolve(small, np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]]), raw=True) >= 0)


def radial_variance_hash(img: np.ndarray) -> list[float]:
    """Population variance of the pixels along 40 lines through the centre of a 64 x 64 image."""
    small, out, r = resize(luminance(img), 64, 64).astype(float), [], np.arange(-31, 32)
    for k in range(40):
        t = math.pi * k / 40
        x, y = np.rint(31.5 + r * math.cos(t)).astype(int), np.rint(31.5 + r * math.sin(t)).astype(int)
        out.append(float(small[np.clip(y, 0, 63), np.clip(x, 0, 63)].var()))
    return out


def color_moment_hash(img: np.ndarray) -> list[float]:
    """Mean, deviation, skewness, kurtosis (not the excess), fifth and sixth moments and 8 shares for each channel."""
    small, out = ycrcb(resize(img if img.ndim == 3 else bgr_from_gray(img), 16, 16)).astype(float), []
    for c in range(3):
        v = small[..., c].ravel()
        m, s = v.mean(), v.std()
        z = (v - m) / s if s > 1e-10 else np.zeros(v.size)
        out += [float(m), float(s), *[float((z**k).mean()) for k in (3, 4, 5, 6)], *(np.histogram(v, 8, (0, 256))[0] / v.size).tolist()]
    return out


def block_mean_hash(img: np.ndarray) -> list[int]:
    small = resize(luminance(img), 256, 256).astype(float)
    blocks = small.reshape(16, 16, 16, 16).mean(axis=(1, 3))
    return bits_to_words(blocks > small.mean())


def match_template(img: np.ndarray, templ: np.ndarray, method: str = "ccoeff_normed") -> tuple[int, int, float]:
    """x, y and score of the best place; the sqdiff methods take the least."""
    methods = ("sqdiff", "sqdiff_normed", "ccorr", "ccorr_normed", "ccoeff", "ccoeff_normed")
    if method not in methods:
        raise ParameterError(f"method must be one of {', '.join(methods)}")
    require(templ.shape[0] <= img.shape[0] and templ.shape[1] <= img.shape[1] and templ.ndim == img.ndim, "the template must fit into the image")
    a, t = (v.astype(float).reshape(*v.shape[:2], -1) for v in (img, templ))
    w = sliding_window_view(a, t.shape[:2], axis=(0, 1)).transpose(0, 1, 3, 4, 2)
    if method.startswith("ccoeff"):
        w, t = w - w.mean(axis=(2, 3), keepdims=True), t - t.mean(axis=(0, 1))
    cross, own, power = (w * t).sum((2, 3, 4)), (w * w).sum((2, 3, 4)), (t * t).sum()
    score = own - 2 * cross + power if method.startswith("sqdiff") else cross
    if method.endswith("normed"):
        size = np.sqrt(own * power)
        score = np.divide(score, size, out=np.ones_like(score) if method.startswith("sqdiff") else np.zeros_like(score), where=size > 1e-12)
    at = int(score.argmin() if method.startswith("sqdiff") else score.argmax())
    y, x = divmod(at, score.shape[1])
    return x, y, float(score[y, x])


def phase_correlate(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """dx, dy and response of the shift from a to b, under a Hann window; the peak is refined by its 5 x 5 centroid."""
    same_size(a, b)
    h, w = a.shape
    hann = np.outer(np.hanning(h), np.hanning(w))
    cross = np.conj(np.fft.fft2(a * hann)) * np.fft.fft2(b * hann)
    size = np.abs(cross)
    peak = np.fft.fftshift(np.fft.ifft2(np.divide(cross, size, out=np.zeros_like(cross), where=size > 1e-12)).real)
    y, x = np.unravel_index(int(peak.argmax()), peak.shape)
    ys, xs = np.arange(max(0, y - 2), min(h, y + 3)), np.arange(max(0, x - 2), min(w, x + 3))
    part = np.clip(peak[np.ix_(ys, xs)], 0, None)
    total = part.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    return float((part.sum(0) * xs).sum() / total - w // 2), float((part.sum(1) * ys).sum() / total - h // 2), float(total)

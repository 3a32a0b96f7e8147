"""Detectors, descriptors, contours and segmentation on single images: published algorithms in NumPy, parity not checked.

Detectors give rows (x, y, size, angle, response, octave), strongest first; ties by place. One image to many rows is an array
column and explode (see exploded).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.errors import require
from lumaframe.operators import kernels as K
from lumaframe.operators.images import measured

KEYPOINTS = "array<struct<x: float, y: float, size: float, angle: float, response: float, octave: int, class_id: int>>"

#: The circle of radius 3 around a pixel, as (dy, dx), clockwise from the top.
CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


def exploded(df: DataFrame, detector: Callable[[np.ndarray], list], result: str, column: str = "image") -> DataFrame:
    """A row for each thing the detector finds in the image, with ``k`` its place in the list."""
    return measured(df, detector, result, column).select(*df.columns, F.posexplode("value").alias("k", "found"))


def keypoints(x: np.ndarray, y: np.ndarray, size: float, angle, response: np.ndarray, octave: int = 0) -> list[dict]:
    order = np.lexsort((x, y, -response))
    angle = np.broadcast_to(angle, x.shape)
    return [{"x": float(x[i]), "y": float(y[i]), "size": float(size), "angle": float(angle[i]), "response": float(response[i]), "octave": octave, "class_id": -1} for i in order]


def local_maxima(r: np.ndarray) -> np.ndarray:
    """Places that no neighbour exceeds."""
    return r >= sliding_window_view(np.pad(r, 1, constant_values=-np.inf), (3, 3)).max((2, 3))


def detect_fast(img: np.ndarray, threshold: int = 10, suppress: bool = True) -> list[dict]:
    """Corners with nine pixels in a row of the circle all brighter, or all darker, by over the threshold."""
    a = K.luminance(img).astype(int)
    h, w = a.shape
    if h < 7 or w < 7:
        return []
    ring = np.stack([a[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dy, dx in CIRCLE]) - a[3:-3, 3:-3]
    ring = np.concatenate([ring, ring[:8]])
    run = sliding_window_view(ring, 9, axis=0)
    score = np.maximum(run.min(-1).max(0), (-run).min(-1).max(0)) - 1
    corner = score >= threshold
    if suppress:
        corner &= local_maxima(score.astype(float))
    y, x = np.nonzero(corner)
    return keypoints(x + 3, y + 3, 7, -1, score[y, x].astype(float))


def good_features(img: np.ndarray, most: int = 100, quality: float = 0.01, distance: float = 10, harris: bool = False) -> list[tuple[float, float]]:
    """Corners by the least eigenvalue (or Harris), the strongest first, none nearer to a stronger one than distance."""
    require(quality > 0 and distance >= 0, "quality must be over 0, distance 0 or more")
    r = K.corner_response(img, 3, 3, 0.04 if harris else None)
    good = local_maxima(r) & (r > quality * r.max())
    y, x = np.nonzero(good)
    out: list[tuple[float, float]] = []
    for i in np.lexsort((x, y, -r[y, x])):
        if all((x[i] - p) ** 2 + (y[i] - q) ** 2 >= distance * distance for p, q in out):
            out.append((float(x[i]), float(y[i])))
            if most > 0 and len(out) == most:
                break
    return out


def pyramid(img: np.ndarray, levels: int, factor: float) -> list[np.ndarray]:
    return [K.resize(img, max(1, round(img.shape[1] / factor**k)), max(1, round(img.shape[0] / factor**k))) if k else img for k in range(levels)]


def orientation(a: np.ndarray, x: int, y: int, r: int = 15) -> float:
    p = a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].astype(float)
    v, u = np.mgrid[max(0, y - r) - y : max(0, y - r) - y + p.shape[0], max(0, x - r) - x : max(0, x - r) - x + p.shape[1]]
    disc = u * u + v * v <= r * r
    return math.degrees(math.atan2((v * p * disc).sum(), (u * p * disc).sum())) % 360


def detect_orb(img: np.ndarray, most: int = 500, factor: float = 1.2, levels: int = 8) -> list[dict]:
    """FAST corners over a pyramid, ranked by Harris response, with the angle to the centre of brightness."""
    out = []
    for k, a in enumerate(pyramid(K.luminance(img), levels, factor)):
        r = K.corner_response(a, 7)
        for p in detect_fast(a, 20):
            x, y = int(p["x"]), int(p["y"])
            if 16 <= x < a.shape[1] - 16 and 16 <= y < a.shape[0] - 16:
                s = factor**k
                out.append(p | {"x": x * s, "y": y * s, "size": 31 * s, "angle": orientation(a, x, y), "response": float(r[y, x]), "octave": k})
    return sorted(out, key=lambda p: (-p["response"], p["y"], p["x"]))[:most]


def pair_places(n: int = 256, reach: float = 13, seed: int = 0x34985739) -> np.ndarray:
    """Pairs of places for binary descriptors, drawn once by a rule."""
    return np.clip(np.rint(np.random.default_rng(seed).normal(0, reach / 2.5, (n, 4))), -reach, reach).astype(int)


def describe_orb(img: np.ndarray, points: list[dict] | None = None) -> tuple[list[dict], np.ndarray]:
    """256 brightness tests around each keypoint, turned by its angle, on the smoothed image; always of the default detector if none are given."""
    points = detect_orb(img) if points is None else points
    a, pairs, kept, out = K.gaussian_blur(K.luminance(img), 7, 2).astype(int), pair_places(), [], []
    for p in points:
        c, s = math.cos(math.radians(p["angle"])), math.sin(math.radians(p["angle"]))
        turn = lambda u, v: (np.rint(p["x"] + c * u - s * v).astype(int), np.rint(p["y"] + s * u + c * v).astype(int))  # noqa: B023, E731
        (x1, y1), (x2, y2) = turn(pairs[:, 0], pairs[:, 1]), turn(pairs[:, 2], pairs[:, 3])
        if min(x1.min(), x2.min(), y1.min(), y2.min()) < 0 or max(x1.max(), x2.max()) >= a.shape[1] or max(y1.max(), y2.max()) >= a.shape[0]:
            continue
        kept.append(p)
        out.append(np.packbits(a[y1, x1] < a[y2, x2], bitorder="little"))
    return kept, np.array(out, np.uint8).reshape(-1, 32)


def detect_sift(img: np.ndarray, layers: int = 3, contrast: float = 0.04, edge: float = 10, sigma: float = 1.6) -> list[dict]:
    """Extrema of differences of Gaussians over scale and place, without low contrast and edges."""
    a, out, octave = K.luminance(img).astype(np.float32) / 255, [], 0
    while min(a.shape) >= 16:
        blurred = [blur_by(a, sigma * 2 ** (k / layers)) for k in range(layers + 3)]
        d = np.stack([b - c for b, c in zip(blurred[1:], blurred, strict=False)])
        cube = sliding_window_view(np.pad(d, ((0, 0), (1, 1), (1, 1)), mode="edge"), (3, 3, 3))
        for k in range(1, layers + 1):
            m, block = d[k], cube[k - 1]
            top = ((m == block.max((2, 3, 4))) | (m == block.min((2, 3, 4)))) & (np.abs(m) > contrast / layers)
            dxx = np.gradient(np.gradient(m, axis=1), axis=1)
            dyy, dxy = np.gradient(np.gradient(m, axis=0), axis=0), np.gradient(np.gradient(m, axis=0), axis=1)
            det, trace = dxx * dyy - dxy * dxy, dxx + dyy
            top &= (det > 0) & (trace * trace * edge < (edge + 1) ** 2 * det)
            y, x = np.nonzero(top)
            s = 2.0**octave
            for i in range(len(x)):
                size = sigma * 2 ** (k / layers)
                angle = gradient_angle(blurred[k], int(x[i]), int(y[i]), size * 1.5)
                out.append({"x": float(x[i] * s), "y": float(y[i] * s), "size": float(2 * size * s), "angle": angle, "response": float(abs(m[y[i], x[i]])), "octave": octave, "class_id": -1})
        a, octave = a[::2, ::2], octave + 1
    return sorted(out, key=lambda p: (-p["response"], p["y"], p["x"]))


def blur_by(a: np.ndarray, sigma: float) -> np.ndarray:
    g = K.gaussian(2 * math.ceil(3 * sigma) + 1, sigma)
    return K.separable(a, g, g)


def gradients(a: np.ndarray, x: int, y: int, r: int) -> tuple[np.ndarray, ...]:
    y0, y1, x0, x1 = max(1, y - r), min(a.shape[0] - 1, y + r + 1), max(1, x - r), min(a.shape[1] - 1, x + r + 1)
    dx, dy = a[y0:y1, x0 + 1 : x1 + 1] - a[y0:y1, x0 - 1 : x1 - 1], a[y0 + 1 : y1 + 1, x0:x1] - a[y0 - 1 : y1 - 1, x0:x1]
    v, u = np.mgrid[y0 - y : y1 - y, x0 - x : x1 - x]
    return np.hypot(dx, dy), np.degrees(np.arctan2(dy, dx)) % 360, u, v


def gradient_angle(a: np.ndarray, x: int, y: int, sigma: float) -> float:
    size, angle, u, v = gradients(a, x, y, round(3 * sigma))
    hist = np.bincount((angle.ravel() / 10).astype(int) % 36, (size * np.exp(-(u * u + v * v) / (2 * sigma * sigma))).ravel(), 36)
    return float(hist.argmax() * 10 + 5)


def describe_sift(img: np.ndarray, points: list[dict] | None = None) -> tuple[list[dict], np.ndarray]:
    """4 x 4 cells of 8 gradient directions around each keypoint, turned by its angle; of length 1 with entries of 0.2 at most, times 512."""
    points = detect_sift(img) if points is None else points
    a, out = K.luminance(img).astype(float), []
    for p in points:
        step = max(p["size"] * 1.5 / 2, 1.0)
        size, angle, u, v = gradients(a, round(p["x"]), round(p["y"]), round(step * 3.5))
        c, s = math.cos(math.radians(p["angle"])), math.sin(math.radians(p["angle"]))
        col, row = (c * u + s * v) / step + 2, (c * v - s * u) / step + 2
        inside = (col >= 0) & (col < 4) & (row >= 0) & (row < 4)
        bins = (row[inside].astype(int) * 4 + col[inside].astype(int)) * 8 + (((angle[inside] - p["angle"]) % 360) / 45).astype(int) % 8
        d = np.bincount(bins, (size * np.exp(-((col - 2) ** 2 + (row - 2) ** 2) / 8))[inside], 128)
        for _ in range(2):
            d = np.minimum(d / max(float(np.linalg.norm(d)), 1e-12), 0.2)
        out.append(np.clip(np.rint(512 * d / max(float(np.linalg.norm(d)), 1e-12)), 0, 255))
    return points, np.array(out, np.float32).reshape(-1, 128)


def detect_kaze(img: np.ndarray, threshold: float = 0.001, octaves: int = 4, layers: int = 4) -> list[dict]:
    """Maxima of the Hessian's determinant over a scale space of edge-stopping diffusion."""
    a, out, t = K.luminance(img).astype(float) / 255, [], 0.0
    gy, gx = np.gradient(blur_by(a, 1.0))
    k = max(float(np.percentile(np.hypot(gx, gy), 70)), 1e-4)
    for level in range(octaves * layers):
        sigma = 1.6 * 2 ** (level / layers)
        goal = sigma * sigma / 2
        while t < goal:
            gy, gx = np.gradient(blur_by(a, 1.0))
            flow, dt = 1 / (1 + (gx * gx + gy * gy) / (k * k)), min(0.25, goal - t)
            p, f = np.pad(a, 1, mode="edge"), np.pad(flow, 1, mode="edge")
            a = a + dt * sum((p[1 + y : p.shape[0] - 1 + y, 1 + x : p.shape[1] - 1 + x] - a) * (f[1 + y : f.shape[0] - 1 + y, 1 + x : f.shape[1] - 1 + x] + flow) / 2 for y, x in ((0, 1), (0, -1), (1, 0), (-1, 0)))
            t += dt
        gy, gx = np.gradient(a)
        det = sigma**4 * (np.gradient(gx, axis=1) * np.gradient(gy, axis=0) - np.gradient(gx, axis=0) ** 2)
        y, x = np.nonzero(local_maxima(det) & (det > threshold))
        out += keypoints(x, y, 2 * sigma, 0, det[y, x], level // layers)
    return sorted(out, key=lambda p: (-p["response"], p["y"], p["x"]))


detect_akaze = detect_kaze


def detect_brisk(img: np.ndarray, threshold: int = 30, octaves: int = 3) -> list[dict]:
    """FAST corners over a pyramid of octaves."""
    out = []
    for k, a in enumerate(pyramid(K.luminance(img), octaves + 1, 2.0)):
        s = 2.0**k
        out += [p | {"x": p["x"] * s, "y": p["y"] * s, "size": 12 * s, "angle": orientation(a, int(p["x"]), int(p["y"]), 6), "octave": k} for p in detect_fast(a, threshold)]
    return sorted(out, key=lambda p: (-p["response"], p["y"], p["x"]))


def describe_with(detector: Callable, describer: Callable) -> Callable[[np.ndarray], tuple[list[dict], np.ndarray]]:
    return lambda img: describer(img, detector(img))


describe_brisk, describe_akaze, describe_kaze = describe_with(detect_brisk, describe_orb), describe_with(detect_akaze, describe_orb), describe_with(detect_kaze, describe_sift)


def detect_blob(img: np.ndarray, low: int = 50, high: int = 220, step: int = 10, area: tuple[float, float] = (25, 5000), repeat: int = 2, apart: float = 10) -> list[dict]:
    """Dark regions that last over several thresholds."""
    a, groups = K.luminance(img), []
    for t in range(low, high, step):
        label, n = K.connected_components(a <= t, 8)
        for k in range(1, n):
            y, x = np.nonzero(label == k)
            if area[0] <= len(x) <= area[1]:
                c = (float(x.mean()), float(y.mean()), math.sqrt(len(x) / math.pi))
                near = next((g for g in groups if math.dist(g[-1][:2], c[:2]) < apart), None)
                near.append(c) if near else groups.append([c])
    good = [np.mean(g, axis=0) for g in groups if len(g) >= repeat]
    return [{"x": float(x), "y": float(y), "size": float(2 * r), "angle": -1.0, "response": 0.0, "octave": 0, "class_id": -1} for x, y, r in good]


def detect_mser(img: np.ndarray, delta: int = 5, area: tuple[int, int] = (60, 14400), most: float = 0.25) -> list[dict]:
    """Regions under a rising threshold whose size changes least: their box (x, y, w, h) and pixels' number."""
    a, last, out = K.luminance(img).astype(int), {}, []
    for t in range(0, 256, delta):
        label, n = K.connected_components(a <= t, 8)
        now = {}
        for k in range(1, n):
            y, x = np.nonzero(label == k)
            if area[0] <= len(x) <= area[1]:
                now[int(y[0]) * a.shape[1] + int(x[0])] = (len(x), int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1))
        out += [{"x": b[1], "y": b[2], "w": b[3], "h": b[4], "area": b[0]} for key, b in now.items() if key in last and (b[0] - last[key][0]) / last[key][0] < most and b[0] > last[key][0]]
        last = now
    return out


def hough_lines_p(img: np.ndarray, rho: float = 1, theta: float = math.pi / 180, votes: int = 50, length: float = 50, gap: float = 10) -> list[tuple[int, int, int, int]]:
    """Segments of edge pixels along all lines of at least so many votes, most votes first; all pixels vote, so nothing is drawn by chance."""
    edge = img > 0
    angles = np.arange(0, math.pi, theta)
    y, x = np.nonzero(edge)
    reach = math.hypot(*img.shape)
    at = np.rint((x[:, None] * np.cos(angles) + y[:, None] * np.sin(angles) + reach) / rho).astype(int)
    count = np.zeros((int(2 * reach / rho) + 3, len(angles)), int)
    np.add.at(count, (at, np.broadcast_to(np.arange(len(angles)), at.shape)), 1)
    free, out = np.ones(len(x), bool), []
    cells = np.flatnonzero(count >= votes)
    cells = cells[np.argsort(-count.ravel()[cells], kind="stable")]
    order = np.argsort(at, axis=0, kind="stable")  # each angle's pixels by their line
    ends = np.cumsum(count, axis=0)
    for r, k in zip(*np.unravel_index(cells, count.shape), strict=True):
        on = order[ends[r - 2, k] if r > 1 else 0 : ends[min(r + 1, len(ends) - 1), k], k]
        on = np.sort(on[free[on]])
        if len(on) < 2:
            continue
        along = y[on] * np.cos(angles[k]) - x[on] * np.sin(angles[k])
        on = on[np.argsort(along, kind="stable")]
        along = np.sort(along, kind="stable")
        for part in np.split(np.arange(len(on)), np.flatnonzero(np.diff(along) > gap) + 1):
            if len(part) > 1 and along[part[-1]] - along[part[0]] >= length:
                a, b = on[part[0]], on[part[-1]]
                out.append((int(x[a]), int(y[a]), int(x[b]), int(y[b])))
                free[on[part]] = False
    return out


def detect_lines(img: np.ndarray, length: float = 10) -> list[tuple[int, int, int, int]]:
    """Segments on the image's edges."""
    return hough_lines_p(K.canny_edge(img, 50, 100), 1, math.pi / 180, max(5, int(length)), length, 2)


def hough_circles(img: np.ndarray, low: int = 5, high: int = 50, votes: int = 20, edge: float = 100, apart: float = 10) -> list[tuple[float, float, float]]:
    """Circles whose centre gathers votes along its edge pixels' gradients: x, y, radius."""
    dx, dy = (g.astype(float) for g in K.sobel_gradient(img))
    y, x = np.nonzero(K.canny_edge(img, edge / 2, edge))
    size = np.maximum(np.hypot(dx[y, x], dy[y, x]), 1e-9)
    u, v = dx[y, x] / size, dy[y, x] / size
    count = np.zeros(img.shape)
    for r in range(low, high + 1):
        for s in (-1, 1):
            cx, cy = np.rint(x + s * r * u).astype(int), np.rint(y + s * r * v).astype(int)
            ok = (cx >= 0) & (cy >= 0) & (cx < img.shape[1]) & (cy < img.shape[0])
            np.add.at(count, (cy[ok], cx[ok]), 1)
    count = K.convolve(count, np.ones((3, 3)), border="constant", raw=True)
    out: list[tuple[float, float, float]] = []
    for at in np.argsort(-count, axis=None, kind="stable"):
        cy, cx = divmod(int(at), img.shape[1])
        if count[cy, cx] < votes:
            break
        if all(math.dist((cx, cy), c[:2]) >= apart for c in out):
            hist = np.bincount(np.rint(np.hypot(x - cx, y - cy)).astype(int), minlength=high + 1)[low : high + 1]
            out.append((float(cx), float(cy), float(low + int(hist.argmax()))))
    return out


def find_contours(img: np.ndarray, external: bool = True) -> list[np.ndarray]:
    """Borders of the non-zero regions as closed chains of pixels, clockwise from the first by rows; with holes if not external."""
    out = []
    for kind in (0,) if external else (0, 1):
        label, n = K.connected_components((img == 0) if kind else (img > 0), 4 if kind else 8)
        rim = {*label[0], *label[-1], *label[:, 0], *label[:, -1]} if kind else set()
        for k in range(1, n):
            if k not in rim:
                out.append(traced(label == k))
    return out


def traced(mask: np.ndarray) -> np.ndarray:
    """Border of one region, by following it with the eight directions."""
    p = np.pad(mask, 1)
    ways = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    y, x = (int(v[0]) for v in np.nonzero(p))
    start, way, chain, first = (y, x), 7, [], None
    while True:
        chain.append((x - 1, y - 1))
        for k in range(8):
            d = (way + 6 + k) % 8
            if p[y + ways[d][0], x + ways[d][1]]:
                break
        else:
            break
        if first is None:
            first = d
        elif (y, x) == start and d == first:
            chain.pop()
            break
        y, x, way = y + ways[d][0], x + ways[d][1], d
    return np.array(chain, int)


def contour_area(x: Column, y: Column) -> Column:
    """Of closed chains as two arrays, by the shoelace formula."""
    after = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
    cross = F.zip_with(F.zip_with(x, after(y), lambda a, b: a * b), F.zip_with(after(x), y, lambda a, b: a * b), lambda a, b: a - b)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def contour_perimeter(x: Column, y: Column) -> Column:
    after = lambda c: F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1))
    step = F.zip_with(F.zip_with(x, after(x), lambda a, b: a - b), F.zip_with(y, after(y), lambda a, b: a - b), lambda a, b: F.sqrt((a * a + b * b).cast("double")))
    return F.aggregate(step, F.lit(0.0), lambda s, v: s + v)


def bounding_rect(x: Column, y: Column) -> Column:
    return F.struct(F.array_min(x).alias("x"), F.array_min(y).alias("y"), (F.array_max(x) - F.array_min(x) + 1).alias("w"), (F.array_max(y) - F.array_min(y) + 1).alias("h"))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise in x to the right and y upwards, from the least."""
    p = sorted({(float(x), float(y)) for x, y in points})
    if len(p) < 3:
        return np.array(p)

    def half(q: list) -> list:
        out: list = []
        for c in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def approx_poly_dp(points: np.ndarray, epsilon: float = 3.0, closed: bool = True) -> np.ndarray:
    """The corners that keep every point within epsilon."""
    require(epsilon >= 0, "epsilon must be 0 or more")
    p = np.asarray(points, float)

    def kept(a: int, b: int) -> list[int]:
        if b - a < 2:
            return []
        d, q = p[b % len(p)] - p[a], p[a + 1 : b] - p[a]
        n = np.linalg.norm(d)
        away = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / n if n > 0 else np.linalg.norm(q, axis=1)
        k = int(away.argmax())
        return [] if away[k] <= epsilon else [*kept(a, a + 1 + k), a + 1 + k, *kept(a + 1 + k, b)]

    if not closed or len(p) < 3:
        return p[[0, *kept(0, len(p) - 1), len(p) - 1]] if len(p) > 1 else p
    far = int(((p - p[0]) ** 2).sum(1).argmax())
    return p[sorted({0, far, *kept(0, far), *kept(far, len(p))})]


def min_area_rect(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """cx, cy, w, h, degrees of the least rectangle: one of its sides lies on a side of the hull."""
    h = convex_hull(points)
    if len(h) < 3:
        a, b = h[0], h[-1]
        return float((a[0] + b[0]) / 2), float((a[1] + b[1]) / 2), float(np.linalg.norm(b - a)), 0.0, math.degrees(math.atan2(*(b - a)[::-1]))
    best = None
    for d in np.roll(h, -1, 0) - h:
        u = d / np.linalg.norm(d)
        r = np.array([u, [-u[1], u[0]]])
        q = h @ r.T
        low, high = q.min(0), q.max(0)
        if best is None or (high - low).prod() < best[0] - 1e-12:
            best = ((high - low).prod(), *((low + high) / 2 @ r), *(high - low), math.degrees(math.atan2(u[1], u[0])))
    return tuple(float(v) for v in best[1:])

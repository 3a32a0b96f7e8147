"""Flow between frames, search windows and background models, carried from frame to frame."""

from __future__ import annotations

import numpy as np

from lumaframe.errors import require
from lumaframe.operators import kernels as K


def sparse_lk_flow(before: np.ndarray, after: np.ndarray, points: np.ndarray, window: int = 21, levels: int = 3, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where points went, whether they could be followed, and the mean difference: Lucas-Kanade from coarse to fine."""
    require(window > 2 and levels >= 0, "window must be over 2, levels 0 or more")
    pyramid = [(before.astype(float), after.astype(float))]
    for _ in range(levels):
        if min(pyramid[-1][0].shape) < 16:
            break
        pyramid.append(tuple(K.pyr_down(p.astype(np.float32)).astype(float) for p in pyramid[-1]))
    r = window // 2
    v, u = np.mgrid[-r : r + 1, -r : r + 1].astype(float)
    points = np.asarray(points, float).reshape(-1, 2)
    out, good, error = points.copy(), np.ones(len(points), bool), np.zeros(len(points))
    at = lambda a, x, y: K.sampled(a.astype(np.float32), x, y, "replicate").astype(float)
    for i, p in enumerate(points):
        shift = np.zeros(2)
        for level in range(len(pyramid) - 1, -1, -1):
            a, b = pyramid[level]
            q = p / 2**level
            shift = shift * 2 if level < len(pyramid) - 1 else shift
            here = at(a, q[0] + u, q[1] + v)
            gx, gy = (at(a, q[0] + u + 1, q[1] + v) - at(a, q[0] + u - 1, q[1] + v)) / 2, (at(a, q[0] + u, q[1] + v + 1) - at(a, q[0] + u, q[1] + v - 1)) / 2
            m = np.array([[(gx * gx).sum(), (gx * gy).sum()], [(gx * gy).sum(), (gy * gy).sum()]])
            if np.linalg.eigvalsh(m)[0] / window**2 < 1e-4:
                good[i] = False
                break
            for _ in range(steps):
                d = here - at(b, q[0] + u + shift[0], q[1] + v + shift[1])
                move = np.linalg.solve(m, [(gx * d).sum(), (gy * d).sum()])
                shift = shift + move
                if np.hypot(*move) < 0.01:
                    break
            error[i] = float(np.abs(d).mean())
        out[i] = p + shift
        good[i] &= 0 <= out[i, 0] < before.shape[1] and 0 <= out[i, 1] < before.shape[0]
    return out, good, error


def dense_flow(before: np.ndarray, after: np.ndarray, window: int = 15, levels: int = 3, steps: int = 3) -> np.ndarray:
    """dx, dy of every pixel: least squares over windows from coarse to fine, warping the second frame by what is known."""
    a, b = before.astype(np.float32), after.astype(np.float32)
    if levels > 1 and min(a.shape) >= 32:
        small = dense_flow(K.pyr_down(a), K.pyr_down(b), window, levels - 1, steps)
        flow = 2 * np.stack([K.resize(small[..., k], a.shape[1], a.shape[0]) for k in range(2)], axis=2)
    else:
        flow = np.zeros((*a.shape, 2), np.float32)
    y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]].astype(float)
    one = np.full(window, 1 / window)
    for _ in range(steps):
        moved = K.sampled(b, x + flow[..., 0], y + flow[..., 1], "replicate").astype(float)
        gy, gx = np.gradient((a + moved) / 2)
        d = a - moved
        sxx, sxy, syy, sx, sy = (K.separable(v, one, one) for v in (gx * gx, gx * gy, gy * gy, gx * d, gy * d))
        det = sxx * syy - sxy * sxy + 1e-3
        flow = flow + np.clip(np.stack([(syy * sx - sxy * sy) / det, (sxx * sy - sxy * sx) / det], axis=2), -2, 2).astype(np.float32)
    return flow.astype(np.float32)


dense_farneback_flow = dense_flow


def dense_dis_flow(before: np.ndarray, after: np.ndarray, preset: str = "medium") -> np.ndarray:
    require(preset in ("ultrafast", "fast", "medium"), "preset must be ultrafast, fast or medium")
    return dense_flow(before, after, {"ultrafast": 21, "fast": 15, "medium": 9}[preset], 3, {"ultrafast": 1, "fast": 2, "medium": 4}[preset])


def mean_shift(probability: np.ndarray, window: tuple[int, int, int, int], steps: int = 10, least: float = 1.0) -> tuple[tuple[int, int, int, int], int]:
    """The window (x, y, w, h) moved to the centre of mass under it, and the number of steps."""
    x, y, w, h = window
    require(w > 0 and h > 0, "the window must have an area")
    for k in range(1, steps + 1):
        part = probability[max(0, y) : y + h, max(0, x) : x + w].astype(float)
        mass = part.sum()
        if mass <= 0:
            return (x, y, w, h), k
        v, u = np.mgrid[0 : part.shape[0], 0 : part.shape[1]]
        nx = int(np.clip(round(max(0, x) + (u * part).sum() / mass - w / 2), 0, max(0, probability.shape[1] - w)))
        ny = int(np.clip(round(max(0, y) + (v * part).sum() / mass - h / 2), 0, max(0, probability.shape[0] - h)))
        moved = np.hypot(nx - x, ny - y)
        x, y = nx, ny
        if moved < least:
            return (x, y, w, h), k
    return (x, y, w, h), steps


def cam_shift(probability: np.ndarray, window: tuple[int, int, int, int], steps: int = 10) -> tuple[tuple[float, float, float, float, float], tuple[int, int, int, int]]:
    """Mean shift, then a rotated box (cx, cy, w, h, degrees) from the moments, and the window for the next frame."""
    (x, y, w, h), _ = mean_shift(probability, window, steps)
    m = 10
    x0, y0 = max(0, x - m), max(0, y - m)
    part = probability[y0 : y + h + m, x0 : x + w + m].astype(float)
    mass = part.sum()
    if mass <= 0:
        return (x + w / 2, y + h / 2, 0.0, 0.0, 0.0), (x, y, w, h)
    v, u = np.mgrid[0 : part.shape[0], 0 : part.shape[1]]
    cx, cy = (u * part).sum() / mass, (v * part).sum() / mass
    a, b, c = ((u - cx) ** 2 * part).sum() / mass, ((u - cx) * (v - cy) * part).sum() / mass, ((v - cy) ** 2 * part).sum() / mass
    root = np.sqrt(4 * b * b + (a - c) ** 2)
    long, short = 4 * np.sqrt((a + c + root) / 2), 4 * np.sqrt(max(0.0, (a + c - root) / 2))
    angle = np.degrees(0.5 * np.arctan2(2 * b, a - c))
    t = np.radians(angle)
    nw, nh = max(1, round(abs(long * np.cos(t)) + abs(short * np.sin(t)))), max(1, round(abs(long * np.sin(t)) + abs(short * np.cos(t))))
    gx, gy = x0 + cx, y0 + cy
    nx, ny = int(np.clip(round(gx - nw / 2), 0, max(0, probability.shape[1] - nw))), int(np.clip(round(gy - nh / 2), 0, max(0, probability.shape[0] - nh)))
    return (float(gx), float(gy), float(long), float(short), float(angle)), (nx, ny, min(nw, probability.shape[1]), min(nh, probability.shape[0]))


class BackgroundMixture:
    """A few Gaussians a pixel, by weight; a pixel that fits none of the weighty ones is foreground (255), a darker background shadow (127)."""

    def __init__(self, history: int = 500, variance: float = 16, shadows: bool = True, kinds: int = 5, share: float = 0.9):
        require(history > 0 and variance > 0, "history and variance must be over 0")
        self.history, self.variance, self.shadows, self.kinds, self.share, self.n = history, variance, shadows, kinds, share, 0

    def update(self, img: np.ndarray) -> np.ndarray:
        a = img.astype(float).reshape(*img.shape[:2], -1)
        if not self.n:
            self.mean, self.spread, self.weight = np.repeat(a[None], self.kinds, 0), np.full((self.kinds, *a.shape[:2]), 15.0), np.zeros((self.kinds, *a.shape[:2]))
        self.n += 1
        rate = 1 / min(self.n, self.history)
        d2 = ((a - self.mean) ** 2).sum(-1)
        fits = (d2 < self.variance * self.spread) & (self.weight > 0)
        order = np.argsort(-self.weight, axis=0, kind="stable")
        before = np.take_along_axis(np.cumsum(np.take_along_axis(self.weight, order, 0), 0) - np.take_along_axis(self.weight, order, 0), np.argsort(order, axis=0), 0)
        ground = before < self.share
        chosen = np.where(fits, self.weight, -1).argmax(0)
        any_fit = fits.any(0)
        front = ~(fits & ground).any(0)
        hit = (np.arange(self.kinds)[:, None, None] == chosen) & any_fit
        fresh = (np.arange(self.kinds)[:, None, None] == self.weight.argmin(0)) & ~any_fit
        self.weight = np.clip(self.weight + rate * (hit - self.weight), 0, None)
        k = np.where(hit, rate / np.maximum(self.weight, rate), 0)
        self.mean += k[..., None] * (a - self.mean)
        self.spread = np.clip(self.spread + k * (d2 / a.shape[-1] - self.spread), 4, 75)
        self.mean = np.where(fresh[..., None], a, self.mean)
        self.spread, self.weight = np.where(fresh, 15.0, self.spread), np.where(fresh, rate, self.weight)
        self.weight /= self.weight.sum(0)
        out = np.where(front, 255, 0).astype(np.uint8)
        if self.shadows:
            main = np.take_along_axis(self.mean, self.weight.argmax(0)[None, ..., None], 0)[0]
            scale = (a * main).sum(-1) / np.maximum((main * main).sum(-1), 1e-9)
            near = ((a - scale[..., None] * main) ** 2).sum(-1) < self.variance * 15 * scale**2
            out[front & (scale < 1) & (scale >= 0.5) & near] = 127
        return out


class BackgroundNeighbours:
    """Samples of a pixel's past; it is background if enough of them are within the threshold."""

    def __init__(self, history: int = 500, threshold: float = 400, samples: int = 14, enough: int = 2, seed: int = 0):
        require(history > 0 and threshold > 0, "history and threshold must be over 0")
        self.history, self.threshold, self.samples, self.enough, self.rng, self.past = history, threshold, samples, enough, np.random.default_rng(seed), None

    def update(self, img: np.ndarray) -> np.ndarray:
        a = img.astype(float).reshape(*img.shape[:2], -1)
        if self.past is None:
            self.past = np.repeat(a[None], self.samples, 0)
            return np.zeros(a.shape[:2], np.uint8)
        near = ((self.past - a) ** 2).sum(-1) < self.threshold
        out = np.where(near.sum(0) >= self.enough, 0, 255).astype(np.uint8)
        swap = self.rng.random(a.shape[:2]) < max(self.samples / self.history, 0.02)
        k = self.rng.integers(0, self.samples, a.shape[:2])
        hit = (np.arange(self.samples)[:, None, None] == k) & swap
        self.past = np.where(hit[..., None], a, self.past)
        return out

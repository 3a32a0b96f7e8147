"""Camera geometry: projection, distortion, homographies, epipolar geometry, pose and calibration.

Small dense algebra for each group of points, in NumPy; point-wise parts also exist as columns. Robust estimates draw with a fixed
seed. Refinement is damped least squares with numeric derivatives. Results follow the published algorithms, not any library's bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.errors import require


def make_chessboard_points(columns: int, rows: int, side: float) -> np.ndarray:
    """Points of the plane z = 0, row by row."""
    require(columns > 0 and rows > 0 and side > 0, "sizes must be over 0")
    y, x = np.mgrid[0:rows, 0:columns]
    return np.stack([x.ravel() * side, y.ravel() * side, np.zeros(x.size)], axis=1)


def rotation(rvec: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    t = float(np.linalg.norm(rvec))
    if t < 1e-12:
        return np.eye(3)
    x, y, z = np.asarray(rvec, float) / t
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k


def rotation_vector(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    r = u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt
    t = math.acos(float(np.clip((np.trace(r) - 1) / 2, -1, 1)))
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    if t < 1e-9:
        return axis / 2
    if math.pi - t < 1e-6:
        v = np.sqrt(np.clip((np.diag(r) + 1) / 2, 0, None))
        k = int(v.argmax())
        v = np.where(np.arange(3) == k, v, np.copysign(v, r[k]))
        return t * v / np.linalg.norm(v)
    return axis * t / (2 * math.sin(t))


def distorted(xy: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Normalised points through radial (k1 k2 k3) and tangential (p1 p2) distortion; order k1 k2 p1 p2 k3."""
    k1, k2, p1, p2, k3 = np.concatenate([np.asarray(dist, float).ravel(), np.zeros(5)])[:5]
    x, y = xy[..., 0], xy[..., 1]
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return np.stack([x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y], axis=-1)


def project_points(points: np.ndarray, rvec: np.ndarray, tvec: np.ndarray, k: np.ndarray, dist: np.ndarray = ()) -> np.ndarray:
    p = np.asarray(points, float) @ rotation(rvec).T + np.asarray(tvec, float).ravel()
    xy = distorted(p[:, :2] / p[:, 2:], dist)
    return xy * [k[0, 0], k[1, 1]] + [k[0, 2], k[1, 2]]


def project_columns(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, k1: float = 0, k2: float = 0) -> tuple[Column, Column]:
    """u, v of points in camera coordinates, with radial distortion, as columns."""
    a, b = x / z, y / z
    r2 = a * a + b * b
    radial = 1 + r2 * k1 + r2 * r2 * k2
    return a * radial * fx + cx, b * radial * fy + cy


def reproject_columns(x: Column, y: Column, d: Column, q: list[list[float]]) -> list[Column]:
    """Q (x, y, d, 1), divided by its last part."""
    p = [x * F.lit(float(r[0])) + y * F.lit(float(r[1])) + d * F.lit(float(r[2])) + F.lit(float(r[3])) for r in q]
    w = F.nullif(p[3], F.lit(0.0))
    return [c / w for c in p[:3]]


def reproject_to_3d(disparity: np.ndarray, q: np.ndarray) -> np.ndarray:
    y, x = np.mgrid[0 : disparity.shape[0], 0 : disparity.shape[1]]
    p = np.stack([x, y, disparity, np.ones_like(disparity)], axis=-1).astype(float) @ np.asarray(q, float).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return p[..., :3] / p[..., 3:]


def undistort_map(k: np.ndarray, dist: np.ndarray, width: int, height: int, r: np.ndarray | None = None, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel of the straight image, where it is in the taken one."""
    x, y = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    ray = np.stack([x.ravel(), y.ravel(), np.ones(x.size)]).T @ np.linalg.inv((k if new is None else new) @ (np.eye(3) if r is None else r)).T
    xy = distorted(ray[:, :2] / ray[:, 2:], dist)
    return (xy[:, 0] * k[0, 0] + k[0, 2]).reshape(x.shape), (xy[:, 1] * k[1, 1] + k[1, 2]).reshape(x.shape)


def undistort(img: np.ndarray, k: np.ndarray, dist: np.ndarray) -> np.ndarray:
    from lumaframe.operators.kernels import remap

    return remap(img, *undistort_map(k, dist, img.shape[1], img.shape[0]))


def undistorted_points(points: np.ndarray, k: np.ndarray, dist: np.ndarray, steps: int = 20) -> np.ndarray:
    """Normalised points without distortion, by fixed-point iteration."""
    target = (np.asarray(points, float) - [k[0, 2], k[1, 2]]) / [k[0, 0], k[1, 1]]
    xy = target.copy()
    for _ in range(steps):
        xy = xy + target - distorted(xy, dist)
    return xy


# --- fisheye ----------------------------------------------------------------------------------------------------------


def fisheye_distorted(xy: np.ndarray, d: np.ndarray) -> np.ndarray:
    r = np.linalg.norm(xy, axis=-1)
    t = np.arctan(r)
    t2 = t * t
    bent = t * (1 + t2 * (d[0] + t2 * (d[1] + t2 * (d[2] + t2 * d[3]))))
    return xy * np.divide(bent, r, out=np.ones_like(r), where=r > 1e-12)[..., None]


def fisheye_project(points: np.ndarray, rvec: np.ndarray, tvec: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
    p = np.asarray(points, float) @ rotation(rvec).T + np.asarray(tvec, float).ravel()
    return fisheye_distorted(p[:, :2] / p[:, 2:], np.asarray(d, float)) * [k[0, 0], k[1, 1]] + [k[0, 2], k[1, 2]]


def fisheye_undistort_points(points: np.ndarray, k: np.ndarray, d: np.ndarray, steps: int = 20) -> np.ndarray:
    """Newton's iteration on the bent angle."""
    xy = (np.asarray(points, float) - [k[0, 2], k[1, 2]]) / [k[0, 0], k[1, 1]]
    bent = np.clip(np.linalg.norm(xy, axis=-1), 0, math.pi / 2)
    t = bent.copy()
    for _ in range(steps):
        t2 = t * t
        f = t * (1 + t2 * (d[0] + t2 * (d[1] + t2 * (d[2] + t2 * d[3])))) - bent
        t = t - f / (1 + t2 * (3 * d[0] + t2 * (5 * d[1] + t2 * (7 * d[2] + t2 * 9 * d[3]))))
    return xy * np.divide(np.tan(t), bent, out=np.ones_like(t), where=bent > 1e-12)[..., None]


def fisheye_init_rectify_map(k: np.ndarray, d: np.ndarray, width: int, height: int, r: np.ndarray | None = None, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    ray = np.stack([x.ravel(), y.ravel(), np.ones(x.size)]).T @ np.linalg.inv((k if new is None else new) @ (np.eye(3) if r is None else r)).T
    xy = fisheye_distorted(ray[:, :2] / ray[:, 2:], np.asarray(d, float))
    return (xy[:, 0] * k[0, 0] + k[0, 2]).reshape(x.shape), (xy[:, 1] * k[1, 1] + k[1, 2]).reshape(x.shape)


def fisheye_undistort(img: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
    from lumaframe.operators.kernels import remap

    return remap(img, *fisheye_init_rectify_map(k, d, img.shape[1], img.shape[0]))


# --- estimation -------------------------------------------------------------------------------------------------------


def least_squares(residual: Callable[[np.ndarray], np.ndarray], x: np.ndarray, steps: int = 60) -> np.ndarray:
    """Damped least squares from x, with forward differences."""
    x, damp = np.asarray(x, float), 1e-3
    r = residual(x)
    for _ in range(steps):
        h = 1e-6 * np.maximum(1, np.abs(x))
        j = np.stack([(residual(x + h[i] * np.eye(len(x))[i]) - r) / h[i] for i in range(len(x))], axis=1)
        a, g = j.T @ j, j.T @ r
        while damp < 1e12:
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
            new = residual(x + step)
            if new @ new < r @ r:
                x, r, damp = x + step, new, max(damp / 10, 1e-12)
                break
            damp *= 10
        else:
            break
        if np.abs(step).max() < 1e-10 * (1 + np.abs(x).max()):
            break
    return x


def centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = p.mean(0)
    s = math.sqrt(2) / max(float(np.linalg.norm(p - m, axis=1).mean()), 1e-12)
    t = np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])
    return (p - m) * s, t


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Direct linear transform of four or more pairs."""
    require(len(src) >= 4 and len(src) == len(dst), "four pairs at least")
    a, ta = centred(np.asarray(src, float))
    b, tb = centred(np.asarray(dst, float))
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack([a, one])
    rows = np.concatenate([np.hstack([p, zero, -b[:, :1] * p]), np.hstack([zero, p, -b[:, 1:] * p])])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2]


def applied(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / np.where(q[:, 2:] == 0, 1e-300, q[:, 2:])


def consensus(n: int, size: int, fit, error, limit: float, tries: int, sure: float = 0.995, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The model of a random sample with most errors within the limit, fitted anew to these, and which they are."""
    rng, best, tried = np.random.default_rng(seed), np.zeros(n, bool), 0
    while tried < tries:
        tried += 1
        try:
            model = fit(rng.choice(n, size, replace=False))
        except np.linalg.LinAlgError:
            continue
        if model is None:
            continue
        good = error(model) <= limit
        if good.sum() > best.sum():
            best = good
            share = min(float(best.mean()), 1 - 1e-9)
            tries = min(tries, max(1, math.ceil(math.log(1 - sure) / math.log(max(1e-12, 1 - share**size)))))
    if best.sum() < size:
        return None, best
    model = fit(np.flatnonzero(best))
    return model, error(model) <= limit


def find_homography(src: np.ndarray, dst: np.ndarray, threshold: float = 3.0) -> tuple[np.ndarray | None, np.ndarray]:
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    require(len(src) >= 4 and len(src) == len(dst), "four pairs at least")
    return consensus(len(src), 4, lambda k: homography(src[k], dst[k]), lambda h: np.linalg.norm(applied(h, src) - dst, axis=1), threshold, 2000)


def eight_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, ta = centred(a)
    q, tb = centred(b)
    rows = np.column_stack([q[:, 0] * p[:, 0], q[:, 0] * p[:, 1], q[:, 0], q[:, 1] * p[:, 0], q[:, 1] * p[:, 1], q[:, 1], p, np.ones(len(p))])
    u, s, vt = np.linalg.svd(np.linalg.svd(rows)[2][-1].reshape(3, 3))
    f = tb.T @ u @ np.diag([s[0], s[1], 0]) @ vt @ ta
    return f / (f[2, 2] if abs(f[2, 2]) > 1e-12 else np.linalg.norm(f))


def epipolar_distance(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = np.column_stack([a, np.ones(len(a))]), np.column_stack([b, np.ones(len(b))])
    on_b, on_a = p @ f.T, q @ f
    d = np.abs((q * on_b).sum(1))
    return np.maximum(d / np.maximum(np.linalg.norm(on_b[:, :2], axis=1), 1e-12), d / np.maximum(np.linalg.norm(on_a[:, :2], axis=1), 1e-12))


def find_fundamental_mat(a: np.ndarray, b: np.ndarray, threshold: float = 3.0) -> tuple[np.ndarray | None, np.ndarray]:
    a, b = np.asarray(a, float), np.asarray(b, float)
    require(len(a) >= 8 and len(a) == len(b), "eight pairs at least")
    return consensus(len(a), 8, lambda k: eight_points(a[k], b[k]), lambda f: epipolar_distance(f, a, b), threshold, 2000)


def find_essential_mat(a: np.ndarray, b: np.ndarray, k: np.ndarray, threshold: float = 1.0) -> tuple[np.ndarray | None, np.ndarray]:
    """By eight points on normalised coordinates; fewer than eight pairs (five at least) are fitted by least squares."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    require(len(a) >= 5 and len(a) == len(b), "five pairs at least")
    normal = lambda p: (p - [k[0, 2], k[1, 2]]) / [k[0, 0], k[1, 1]]
    p, q = normal(a), normal(b)

    def proper(m: np.ndarray) -> np.ndarray:
        u, _, vt = np.linalg.svd(m)
        return u @ np.diag([1.0, 1, 0]) @ vt

    def fit(at: np.ndarray) -> np.ndarray:
        return proper(eight_points(p[at], q[at]))

    def refined(at: np.ndarray) -> np.ndarray:
        cross = lambda t: np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
        make = lambda v: cross(v[3:] / np.linalg.norm(v[3:])) @ rotation(v[:3])
        best = min((least_squares(lambda v: epipolar_distance(make(v), p[at], q[at]), np.concatenate([np.zeros(3), t])) for t in np.eye(3)), key=lambda v: float((epipolar_distance(make(v), p[at], q[at]) ** 2).sum()))
        return make(best)

    if len(a) < 8:
        return refined(np.arange(len(a))), np.ones(len(a), bool)
    return consensus(len(a), 8, fit, lambda e: epipolar_distance(e, p, q) * (k[0, 0] + k[1, 1]) / 2, threshold, 2000)


def triangulate_points(p1: np.ndarray, p2: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Homogeneous points, 4 x n."""
    require(len(a) == len(b), "as many points in both views")
    out = [np.linalg.svd(np.stack([x[0] * p1[2] - p1[0], x[1] * p1[2] - p1[1], y[0] * p2[2] - p2[0], y[1] * p2[2] - p2[1]]))[2][-1] for x, y in zip(np.asarray(a, float), np.asarray(b, float), strict=True)]
    return np.array(out).reshape(-1, 4).T


def recover_pose(e: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """r, t and the number of points before both cameras: the best of the four decompositions."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    normal = lambda p: (np.asarray(p, float) - [k[0, 2], k[1, 2]]) / [k[0, 0], k[1, 1]]
    p, q, best = normal(a), normal(b), None
    for r in (u @ w @ vt, u @ w.T @ vt):
        for t in (u[:, 2], -u[:, 2]):
            x = triangulate_points(np.eye(3, 4), np.column_stack([r, t]), p, q)
            x = x[:3] / np.where(x[3] == 0, 1e-300, x[3])
            n = int(((x[2] > 0) & ((r @ x + t[:, None])[2] > 0)).sum())
            if best is None or n > best[2]:
                best = (r, t, n)
    return best


def solve_pnp(points: np.ndarray, pixels: np.ndarray, k: np.ndarray, dist: np.ndarray = ()) -> tuple[np.ndarray, np.ndarray]:
    """rvec, tvec: from a linear start (a homography if the points lie in z = 0), refined on the pixel error."""
    points, pixels = np.asarray(points, float), np.asarray(pixels, float)
    require(len(points) >= 4 and len(points) == len(pixels), "four pairs at least")
    xy = undistorted_points(pixels, k, dist)
    if np.abs(points[:, 2]).max() < 1e-9:
        h = homography(points[:, :2], xy)
        h /= (np.linalg.norm(h[:, 0]) + np.linalg.norm(h[:, 1])) / 2
        h = -h if h[2, 2] < 0 else h
        r, t = np.column_stack([h[:, 0], h[:, 1], np.cross(h[:, 0], h[:, 1])]), h[:, 2]
    else:
        require(len(points) >= 6, "six pairs at least if the points are not in z = 0")
        p = np.column_stack([points, np.ones(len(points))])
        zero = np.zeros_like(p)
        m = np.linalg.svd(np.concatenate([np.hstack([p, zero, -xy[:, :1] * p]), np.hstack([zero, p, -xy[:, 1:] * p])]))[2][-1].reshape(3, 4)
        m = m * np.sign((p @ m[2]).mean()) / np.cbrt(abs(np.linalg.det(m[:, :3])))
        r, t = m[:, :3], m[:, 3]
    v = least_squares(lambda v: (project_points(points, v[:3], v[3:], k, dist) - pixels).ravel(), np.concatenate([rotation_vector(r), t]))
    return v[:3], v[3:]


def solve_pnp_ransac(points: np.ndarray, pixels: np.ndarray, k: np.ndarray, dist: np.ndarray = (), threshold: float = 8.0, tries: int = 100) -> tuple[tuple[np.ndarray, np.ndarray] | None, np.ndarray]:
    points, pixels = np.asarray(points, float), np.asarray(pixels, float)
    size = 4 if np.abs(points[:, 2]).max() < 1e-9 else 6
    return consensus(len(points), size, lambda at: solve_pnp(points[at], pixels[at], k, dist), lambda m: np.linalg.norm(project_points(points, *m, k, dist) - pixels, axis=1), threshold, tries, 0.99)


def start_intrinsics(objects: list[np.ndarray], images: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """Focal lengths from the planes' homographies, the principal point in the middle."""
    cx, cy, rows, right = (width - 1) / 2, (height - 1) / 2, [], []
    for o, i in zip(objects, images, strict=True):
        h = homography(np.asarray(o)[:, :2], np.asarray(i, float) - [cx, cy])
        a, b = h[:, 0], h[:, 1]
        rows += [[a[0] * b[0], a[1] * b[1]], [a[0] ** 2 - b[0] ** 2, a[1] ** 2 - b[1] ** 2]]
        right += [-a[2] * b[2], -(a[2] ** 2 - b[2] ** 2)]
    s = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
    f = [1 / math.sqrt(abs(v)) if abs(v) > 1e-16 else float(max(width, height)) for v in s]
    return np.array([[f[0], 0, cx], [0, f[1], cy], [0, 0, 1.0]])


def _bundle(objects, images, width, height, bends: int, project) -> dict:
    require(len(objects) >= 3 and len(objects) == len(images), "three views at least")
    k = start_intrinsics(objects, images, width, height)
    poses = [np.concatenate(solve_pnp(o, i, k)) for o, i in zip(objects, images, strict=True)]

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([[v[0], 0, v[2]], [0, v[1], v[3]], [0, 0, 1.0]]), v[4 : 4 + bends], v[4 + bends :].reshape(-1, 6)

    def residual(v: np.ndarray) -> np.ndarray:
        kk, d, p = parts(v)
        return np.concatenate([(project(np.asarray(o, float), q[:3], q[3:], kk, d) - i).ravel() for o, i, q in zip(objects, images, p, strict=True)])

    v = least_squares(residual, np.concatenate([[k[0, 0], k[1, 1], k[0, 2], k[1, 2]], np.zeros(bends), *poses]))
    kk, d, p = parts(v)
    r = residual(v)
    return {"rms": math.sqrt(float((r * r).sum() / (len(r) / 2))), "k": kk, "dist": d, "rvecs": p[:, :3], "tvecs": p[:, 3:]}


def calibrate_camera(objects: list[np.ndarray], images: list[np.ndarray], width: int, height: int) -> dict:
    """rms, k, dist, rvecs, tvecs of three or more views of a plane."""
    return _bundle(objects, images, width, height, 5, project_points)


def fisheye_calibrate(objects: list[np.ndarray], images: list[np.ndarray], width: int, height: int) -> dict:
    return _bundle(objects, images, width, height, 4, fisheye_project)


def _stereo(objects, left, right, k1, d1, k2, d2, project, pose) -> dict:
    require(len(objects) > 0 and len(objects) == len(left) == len(right), "as many views on both sides")
    first = [np.concatenate(pose(o, i, k1, d1)) for o, i in zip(objects, left, strict=True)]
    second = [np.concatenate(pose(o, i, k2, d2)) for o, i in zip(objects, right, strict=True)]
    steps = [(rotation(b[:3]) @ rotation(a[:3]).T, b[3:] - rotation(b[:3]) @ rotation(a[:3]).T @ a[3:]) for a, b in zip(first, second, strict=True)]
    start = np.concatenate([np.median([rotation_vector(r) for r, _ in steps], axis=0), np.median([t for _, t in steps], axis=0), *first])

    def residual(v: np.ndarray) -> np.ndarray:
        r, t, out = rotation(v[:3]), v[3:6], []
        for o, a, b, p in zip(objects, left, right, v[6:].reshape(-1, 6), strict=True):
            both = r @ rotation(p[:3])
            out += [(project(o, p[:3], p[3:], k1, d1) - a).ravel(), (project(o, rotation_vector(both), r @ p[3:] + t, k2, d2) - b).ravel()]
        return np.concatenate(out)

    v = least_squares(residual, start)
    r, t, e = rotation(v[:3]), v[3:6], residual(v)
    cross = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
    essential = cross @ r
    return {"rms": math.sqrt(float((e * e).sum() / (len(e) / 2))), "r": r, "t": t, "e": essential, "f": np.linalg.inv(k2).T @ essential @ np.linalg.inv(k1)}


def stereo_calibrate(objects, left, right, k1, d1, k2, d2) -> dict:
    """rms, r, t, e, f of the second camera relative to the first; intrinsics stay."""
    return _stereo(objects, left, right, k1, d1, k2, d2, project_points, solve_pnp)


def fisheye_stereo_calibrate(objects, left, right, k1, d1, k2, d2) -> dict:
    def pose(o: np.ndarray, i: np.ndarray, k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = fisheye_undistort_points(i, k, d)
        r, t = solve_pnp(o, flat, np.eye(3))
        v = least_squares(lambda v: (fisheye_project(o, v[:3], v[3:], k, d) - i).ravel(), np.concatenate([r, t]))
        return v[:3], v[3:]

    return _stereo(objects, left, right, k1, d1, k2, d2, fisheye_project, pose)


def stereo_rectify(k1: np.ndarray, k2: np.ndarray, r: np.ndarray, t: np.ndarray) -> dict:
    """r1, r2, p1, p2, q: both cameras turned half of their difference, then so that their baseline is the x axis."""
    half = rotation(-rotation_vector(r) / 2)
    base = half @ np.asarray(t, float).ravel()
    axis = np.array([1.0 if base[0] > 0 else -1.0, 0, 0])
    turn = np.cross(base, axis)
    n = np.linalg.norm(turn)
    angle = math.acos(float(np.clip(abs(base[0]) / np.linalg.norm(base), -1, 1)))
    w = rotation(turn / n * angle) if n > 1e-12 else np.eye(3)
    r1, r2 = w @ half.T, w @ half
    shift = r2 @ np.asarray(t, float).ravel()
    f = min(k1[1, 1], k2[1, 1])
    cx, cy = (k1[0, 2] + k2[0, 2]) / 2, (k1[1, 2] + k2[1, 2]) / 2
    p1 = np.array([[f, 0, cx, 0], [0, f, cy, 0], [0, 0, 1.0, 0]])
    p2 = p1.copy()
    p2[0, 3] = shift[0] * f
    return {"r1": r1, "r2": r2, "p1": p1, "p2": p2, "q": np.array([[1, 0, 0, -cx], [0, 1, 0, -cy], [0, 0, 0, f], [0, 0, -1 / shift[0], 0]])}


fisheye_stereo_rectify = stereo_rectify


def stereo_bm(left: np.ndarray, right: np.ndarray, disparities: int = 64, block: int = 15) -> np.ndarray:
    """Disparity of least absolute difference over blocks, among those that stay in the image."""
    from lumaframe.operators.kernels import box_filter, odd

    odd(block)
    require(disparities > 0, "disparities must be over 0")
    a, b = left.astype(np.float32), right.astype(np.float32)
    cost = np.full((disparities, *a.shape), np.inf, np.float32)
    for d in range(min(disparities, a.shape[1])):
        cost[d, :, d:] = box_filter(np.abs(a[:, d:] - b[:, : a.shape[1] - d]), block)
    return cost.argmin(0).astype(np.float32)


def stereo_sgbm(left: np.ndarray, right: np.ndarray, disparities: int = 64, block: int = 5, p1: float = 8, p2: float = 32) -> np.ndarray:
    """The same cost, summed along eight paths with penalties for steps of one and of more."""
    from lumaframe.operators.kernels import box_filter

    require(0 < p1 < p2, "p1 must be over 0 and under p2")
    h, w = left.shape
    a, b = left.astype(np.float32), right.astype(np.float32)
    cost = np.full((h, w, disparities), 255.0, np.float32)
    for d in range(min(disparities, w)):
        cost[:, d:, d] = box_filter(np.abs(a[:, d:] - b[:, : w - d]), block)
    total = np.zeros_like(cost)

    def step(before: np.ndarray, here: np.ndarray) -> np.ndarray:
        low = before.min(-1, keepdims=True)
        one = np.minimum(np.pad(before[..., 1:], [(0, 0)] * (before.ndim - 1) + [(0, 1)], constant_values=np.inf), np.pad(before[..., :-1], [(0, 0)] * (before.ndim - 1) + [(1, 0)], constant_values=np.inf)) + p1
        return here + np.minimum(np.minimum(before, one), low + p2) - low

    for turn in range(4):
        c = np.rot90(cost, turn)
        t = np.zeros_like(c)
        for slant in (0, 1):
            path = c[0].copy()
            t[0] += path
            for y in range(1, c.shape[0]):
                moved = path if not slant else np.concatenate([path[:1], path[:-1]])
                path = step(moved, c[y])
                if slant:
                    path[0] = c[y, 0]
                t[y] += path
        total += np.rot90(t, -turn)
    return total.argmin(-1).astype(np.float32)

"""Queries of the NumPy kernels on the 8x8 images. Where SQL can state the neighbourhood, it does."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumaframe.operators import kernels as K
from lumaframe.operators.images import on_pixels
from lumaframe.plans.inputs import IM, PV, images, pairs, rows
from lumaframe.plans.kernel_sql import COLORS, KERNELS
from lumaframe.plans.vision_sql import HASHES, STEPS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


def kernel(name: str, f, sql: str | None = None, width: int = 8) -> None:
    QUERIES[name] = lambda spark, sf: rows(images(spark, sf), F.transform(on_pixels(f, F.col("px"), width), lambda v: F.round(v, 6) + F.lit(0.0)))
    if sql is not None:
        ORACLE[name] = sql


def near(weights: np.ndarray, value: str, where: str = "") -> str:
    """SQL of an aggregate over a mirrored neighbourhood: p.v with weight k."""
    h, w = weights.shape
    table = ", ".join(f"({y - h // 2}, {x - w // 2}, {float(weights[y, x])})" for y in range(h) for x in range(w) if weights[y, x])
    return f"WITH {IM}, o(dy, dx, k) AS (VALUES {table}), nb AS (SELECT c.img_id, c.i, o.k::DOUBLE AS k, p.v FROM im c CROSS JOIN o JOIN im p ON p.img_id = c.img_id AND p.y = {MIRROR.format('(c.y + o.dy)')} AND p.x = {MIRROR.format('(c.x + o.dx)')} {where}) SELECT img_id, i, {value} AS v FROM nb GROUP BY img_id, i"


def clipped(weights: np.ndarray, value: str) -> str:
    """The same over the neighbours that lie in the image."""
    return near(weights, value).replace(f"p.y = {MIRROR.format('(c.y + o.dy)')}", "p.y = c.y + o.dy").replace(f"p.x = {MIRROR.format('(c.x + o.dx)')}", "p.x = c.x + o.dx")


BYTE = "CAST(least(255, greatest(0, round_even({}, 0))) AS DOUBLE)"
ONE3, ONE5 = np.ones((3, 3)), np.ones((5, 5))
SX, LAPLACE = np.outer([1, 2, 1], [-1, 0, 1]), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
EDGE = np.array([[1.0, -2, 0], [0.5, 3, -1], [0, 0.25, -1]])
G5 = np.outer(K.gaussian(5), K.gaussian(5))

kernel("box_filter", K.box_filter, near(ONE3, BYTE.format("sum(v) / 9.0")))
kernel("box_filter_sum", lambda a: K.box_filter(a, 3, normalize=False), near(ONE3, BYTE.format("sum(v)::DOUBLE")))
kernel("convolve", lambda a: K.convolve(a, EDGE), near(EDGE, BYTE.format("sum(k * v)")))
kernel("gaussian_blur", lambda a: K.gaussian_blur(a, 5), near(G5, BYTE.format("sum(k * v)")))
kernel("median_blur", lambda a: K.median_blur(a, 3))
kernel("sobel_gradient", lambda a: K.sobel_gradient(a)[0], near(SX, "sum(k * v)"))
kernel("scharr_gradient", lambda a: K.scharr_gradient(a)[1], near(np.outer([-1, 0, 1], [3, 10, 3]), "sum(k * v)"))
kernel("laplacian_edge", K.laplacian_edge, near(LAPLACE, BYTE.format("abs(sum(k * v))")))
kernel("sobel_edge", K.sobel_edge)
kernel("harris_corner", K.harris_corner)
kernel("canny_edge", K.canny_edge)
for _shape in K.SHAPES:
    kernel(f"dilate_{_shape}", lambda a, s=_shape: K.dilate(a, 5, s), clipped(K.element(_shape, 5).astype(float), "max(v)::DOUBLE"))
    kernel(f"erode_{_shape}", lambda a, s=_shape: K.erode(a, 5, s), clipped(K.element(_shape, 5).astype(float), "min(v)::DOUBLE"))
kernel("morph_gradient", K.morph_gradient, clipped(ONE3, "max(v)::DOUBLE - min(v)"))
for _name in ("morph_open", "morph_close", "top_hat", "black_hat", "bilateral_filter", "unsharp_mask", "adaptive_threshold", "clahe", "pyr_down", "pyr_up"):
    kernel(_name, getattr(K, _name))
kernel("nl_means_denoising", lambda a: K.nl_means(a, 10, 3, 5))
kernel("distance_transform", lambda a: K.distance_transform(a > 128), f"WITH {IM} SELECT a.img_id, a.i, round(CAST(min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS FLOAT)::DOUBLE, 6) AS v FROM im a JOIN im b ON a.img_id = b.img_id WHERE b.v <= 128 GROUP BY a.img_id, a.i")
kernel("distance_transform_l1", lambda a: K.distance_transform(a > 128, "l1"), f"WITH {IM} SELECT a.img_id, a.i, min(abs(a.y - b.y) + abs(a.x - b.x))::DOUBLE AS v FROM im a JOIN im b ON a.img_id = b.img_id WHERE b.v <= 128 GROUP BY a.img_id, a.i")
kernel("connected_components", lambda a: K.connected_components(a > 128, 4)[0])
kernel("flood_fill", lambda a: K.flood_fill(a, (0, 0), 7, 20, 20))
kernel("watershed", lambda a: K.watershed(a, np.pad(np.array([[1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 2]]), 2)))
kernel("resize", lambda a: K.resize(a, 12, 5))
kernel("resize_area", lambda a: K.resize_area(a, 4, 4), f"WITH {IM} SELECT img_id, CAST(y // 2 * 4 + x // 2 AS INT) AS i, {BYTE.format('avg(v)')} AS v FROM im GROUP BY img_id, y // 2 * 4 + x // 2")
kernel("letter_box", lambda a: K.letter_box(a, 12, 9))
kernel("rotate", lambda a: K.rotate(a, 30))
kernel("warp_affine", lambda a: K.warp_affine(a, [[1, 0, 2], [0, 1, -1]]), f"WITH {PV} SELECT t.img_id, t.i, CASE WHEN t.x >= 2 AND t.y < 7 THEN w.px[t.y * 8 + t.x + 7] ELSE 0 END::DOUBLE AS v FROM im t JOIN pv w USING (img_id)")
kernel("warp_perspective", lambda a: K.warp_perspective(a, [[1, 0.1, 0], [0, 1, 0], [0.01, 0, 1]]))
kernel("remap", lambda a: K.remap(a, *np.meshgrid(np.arange(7, -1, -1), np.arange(8))), f"WITH {PV} SELECT t.img_id, t.i, w.px[t.y * 8 + 8 - t.x]::DOUBLE AS v FROM im t JOIN pv w USING (img_id)")


def measure(name: str, f) -> None:
    """Of each image and the next."""
    QUERIES[name] = lambda spark, sf: pairs(spark, sf).select("img_id", F.round(F.get(on_pixels(lambda ab: np.array([f(ab[:8], ab[8:])]), F.concat("a", "b"), 8), 0), 6).alias("v"))


measure("ssim", K.ssim)
measure("gmsd", K.gmsd)


def vector(name: str, f, result: str) -> None:
    if sql := COLORS.get(name) or HASHES.get(name):
        tidy = lambda c: c if result == "array<bigint>" else F.transform(c, lambda v: F.round(v, 6) + F.lit(0.0))
        QUERIES[name], ORACLE[name] = lambda spark, sf: rows(images(spark, sf), tidy(on_pixels(f, F.col("px"), 8, result))), sql
        return
    QUERIES[name] = lambda spark, sf: images(spark, sf).select("img_id", on_pixels(f, F.col("px"), 8, result).alias("h"))


vector("p_hash", K.p_hash, "array<bigint>")
vector("marr_hildreth_hash", K.marr_hildreth_hash, "array<bigint>")
vector("radial_variance_hash", K.radial_variance_hash, "array<double>")
vector("color_moment_hash", K.color_moment_hash, "array<double>")
vector("match_template", lambda a: K.match_template(a, a[2:5, 3:6], "sqdiff"), "array<double>")
vector("phase_correlate", lambda a: K.phase_correlate(a.astype(float), np.roll(a, 1, 1).astype(float)), "array<double>")
ORACLE |= KERNELS | STEPS

"""Queries of the remaining operators. Those on images take the 8x8 images, enlarged; SQL can't state them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumaframe.operators import augment as G
from lumaframe.operators import camera as C
from lumaframe.operators import detect as D
from lumaframe.operators import drawing as W
from lumaframe.operators import inference as I
from lumaframe.operators import kernels as K
from lumaframe.operators import markers as R
from lumaframe.operators import motion as M
from lumaframe.operators import photo as P
from lumaframe.operators import tracking as T
from lumaframe.operators import windows as N
from lumaframe.operators.images import on_pixels
from lumaframe.plans.inputs import BOX, boxes, images, rows, table
from lumaframe.plans.kernel_sql import COLORS
from lumaframe.plans.vision_sql import VISION

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def enlarged(a: np.ndarray, side: int = 32) -> np.ndarray:
    return K.resize(a, side, side)


def color(a: np.ndarray, side: int = 16) -> np.ndarray:
    b = enlarged(a, side)
    return np.dstack([b, b.T, 255 - b])


def numbers(found) -> np.ndarray:
    """What an operator returns, as one row of numbers."""
    if isinstance(found, dict):
        found = list(found.values())
    if isinstance(found, (list, tuple)):
        return np.concatenate([numbers(f) for f in found]) if found else np.zeros(0)
    if isinstance(found, str):
        return np.zeros(0)
    return np.asarray(found, float).ravel()


def image_query(name: str, f) -> None:
    """What the operator finds on each image: one row a number where SQL states it, otherwise one list an image."""
    if sql := COLORS.get(name) or VISION.get(name):
        QUERIES[name], ORACLE[name] = lambda spark, sf: rows(images(spark, sf), F.transform(on_pixels(lambda a: numbers(f(a)), F.col("px"), 8), lambda v: F.round(v, 4) + F.lit(0.0))), sql
        return
    QUERIES[name] = lambda spark, sf: images(spark, sf).select("img_id", F.transform(on_pixels(lambda a: numbers(f(a)), F.col("px"), 8), lambda v: F.round(v, 4)).alias("found"))


for _name in ("detect_fast", "good_features", "detect_orb", "detect_sift", "detect_brisk", "detect_lines", "describe_orb", "describe_sift", "describe_brisk"):
    image_query(_name, lambda a, f=getattr(D, _name): f(enlarged(a, 40)))
image_query("detect_mser", lambda a: D.detect_mser(enlarged(a, 16), 15))
for _name in ("kaze", "akaze"):
    image_query(f"detect_{_name}", lambda a, f=getattr(D, f"detect_{_name}"): f(enlarged(a, 16), 0.001, 1, 3))
    image_query(f"describe_{_name}", lambda a, f=getattr(D, f"detect_{_name}"), g=D.describe_sift if _name == "kaze" else D.describe_orb: g(enlarged(a, 16), f(enlarged(a, 16), 0.001, 1, 3)))
image_query("detect_blob", lambda a: D.detect_blob(enlarged(a, 24), step=40))
image_query("hough_lines_p", lambda a: D.hough_lines_p(enlarged(a) > 128, 1, np.pi / 45, 12, 8, 2))
image_query("hough_circles", lambda a: D.hough_circles(enlarged(a), 3, 8, 12, 60))
image_query("find_contours", lambda a: D.find_contours(enlarged(a, 16) > 128, False))
image_query("convex_hull", lambda a: D.convex_hull(np.argwhere(a > 128)))
image_query("approx_poly_dp", lambda a: [D.approx_poly_dp(c, 1.0) for c in D.find_contours(enlarged(a, 16) > 128)])
image_query("min_area_rect", lambda a: D.min_area_rect(np.argwhere(a > 128)) if (a > 128).any() else [])
image_query("sparse_lk_flow", lambda a: M.sparse_lk_flow(enlarged(a), np.roll(enlarged(a), 1, 1), np.array([[16.0, 16]]), 11, 1))
image_query("dense_farneback_flow", lambda a: M.dense_farneback_flow(enlarged(a, 16), np.roll(enlarged(a, 16), 1, 0), 7, 1, 2))
image_query("dense_dis_flow", lambda a: M.dense_dis_flow(enlarged(a, 16), np.roll(enlarged(a, 16), 1, 1), "fast"))
image_query("mean_shift", lambda a: M.mean_shift(enlarged(a), (4, 4, 12, 12)))
image_query("cam_shift", lambda a: M.cam_shift(enlarged(a), (4, 4, 12, 12)))
image_query("nl_means_denoising_multi", lambda a: K.nl_means_multi([a, a[::-1], a], 10, 3, 5))
image_query("seamless_clone", lambda a: P.seamless_clone(color(a), color(a.T), np.pad(np.ones((4, 4)), 6), (8, 8)))
for _name in ("edge_preserving_filter", "detail_enhance", "stylize", "pencil_sketch"):
    image_query(_name, lambda a, f=getattr(P, _name): f(color(a)))
image_query("merge_hdr", lambda a: P.merge_hdr([color(a) // 2, color(a)]))
image_query("tone_map", lambda a: P.tone_map(color(a) / 255.0, "reinhard"))
image_query("inpaint", lambda a: P.inpaint(a, np.pad(np.ones((2, 2)), 3), 2))
image_query("grab_cut", lambda a: P.grab_cut(color(a), (3, 3, 9, 9), 2))
image_query("stitch", lambda a: P.stitch([color(a, 48)[:, :32], color(a, 48)[:, 16:]])[0])
for _name in ("hsv", "lab", "ycrcb"):
    image_query(f"to_{_name}", lambda a, f=getattr(K, _name): f(color(a, 8)))
    image_query(f"to_bgr_from_{_name}", lambda a, f=getattr(K, f"bgr_from_{_name}"), g=getattr(K, _name): f(g(color(a, 8))))
image_query("montage", lambda a: W.montage([a, a.T, 255 - a]))
image_query("draw_line", lambda a: W.draw_line(color(a), (1, 1), (12, 9)))
image_query("draw_circle", lambda a: W.draw_circle(color(a), (8, 8), 5))
image_query("draw_rectangle", lambda a: W.draw_rectangle(color(a), (2, 3, 9, 8)))
image_query("draw_text", lambda a: W.draw_text(color(a), "a1", (1, 12), 1))
image_query("draw_contours", lambda a: W.draw_contours(color(a), D.find_contours(enlarged(a, 16) > 128)))
image_query("draw_keypoints", lambda a: W.draw_keypoints(enlarged(a), D.detect_fast(enlarged(a))))
image_query("bounding_box_overlay", lambda a: W.draw_bounding_boxes(color(a), [{"x": 2, "y": 3, "w": 8, "h": 7, "class_id": 1, "label": "a", "confidence": 0.5}]))

_STEPS = {
    "random_flip": G.RandomFlip(), "random_rotate": G.RandomRotate(), "random_crop": G.RandomCrop(10, 10), "random_resize": G.RandomResize((10, 14)), "random_zoom": G.RandomZoom(), "random_shear": G.RandomShear(), "random_perspective": G.RandomPerspective(),
    "random_brightness": G.random_brightness(), "random_contrast": G.random_contrast(), "color_jitter": G.color_jitter(), "random_grayscale": G.random_grayscale(0.5), "random_equalize": G.random_equalize(), "random_blur": G.random_blur(3, 5), "random_sharpness": G.random_sharpness(), "random_erasing": G.random_erasing(),
    "grid_dropout": G.grid_dropout(), "random_gaussian_noise": G.random_gaussian_noise(), "random_salt_and_pepper": G.random_salt_and_pepper(), "random_apply": G.RandomApply(G.RandomFlip(1.0)), "one_of": G.OneOf([G.random_brightness(), G.random_contrast()]), "compose": G.Compose([G.RandomFlip(), G.random_brightness()]),
}
for _name, _step in _STEPS.items():
    image_query(_name, lambda a, s=_step: s({"image": color(a), "boxes": np.array([[2.0, 3, 8, 7]])}, G.generator(int(a.sum()), 1)))
image_query("mix_up", lambda a: G.mix_up()({"image": a, "labels": [1, 0]}, {"image": a.T, "labels": [0, 1]}, G.generator(int(a.sum()), 1)))
image_query("cut_mix", lambda a: G.cut_mix()({"image": a, "labels": [1, 0]}, {"image": a.T, "labels": [0, 1]}, G.generator(int(a.sum()), 1)))

_K, _BOARD = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]]), C.make_chessboard_points(5, 4, 0.03)


def pose(a: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    v = a.ravel()[6 * k : 6 * k + 6] / 255.0
    return v[:3] * 0.4 - 0.2, np.array([v[3] * 0.1 - 0.1, v[4] * 0.1 - 0.1, 0.4 + v[5] * 0.2])


def views(a: np.ndarray, n: int = 4) -> list[np.ndarray]:
    return [C.project_points(_BOARD, *pose(a, k), _K) for k in range(n)]


def cloud(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points before two cameras, and their pixels in both."""
    x = np.stack([np.repeat(np.arange(8), 8) / 4 - 1, np.tile(np.arange(8), 8) / 4 - 1, 3 + a.ravel() / 255.0], axis=1)
    return x, C.project_points(x, np.zeros(3), np.zeros(3), _K), C.project_points(x, np.array([0.05, 0.1, -0.02]), np.array([-0.5, 0.05, 0.02]), _K)


image_query("project_points", lambda a: C.project_points(_BOARD, *pose(a), _K, [0.1, -0.05, 0.001, 0.001, 0]))
image_query("solve_pnp", lambda a: C.solve_pnp(_BOARD, views(a, 1)[0], _K))
image_query("solve_pnp_ransac", lambda a: C.solve_pnp_ransac(_BOARD, views(a, 1)[0], _K, (), 8.0, 5)[0])
image_query("find_homography", lambda a: C.find_homography(*cloud(a)[1:])[1])
image_query("find_fundamental_mat", lambda a: C.find_fundamental_mat(*cloud(a)[1:])[1])
image_query("find_essential_mat", lambda a: C.find_essential_mat(*cloud(a)[1:], _K)[1])
image_query("recover_pose", lambda a: C.recover_pose(C.eight_points(*[(p - [320, 240]) / [500, 510] for p in cloud(a)[1:]]), *cloud(a)[1:], _K))
image_query("triangulate_points", lambda a: C.triangulate_points(_K @ np.eye(3, 4), _K @ np.column_stack([C.rotation([0.05, 0.1, -0.02]), [-0.5, 0.05, 0.02]]), *cloud(a)[1:]))
image_query("undistort", lambda a: C.undistort(a, np.array([[8.0, 0, 4], [0, 8, 4], [0, 0, 1]]), [0.1, 0.01, 0, 0, 0]))
image_query("undistort_map", lambda a: C.undistort_map(np.array([[8.0, 0, 4], [0, 8, 4], [0, 0, 1]]), [float(a[0, 0]) / 2550, 0.01, 0, 0, 0], 8, 8))
image_query("fisheye_undistort", lambda a: C.fisheye_undistort(a, np.array([[8.0, 0, 4], [0, 8, 4], [0, 0, 1]]), [0.05, 0.01, 0, 0]))
image_query("fisheye_undistort_points", lambda a: C.fisheye_undistort_points(np.argwhere(a > 128) * 40.0, _K, [0.05, 0.01, 0, 0]))
image_query("fisheye_init_rectify_map", lambda a: C.fisheye_init_rectify_map(np.array([[8.0, 0, 4], [0, 8, 4], [0, 0, 1]]), [float(a[0, 0]) / 2550, 0, 0, 0], 8, 8))
image_query("stereo_rectify", lambda a: C.stereo_rectify(_K, _K, C.rotation(pose(a)[0]), np.array([-0.5, 0.05, 0.02])))
image_query("stereo_bm", lambda a: C.stereo_bm(enlarged(a), np.roll(enlarged(a), -3, 1), 8, 5))
image_query("stereo_sgbm", lambda a: C.stereo_sgbm(enlarged(a, 16), np.roll(enlarged(a, 16), -3, 1), 8, 3))
image_query("detect_aruco", lambda a: R.detect_aruco(np.pad(R.generate_aruco(R.aruco_dict(20), int(a.sum()) % 20, 48), 16, constant_values=220), R.aruco_dict(20))[0])
image_query("draw_aruco", lambda a: R.draw_markers(color(a, 32), [(int(a.sum()) % 20, np.array([[4.0, 4], [26, 4], [26, 26], [4, 26]]))]))
#: A cascade of one stump: the right half of a window is brighter than the left one.
_STUMP = N.Cascade(12, 12, (np.array([[0, 0, 12, 12, -1.0], [6, 0, 6, 12, 2.0]]),), ((0.5, ((np.array([[0, -1, 0, 0.25]]), np.array([0.0, 1.0])),)),))
image_query("detect_haar", lambda a: N.detect_haar(enlarged(a, 40), _STUMP, 1.2, 2))
image_query("hog_descriptor", lambda a: N.hog_descriptor(enlarged(a, 32)))
image_query("detect_hog", lambda a: N.detect_hog(enlarged(a, 48), np.append(N.hog_descriptor(enlarged(np.tile(np.arange(0, 256, 32), (8, 1)), 32)), -8.0), (32, 32), 1.3))
image_query("refine_corners", lambda a: R.refine_corners(enlarged(a), np.array([[16.0, 16]])))
image_query("yolo_decode", lambda a: I.yolo(np.concatenate([a[:, :4] / 4.0, a[:, 4:5] / 255.0, np.eye(8)[:, :3]], axis=1)[None], 64, 64, (64, 64), 0.3, 0.4, ["a", "b"], "v5"))
image_query("ssd_decode", lambda a: I.ssd(np.concatenate([np.zeros((8, 1)), np.arange(8)[:, None] % 2, a[:, :1] / 255.0, a[:, 1:3] / 510.0, 0.5 + a[:, 3:5] / 510.0], axis=1), 64, 64))
image_query("segment_argmax", lambda a: I.segment(np.stack([a, a.T, a[::-1]]).astype(float)[None], 12, 12))
image_query("instance_masks", lambda a: I.instance_masks(a.reshape(2, 4, 8) / 128.0 - 1, np.array([[1.0, 0.5]])))
image_query("top_k_classes", lambda a: I.top_k(a[0] / 255.0, 3, []))


def _per_source(spark, sf):
    """Detections: each user's events as frames, with a box that drifts."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source_id"), "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("frame"), "value")
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    drift = 3 * F.col("frame") + F.col("event_id") % 5
    return e.select("source_id", "frame", "value", "event_id", k).select("source_id", "frame", F.col("k").cast("bigint").alias("k"), (drift + 200 * F.col("k")).cast("double").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(30.0).alias("h"), (F.col("value") / 500 * (1 - 0.5 * F.col("k"))).alias("confidence"))


def _tracked(kind):
    def run(spark, sf):
        out = T.track(_per_source(spark, sf), kind)
        return out.select("source_id", "frame", "track_id", *[F.round(c, 4).alias(c) for c in ("x", "y", "w", "h")], F.round("confidence", 6).alias("confidence"), "age", "is_confirmed")

    return run


for _name in T.TRACKERS:
    QUERIES[f"{_name}_tracker"] = _tracked(_name)


def tracking_eval(spark, sf):
    truths = _per_source(spark, sf).withColumn("gt_id", F.col("k"))
    m = T.tracking_eval(T.track(_per_source(spark, sf), "iou"), truths)
    return m.select("tp", "fp", "fn", "id_switches", *[F.round(c, 6).alias(c) for c in ("mota", "motp", "precision", "recall", "idf1")])


def background_models(spark, sf):
    """Foreground pixels of a sequence of 8x8 frames, for each label's images in order of id."""
    from lumaframe.operators.groups import per_group

    im = images(spark, sf).select("label", "img_id", "px")

    def run(g):
        models = (M.BackgroundMixture(), M.BackgroundNeighbours())
        seen = [[int((m.update(np.array(p, np.uint8).reshape(8, 8)) == 255).sum()) for m in models] for p in g["px"]]
        return {"label": g["label"], "img_id": g["img_id"], "mixture": np.array([s[0] for s in seen], np.int64), "neighbours": np.array([s[1] for s in seen], np.int64)}

    return per_group(im.select(F.col("label").cast("long"), "img_id", "px"), ["label"], ["img_id"], run, "label long, img_id long, mixture long, neighbours long")


QUERIES |= {f.__name__: f for f in (tracking_eval, background_models)}
#: A user's two boxes stay 200 apart and move by at most 7 and 6 a frame, so each overlaps itself by over 0.4 and no other: track k follows box k.
_LANES = "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events), b AS (SELECT source_id, frame, CAST(k AS INT) AS k, (3 * frame + event_id % 5 + 200 * k)::DOUBLE AS x, (event_id % 7)::DOUBLE AS y, round(value / 500 * (1 - 0.5::DOUBLE * k), 6) AS confidence FROM e, range(2) r(k))"
ORACLE["iou_tracker"] = f"{_LANES} SELECT source_id, frame, k AS track_id, x, y, 30.0::DOUBLE AS w, 30.0::DOUBLE AS h, confidence, 0 AS age, true AS is_confirmed FROM b"
ORACLE["tracking_eval"] = f"{_LANES} SELECT count(*) AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 0::BIGINT AS id_switches, 1.0::DOUBLE AS mota, 1.0::DOUBLE AS motp, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS idf1 FROM b"


def contour_measures(spark, sf):
    """Area, perimeter and frame of each order's boxes' corners as a closed chain, in order of position."""
    b = boxes(spark, sf).groupBy("frame").agg(F.sort_array(F.collect_set(F.struct("x", "y"))).alias("p")).where(F.size("p") > 2)
    xs, ys = F.transform("p", lambda t: t["x"].cast("double")), F.transform("p", lambda t: t["y"].cast("double"))
    r = D.bounding_rect(xs, ys)
    return b.select("frame", F.round(D.contour_area(xs, ys), 6).alias("area"), F.round(D.contour_perimeter(xs, ys), 6).alias("perimeter"), r["x"].alias("x"), r["y"].alias("y"), r["w"].alias("w"), r["h"].alias("h"))


QUERIES["contour_measures"] = contour_measures
ORACLE["contour_measures"] = f"""WITH {BOX}, p AS (SELECT DISTINCT frame, x::DOUBLE AS x, y::DOUBLE AS y FROM bx), o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x, y) AS k, count(*) OVER (PARTITION BY frame) AS n FROM p),
 e AS (SELECT a.frame, a.x, a.y, b.x AS nx, b.y AS ny FROM o a JOIN o b ON a.frame = b.frame AND b.k = a.k % a.n + 1 WHERE a.n > 2)
SELECT frame, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area, round(sum(sqrt((x - nx) ** 2 + (y - ny) ** 2)), 6) AS perimeter, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM e GROUP BY frame"""


def make_chessboard_points(spark, sf):
    n = table(spark, sf, "nation")
    points, k = C.make_chessboard_points(5, 5, 0.5), F.col("n_nationkey").cast("int")
    at = lambda c: F.get(F.array(*[F.lit(float(v)) for v in points[:, c]]), k)
    return n.select(k.alias("k"), at(0).alias("x"), at(1).alias("y"))


QUERIES["chessboard_points"] = make_chessboard_points
ORACLE["chessboard_points"] = "SELECT CAST(n_nationkey AS INT) AS k, n_nationkey % 5 * 0.5::DOUBLE AS x, n_nationkey // 5 * 0.5::DOUBLE AS y FROM nation"


def project_columns(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("x"), (F.col("user_id") / 50.0).alias("y"), (F.lit(2.0) + F.col("event_id") % 9).alias("z"))
    u, v = C.project_columns(F.col("x"), F.col("y"), F.col("z"), 500, 510, 320, 240, 0.01)
    return e.select("event_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


QUERIES["project_points_columns"] = project_columns
ORACLE["project_points_columns"] = "WITH e AS (SELECT event_id, value / 100 / (2.0 + event_id % 9)::DOUBLE AS a, user_id / 50.0::DOUBLE / (2.0 + event_id % 9)::DOUBLE AS b FROM events) SELECT event_id, round(a * (1 + (a * a + b * b) * 0.01::DOUBLE) * 500 + 320, 4) AS u, round(b * (1 + (a * a + b * b) * 0.01::DOUBLE) * 510 + 240, 4) AS v FROM e"


def reproject(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), (F.lit(1.0) + F.col("event_id") % 9).alias("d"))
    c = C.reproject_columns(F.col("x"), F.col("y"), F.col("d"), [[1, 0, 0, -320], [0, 1, 0, -240], [0, 0, 0, 500], [0, 0, 2, 0]])
    return e.select("event_id", *[v.alias(n) for v, n in zip(c, ("px", "py", "pz"), strict=True)])


QUERIES["reproject_to_3d"] = reproject
ORACLE["reproject_to_3d"] = "SELECT event_id, (user_id - 320.0::DOUBLE) / (2.0::DOUBLE * (1 + event_id % 9)) AS px, (value - 240.0::DOUBLE) / (2.0::DOUBLE * (1 + event_id % 9)) AS py, 500.0::DOUBLE / (2.0::DOUBLE * (1 + event_id % 9)) AS pz FROM events"


def dataset_split(spark, sf):
    from lumaframe.sources.folders import split_by_rank

    return split_by_rank(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0.2, 0.1, 7, ("val", "test", "train")).groupBy("lang", "split").agg(F.count("*").alias("n"))


QUERIES["dataset_split"] = dataset_split
ORACLE["dataset_split"] = "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT lang, n, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS t, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS v FROM c) SELECT lang, 'test' AS split, t AS n FROM s WHERE t > 0 UNION ALL SELECT lang, 'val', v FROM s WHERE v > 0 UNION ALL SELECT lang, 'train', n - t - v FROM s"

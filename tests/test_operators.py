"""Hand-computed cases, laziness by call counts, trackers, sources and camera geometry."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumaframe.errors import FormatError, ParameterError
from lumaframe.functions import pixel
from lumaframe.functions.distance import iou
from lumaframe.operators import augment, camera, evaluation, kernels
from lumaframe.operators.images import apply, decode, encode
from lumaframe.operators.matching import hungarian, nms
from lumaframe.operators.tracking import track, tracking_eval
from lumaframe.operators.views import View
from lumaframe.schema import check_conversion
from lumaframe.sources import folders


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_iou_constants(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, iou(*lit(0, 0, 10, 10, 5, 5, 10, 10))) == pytest.approx(25 / 175)
    assert one(spark, iou(*lit(0, 0, 0, 0, 0, 0, 0, 0))) == 0


def test_average_precision_of_constant_curves(spark):
    curve = lambda p: spark.createDataFrame([(1, 0.5, p), (1, 1.0, p)], "cls int, recall double, precision double")
    assert evaluation.average_precision(curve(1.0)).first()["ap"] == pytest.approx(1)
    assert evaluation.average_precision(curve(0.0)).first()["ap"] == 0


def test_quality_of_identical_images():
    a = np.arange(1200, dtype=np.uint8).reshape(20, 20, 3)
    assert kernels.psnr(a, a) == math.inf and kernels.mse(a, a) == 0
    assert kernels.ssim(a, a) == pytest.approx(1) and kernels.gmsd(a, a) == pytest.approx(0, abs=1e-9)


def test_divide_by_zero_and_constant_images(spark):
    a, z = F.array(F.lit(7), F.lit(9)), F.array(F.lit(0), F.lit(3))
    assert one(spark, pixel.divide(a, z)) == [0, 3]
    assert one(spark, pixel.normalize_to(F.array(F.lit(5), F.lit(5)), 1.0, 2.0)) == [0.0, 0.0]
    with pytest.raises(ParameterError):
        pixel.contrast(a, 0)


def test_conversions():
    check_conversion("BGR", "HSV")
    with pytest.raises(FormatError):
        check_conversion("HSV", "LAB")
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (12, 9, 3)).astype(np.uint8)
    for there, back in ((kernels.hsv, kernels.bgr_from_hsv), (kernels.lab, kernels.bgr_from_lab), (kernels.ycrcb, kernels.bgr_from_ycrcb)):
        assert np.abs(back(there(a)).astype(int) - a).mean() < 4


def test_hungarian_is_least():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in range(1, 6):
        for _ in range(20):
            c = rng.integers(0, 5, (n, n)).astype(float)
            assert sum(c[r, k] for r, k in hungarian(c)) == min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n)))
    assert hungarian(np.zeros((0, 3))) == []


def test_nms_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 0, 0, 10, 10, 9), (1, 1, 1, 10, 10, 8), (1, 30, 30, 5, 5, 1)], "f int, x int, y int, w int, h int, conf int")
    assert sorted(r["conf"] for r in nms(df, ["f"], [F.col("conf").desc()], 0.3).collect()) == [1, 9]


def test_view_runs_kernels_only_for_what_is_taken(spark, tmp_path):
    log = str(tmp_path / "calls")

    def kernel(v):
        with open(log, "a") as f:
            f.write("x")
        return v * 2

    df = spark.range(200).select(F.col("id").alias("ord"), F.col("id").cast("double").alias("value"))
    assert View(df).transform(kernel, "double").take(16).to_list() == [2.0 * k for k in range(16)]
    assert os.path.getsize(log) == 16
    os.remove(log)
    kept = View(df).transform(kernel, "double").filter(F.col("value") >= 380).to_list()
    assert kept == [2.0 * k for k in range(190, 200)] and os.path.getsize(log) == 200
    with pytest.raises(ParameterError):
        View(df).batch(0)


def detections(spark, rows):
    return spark.createDataFrame([("s", f, k, *map(float, b), c) for f, k, b, c in rows], "source_id string, frame long, k long, x double, y double, w double, h double, confidence double")


def test_trackers(spark):
    rows = [(f, k, (10 * k * 5 + 2 * f, 20, 20, 20), 0.9 if k == 0 else 0.4) for f in range(6) for k in range(2)]
    df = detections(spark, rows)
    for kind in ("iou", "sort"):
        out = track(df, kind).toPandas()
        assert out.groupby("track_id").frame.count().tolist() == [6, 6], kind
    assert sorted(track(df, "byte").toPandas().track_id.unique()) == [0]
    assert track(df, "sort").where("is_confirmed").agg(F.min("frame")).first()[0] == 2
    with pytest.raises(ParameterError):
        track(df, "none")


def test_tracking_eval_constants(spark):
    box = "source_id string, frame long, {} int, x double, y double, w double, h double"
    gt = spark.createDataFrame([("s", 0, 1, 0.0, 0.0, 10.0, 10.0), ("s", 1, 1, 0.0, 0.0, 10.0, 10.0)], box.format("gt_id"))
    shifted = spark.createDataFrame([("s", 0, 0, 2.0, 0.0, 10.0, 10.0), ("s", 1, 1, 2.0, 0.0, 10.0, 10.0)], box.format("track_id"))
    m = tracking_eval(shifted, gt, 0.3).first()
    assert m["id_switches"] == 1 and m["motp"] == pytest.approx(80 / 120) and m["mota"] == pytest.approx(0.5) and m["idf1"] == pytest.approx(0.5)
    none = tracking_eval(shifted.limit(0), gt).first()
    assert none["fn"] == 2 and none["mota"] == 0


def test_streaming_tracker(spark, tmp_path):
    from lumaframe.streaming.trackers import frames, track_stream

    rows = [(f, 0, (2.0 * f, 20, 20, 20), 0.9) for f in range(4)]
    df = detections(spark, rows)
    for f in range(4):
        df.where(F.col("frame") == f).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "source_id string, frame long, k long, x double, y double, w double, h double, confidence double"
    q = track_stream(frames(spark, str(tmp_path / "in"), schema), "iou").writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT frame, track_id, is_confirmed FROM tracked ORDER BY frame").collect()
    assert got == [Row(frame=f, track_id=0, is_confirmed=True) for f in range(4)]


@pytest.fixture
def tree(tmp_path):
    rng = np.random.default_rng(0)
    for c in ("cat", "dog"):
        (tmp_path / "set" / c).mkdir(parents=True)
        for i in range(10):
            (tmp_path / "set" / c / f"{i}.png").write_bytes(folders.png(rng.integers(0, 255, (6, 5, 3)).astype(np.uint8)))
    return tmp_path


def test_dataset_and_files(spark, tree):
    df = folders.load_dataset(spark, str(tree / "set"))
    counts = {(r["label"], r["class_id"], r["split"]): r["count"] for r in df.groupBy("label", "class_id", "split").count().collect()}
    assert counts == {(c, i, s): n for i, c in enumerate(("cat", "dog")) for s, n in (("test", 2), ("train", 7), ("val", 1))}
    done = folders.imwrite(df.select(F.concat_ws("-", "label", F.regexp_extract("path", r"(\d+)\.png", 1)).alias("name"), "image"), str(tree / "out"))
    assert done.where("error IS NOT NULL").count() == 0 and len(list((tree / "out").glob("*.png"))) == 20
    with pytest.raises(FormatError):
        folders.imread(spark, str(tree / "set/cat/0.png"), "HSV")
    with pytest.raises(ParameterError):
        folders.load_dataset(spark, str(tree / "set"), 0.6, 0.4)


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 2, "file_name": "b.jpg"}, {"id": 1, "file_name": "a.png"}], "annotations": [{"image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4], "iscrowd": 0}, {"image_id": 1, "category_id": 3, "bbox": [5, 6, 7, 8], "iscrowd": 1}, {"image_id": 1, "category_id": 99, "bbox": [5, 6, 7, 8]}], "categories": [{"id": 3, "name": "x"}, {"id": 7, "name": "y"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    got = {r["image_id"]: [(b["x"], b["w"], b["label"]) for b in r["boxes"]] for r in folders.parse_coco(spark, str(tmp_path / "c.json")).collect()}
    assert got == {1: [(1.0, 3.0, "y")], 2: []}
    assert len(folders.parse_coco(spark, str(tmp_path / "c.json"), skip_crowd=False).where("image_id = 1").first()["boxes"]) == 2


def test_kernel_errors_stay_in_their_row(spark):
    a = np.zeros((4, 4), np.uint8)
    df = spark.createDataFrame([(1, encode(a)), (2, encode(np.zeros((2, 2), np.uint8)))], "id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary,fmt:string>")

    def strict(img):
        if img.shape[0] < 3:
            raise ValueError("too small")
        return img + 1

    got = {r["id"]: r for r in apply(df, strict).collect()}
    assert decode(got[1]["image"].asDict()).sum() == 16 and got[2]["image"] is None and "too small" in got[2]["error"]


def test_augmentation_repeats(spark):
    a = np.random.default_rng(0).integers(0, 255, (20, 30, 3)).astype(np.uint8)
    df = spark.createDataFrame([(k, encode(a), [Row(x=2.0, y=3.0, w=10.0, h=8.0, label="c")]) for k in range(4)], "id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary,fmt:string>, boxes array<struct<x:double,y:double,w:double,h:double,label:string>>")
    step = augment.Compose([augment.RandomFlip(), augment.RandomRotate(), augment.random_brightness()])
    x, y = (augment.augment(df.repartition(n), step, "id", 5, boxes="boxes").orderBy("id").collect() for n in (1, 3))
    assert x == y and any(r["image"]["data"] != bytes(encode(a)["data"]) for r in x)
    flipped = augment.RandomFlip(1.0)({"image": a, "boxes": np.array([[2.0, 3, 10, 8]])}, augment.generator(0, 0))
    assert flipped["boxes"].tolist() == [[18, 3, 10, 8]]


def test_camera_round_trip():
    k, dist = np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]]), np.array([0.1, -0.05, 0.001, -0.001, 0])
    o, rng = camera.make_chessboard_points(7, 5, 0.03), np.random.default_rng(1)
    poses = [(rng.uniform(-0.4, 0.4, 3), np.array([*rng.uniform(-0.1, 0, 2), rng.uniform(0.4, 0.6)])) for _ in range(4)]
    views = [camera.project_points(o, r, t, k, dist) for r, t in poses]
    found = camera.calibrate_camera([o] * 4, views, 640, 480)
    assert found["rms"] < 1e-6 and np.allclose(found["k"], k, atol=1e-3)
    r, t = camera.solve_pnp(o, views[0], k, dist)
    assert np.allclose(r, poses[0][0]) and np.allclose(t, poses[0][1])
    with pytest.raises(ParameterError):
        camera.calibrate_camera([o] * 2, views[:2], 640, 480)

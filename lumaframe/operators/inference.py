"""Model inference by onnxruntime, if it is installed: one session in each Python worker, one thread in each session."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.errors import require
from lumaframe.operators import kernels as K
from lumaframe.operators.evaluation import iou_matrix
from lumaframe.operators.images import decode

RESULTS = "array<struct<class_id: int, label: string, score: float>>"
DETECTIONS = "array<struct<x: float, y: float, w: float, h: float, class_id: int, confidence: float, label: string>>"


@lru_cache(maxsize=4)
def session(path: str):
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads, options.graph_optimization_level = 1, ort.GraphOptimizationLevel.ORT_ENABLE_ALL
    return ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def run_model(path: str, inputs: list[np.ndarray]) -> list[np.ndarray]:
    s = session(path)
    require(len(inputs) == len(s.get_inputs()), f"the model takes {len(s.get_inputs())} inputs")
    return s.run(None, {i.name: np.asarray(a, np.float32) for i, a in zip(s.get_inputs(), inputs, strict=True)})


def blob(img: np.ndarray, width: int, height: int, scale: float = 1 / 255, mean: tuple[float, ...] = (0, 0, 0), swap: bool = True) -> np.ndarray:
    """1 x 3 x height x width: resized, scaled, less the mean, channels swapped to RGB if asked."""
    a = K.resize(img if img.ndim == 3 else K.bgr_from_gray(img), width, height)[..., :3].astype(np.float32)
    a = (a[..., ::-1] if swap else a) * np.float32(scale) - np.asarray(mean, np.float32)
    return np.ascontiguousarray(a.transpose(2, 0, 1)[None])


def top_k(scores: np.ndarray, k: int, labels: list[str]) -> list[dict]:
    """The k greatest scores as they are; ties by class."""
    flat = np.asarray(scores, float).ravel()
    order = np.lexsort((np.arange(len(flat)), -flat))[:k]
    return [{"class_id": int(i), "label": labels[i] if i < len(labels) else "", "score": float(flat[i])} for i in order]


def suppressed(boxes: np.ndarray, scores: np.ndarray, least: float, overlap: float) -> list[int]:
    """Greedy, whatever the class, on boxes cut to whole numbers; scores over least only."""
    whole, kept = np.trunc(boxes), []
    for i in np.lexsort((np.arange(len(scores)), -scores)):
        if scores[i] > least and (not kept or iou_matrix(whole[[i]], whole[kept]).max() <= overlap):
            kept.append(int(i))
    return kept


def yolo(out: np.ndarray, width: int, height: int, size: tuple[int, int], least: float = 0.5, overlap: float = 0.4, labels: list[str] = (), layout: str | None = None) -> list[dict]:
    """Detections of a YOLO head: rows of (cx, cy, w, h, object, classes) or, if there are fewer rows than columns, columns of (cx, cy, w, h, classes)."""
    a = np.asarray(out, float).reshape(out.shape[-2:])
    new = layout == "v8" if layout else a.shape[0] < a.shape[1]
    a = a.T if new else a
    classes = a[:, 4:] if new else a[:, 5:] * a[:, 4:5]
    if not classes.size:
        return []
    best = classes.argmax(1)
    score = classes[np.arange(len(a)), best]
    sx, sy = width / size[0], height / size[1]
    boxes = np.stack([(a[:, 0] - a[:, 2] / 2) * sx, (a[:, 1] - a[:, 3] / 2) * sy, a[:, 2] * sx, a[:, 3] * sy], axis=1)
    return named(np.trunc(boxes), best, score, suppressed(boxes, score, least, overlap), labels)


def ssd(out: np.ndarray, width: int, height: int, least: float = 0.5, overlap: float = 0.4, labels: list[str] = ()) -> list[dict]:
    """Detections of rows (image, class, score, x1, y1, x2, y2), corners from 0 to 1."""
    a = np.asarray(out, float).reshape(-1, 7)
    boxes = np.stack([a[:, 3] * width, a[:, 4] * height, (a[:, 5] - a[:, 3]) * width, (a[:, 6] - a[:, 4]) * height], axis=1)
    return named(np.trunc(boxes), a[:, 1].astype(int), a[:, 2], suppressed(boxes, a[:, 2], least, overlap), labels)


def named(boxes: np.ndarray, cls: np.ndarray, score: np.ndarray, kept: list[int], labels: list[str]) -> list[dict]:
    return [dict(zip("xywh", map(float, boxes[i]), strict=True)) | {"class_id": int(cls[i]), "confidence": float(score[i]), "label": labels[cls[i]] if cls[i] < len(labels) else ""} for i in kept]


def segment(out: np.ndarray, width: int, height: int) -> np.ndarray:
    """Class of each pixel, the first of equals, enlarged by nearest pixels."""
    cls = np.asarray(out).reshape(out.shape[-3:]).argmax(0).astype(np.uint8)
    return cls[(np.arange(height) * cls.shape[0] // height)[:, None], (np.arange(width) * cls.shape[1] // width)[None, :]]


def instance_masks(prototypes: np.ndarray, weights: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Masks from prototypes (k x h x w) and weights (n x k): the logistic of their sums at least the threshold."""
    return 1 / (1 + np.exp(-np.tensordot(weights, prototypes, 1))) >= least


def _udf(f, result: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([f(decode(r)) for r in part.to_dict("records")], dtype=object)

    return F.pandas_udf(run, result)


def forward(df: DataFrame, path: str, size: tuple[int, int], column: str = "image", **how) -> DataFrame:
    """``output``: the model's first output, flat."""
    return df.withColumn("output", _udf(lambda a: run_model(path, [blob(a, *size, **how)])[0].astype(float).ravel().tolist(), "array<float>")(F.col(column)))


def classify(df: DataFrame, path: str, size: tuple[int, int], k: int = 5, labels: list[str] = (), column: str = "image", **how) -> DataFrame:
    require(k > 0, "k must be over 0")
    return df.withColumn("classes", _udf(lambda a: top_k(run_model(path, [blob(a, *size, **how)])[0], k, list(labels)), RESULTS)(F.col(column)))


def detect(df: DataFrame, path: str, size: tuple[int, int], style: str = "yolo", least: float = 0.5, overlap: float = 0.4, labels: list[str] = (), column: str = "image", **how) -> DataFrame:
    require(style in ("yolo", "ssd"), "style must be yolo or ssd")

    def f(a: np.ndarray) -> list[dict]:
        out = run_model(path, [blob(a, *size, **how)])[0]
        return yolo(out, a.shape[1], a.shape[0], size, least, overlap, list(labels)) if style == "yolo" else ssd(out, a.shape[1], a.shape[0], least, overlap, list(labels))

    return df.withColumn("detections", _udf(f, DETECTIONS)(F.col(column)))


def segmented(df: DataFrame, path: str, size: tuple[int, int], column: str = "image", **how) -> DataFrame:
    return df.withColumn("mask", _udf(lambda a: segment(run_model(path, [blob(a, *size, **how)])[0], a.shape[1], a.shape[0]).tobytes(), "binary")(F.col(column)))


def best_classes(scores: Column, k: int) -> Column:
    """Top k of an array of scores, in the JVM: structs (score, class_id), greatest first."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("n"), i.alias("class_id")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["n"]).alias("score"), p["class_id"].alias("class_id")))

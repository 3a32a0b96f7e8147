"""Detectors that judge every window of an image pyramid by a given model: cascades of rectangle features, and gradient histograms."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from lumaframe.errors import FormatError, require
from lumaframe.operators.evaluation import iou_matrix
from lumaframe.operators.kernels import luminance, resize


@dataclass(frozen=True)
class Cascade:
    """Window size; rectangle features as (x, y, w, h, weight) rows; stages of a threshold and trees.

    A tree is rows (left, right, feature, threshold) and leaf values; a child of 0 or less is the leaf of that number, negated.
    """

    width: int
    height: int
    features: tuple[np.ndarray, ...]
    stages: tuple[tuple[float, tuple[tuple[np.ndarray, np.ndarray], ...]], ...]


def load_cascade(text: str) -> Cascade:
    """A cascade of upright rectangle features from its XML: stages of boosted trees over a list of features."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise FormatError(f"not a cascade: {e}") from e
    body = root.find("cascade") if root.tag != "cascade" else root
    if body is None or (body.findtext("featureType") or "").strip() != "HAAR":
        raise FormatError("not a cascade of rectangle features")
    numbers = lambda node: np.array((node.text or "").split(), float)
    features = []
    for f in body.findall("features/_"):
        if (f.findtext("tilted") or "0").strip() != "0":
            raise FormatError("tilted features aren't read")
        features.append(np.array([numbers(r) for r in f.findall("rects/_")]))
    stages = []
    for s in body.findall("stages/_"):
        trees = [(numbers(t.find("internalNodes")).reshape(-1, 4), numbers(t.find("leafValues"))) for t in s.findall("weakClassifiers/_")]
        stages.append((float(s.findtext("stageThreshold")), tuple(trees)))
    if not features or not stages:
        raise FormatError("a cascade has features and stages")
    return Cascade(int(body.findtext("width")), int(body.findtext("height")), tuple(features), tuple(stages))


def pyramid(img: np.ndarray, width: int, height: int, factor: float):
    """(scale, image) from the whole size down to that of a window."""
    scale = 1.0
    while img.shape[1] / scale >= width and img.shape[0] / scale >= height:
        w, h = round(img.shape[1] / scale), round(img.shape[0] / scale)
        if w < width or h < height:
            return
        yield scale, img if scale == 1 else resize(img, w, h)
        scale *= factor


def passing(img: np.ndarray, cascade: Cascade, step: int) -> np.ndarray:
    """x, y of the windows that pass all stages. Features are divided by the window's deviation, its rim left out."""
    a = img.astype(float)
    total, square = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (a, a * a))
    y, x = (v.ravel() for v in np.mgrid[0 : img.shape[0] - cascade.height + 1 : step, 0 : img.shape[1] - cascade.width + 1 : step])

    def within(table: np.ndarray, dx: int, dy: int, w: int, h: int) -> np.ndarray:
        return table[y + dy + h, x + dx + w] - table[y + dy, x + dx + w] - table[y + dy + h, x + dx] + table[y + dy, x + dx]

    inner = (1, 1, cascade.width - 2, cascade.height - 2)
    spread = inner[2] * inner[3] * within(square, *inner) - within(total, *inner) ** 2
    norm = np.where(spread > 0, np.sqrt(np.maximum(spread, 1)), 1.0)
    for threshold, trees in cascade.stages:
        score, seen = np.zeros(len(x)), {}
        for nodes, leaves in trees:
            at, value = np.zeros(len(x), int), np.full(len(x), np.nan)
            while (open_ := np.isnan(value)).any():
                for k in np.unique(at[open_]):
                    left, right, feature, limit = nodes[k]
                    f = int(feature)
                    if f not in seen:
                        seen[f] = sum(w * within(total, *(int(v) for v in r)) for *r, w in cascade.features[f]) / norm
                    here = np.flatnonzero(open_ & (at == k))
                    child = np.where(seen[f][here] < limit, left, right).astype(int)
                    leaf = child <= 0
                    value[here[leaf]] = leaves[-child[leaf]]
                    at[here[~leaf]] = child[~leaf]
            score += value
        stay = score >= threshold - 1e-5
        x, y, norm = x[stay], y[stay], norm[stay]
        if not len(x):
            break
    return np.stack([x, y], axis=1)


def grouped(boxes: np.ndarray, least: int, apart: float = 0.2) -> np.ndarray:
    """Means of the groups of like boxes (sides and places differ by ``apart`` of the sizes) with at least so many; all boxes for 0."""
    if least <= 0 or not len(boxes):
        return boxes
    label = np.arange(len(boxes))
    for i in range(len(boxes)):
        near = apart * 0.5 * (np.minimum(boxes[:, 2], boxes[i, 2]) + np.minimum(boxes[:, 3], boxes[i, 3]))
        ends = np.stack([boxes[:, 0], boxes[:, 1], boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]], axis=1)
        alike = (np.abs(ends - ends[i]) <= near[:, None]).all(axis=1)
        label[np.isin(label, label[alike])] = label[i]
    found = [boxes[label == k].mean(axis=0) for k in dict.fromkeys(label.tolist()) if (label == k).sum() >= least]
    return np.rint(np.array(found)).reshape(-1, 4)


def detect_haar(img: np.ndarray, cascade: Cascade, scale_factor: float = 1.1, min_neighbors: int = 3, min_size: tuple[int, int] = (0, 0), max_size: tuple[int, int] = (0, 0)) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of what the cascade finds; none raises nothing. A size of (0, 0) is no limit."""
    require(scale_factor > 1 and min_neighbors >= 0, "scale_factor must be over 1, min_neighbors 0 or more")
    found = []
    for scale, level in pyramid(luminance(img), cascade.width, cascade.height, scale_factor):
        w, h = round(cascade.width * scale), round(cascade.height * scale)
        if w < min_size[0] or h < min_size[1] or any(max_size) and (w > max_size[0] or h > max_size[1]):
            continue
        found += [(round(x * scale), round(y * scale), w, h) for x, y in passing(level, cascade, 1 if scale > 2 else 2)]
    return [tuple(int(v) for v in b) for b in grouped(np.array(found, float).reshape(-1, 4), min_neighbors)]


# --- gradient histograms ----------------------------------------------------------------------------------------------

CELL, BINS, CUT = 8, 9, 0.2


def gradient_cells(img: np.ndarray) -> np.ndarray:
    """(rows, columns, BINS) sums of gradient lengths by unsigned direction, shared between the two nearest; of a colour image the strongest channel."""
    a = img.astype(float).reshape(*img.shape[:2], -1)
    p = np.pad(a, ((1, 1), (1, 1), (0, 0)), mode="edge")
    dx, dy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    size = np.hypot(dx, dy)
    best = size.argmax(axis=2)[..., None]
    dx, dy, size = (np.take_along_axis(v, best, 2)[..., 0] for v in (dx, dy, size))
    turn = (np.degrees(np.arctan2(dy, dx)) % 180) / (180 / BINS) - 0.5
    low = np.floor(turn).astype(int)
    share = turn - low
    h, w = img.shape[0] // CELL, img.shape[1] // CELL
    out = np.zeros((h, w, BINS))
    y, x = (v[: h * CELL, : w * CELL] // CELL for v in np.mgrid[0 : img.shape[0], 0 : img.shape[1]])
    inside = np.s_[: h * CELL, : w * CELL]
    np.add.at(out, (y, x, low[inside] % BINS), (size * (1 - share))[inside])
    np.add.at(out, (y, x, (low[inside] + 1) % BINS), (size * share)[inside])
    return out


def gradient_blocks(img: np.ndarray) -> np.ndarray:
    """(rows - 1, columns - 1, 4 * BINS): every 2 x 2 cells, scaled to length 1, cut at CUT and scaled again."""
    cells = gradient_cells(img)
    if min(cells.shape[:2]) < 2:
        return np.zeros((0, 0, 4 * BINS))
    blocks = sliding_window_view(cells, (2, 2), axis=(0, 1)).transpose(0, 1, 3, 4, 2).reshape(cells.shape[0] - 1, cells.shape[1] - 1, -1)
    unit = lambda v: v / np.sqrt((v * v).sum(axis=2, keepdims=True) + 1e-6)
    return unit(np.minimum(unit(blocks), CUT))


def hog_descriptor(img: np.ndarray) -> np.ndarray:
    return gradient_blocks(img).ravel()


def detect_hog(img: np.ndarray, svm: np.ndarray, window: tuple[int, int] = (64, 128), scale: float = 1.05, hit_threshold: float = 0.0, overlap: float = 0.5) -> list[dict]:
    """Detections x, y, w, h, class_id 0, label "person", confidence: the logistic of a linear model's value over the blocks of each window.

    svm: a weight for each number of a window's descriptor, perhaps with a constant after them. Windows step by a cell; of those
    that overlap by over ``overlap`` the surest stays.
    """
    svm, (w, h) = np.asarray(svm, float).ravel(), window
    require(scale > 1 and w % CELL == 0 and h % CELL == 0, "scale must be over 1, the window whole cells")
    bw, bh = w // CELL - 1, h // CELL - 1
    size = bw * bh * 4 * BINS
    require(len(svm) in (size, size + 1), f"the model has {size} weights, or one more")
    weights, constant = svm[:size].reshape(bh, bw, 4 * BINS), svm[size] if len(svm) > size else 0.0
    boxes, values = [], []
    for s, level in pyramid(img, w, h, scale):
        blocks = gradient_blocks(level)
        views = sliding_window_view(blocks, (bh, bw), axis=(0, 1))
        value = np.einsum("yxcij,ijc->yx", views, weights) + constant
        for y, x in zip(*np.nonzero(value > hit_threshold), strict=True):
            boxes.append([round(x * CELL * s), round(y * CELL * s), round(w * s), round(h * s)])
            values.append(float(value[y, x]))
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda k: (-values[k], k)):
        if not kept or iou_matrix(np.array([boxes[i]], float), np.array([boxes[k] for k in kept], float)).max() <= overlap:
            kept.append(i)
    return [dict(zip("xywh", boxes[i], strict=True)) | {"class_id": 0, "label": "person", "confidence": 1 / (1 + math.exp(-values[i]))} for i in kept]

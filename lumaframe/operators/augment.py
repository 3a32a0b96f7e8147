"""Seeded random augmentation of images, boxes, masks and label vectors.

A row's draws depend on its id, the step's number and the seed alone, so a task that runs again, or another partitioning, gives
the same images. A step is a function (sample, generator) -> sample, where a sample is a dictionary: image, and as it may be
boxes (n x 4), kept (what rows of boxes are left), mask, instances, labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.errors import require
from lumaframe.operators import kernels as K
from lumaframe.operators.images import decode, encode

Sample = dict
Step = Callable[[Sample, np.random.Generator], Sample]


def chance(p: float) -> None:
    require(0 <= p <= 1, "a probability is from 0 to 1")


def generator(key: int, seed: int) -> np.random.Generator:
    return np.random.default_rng([key & 0xFFFFFFFFFFFFFFFF, seed])


@dataclass
class Compose:
    """Steps one after the other; of images, or of samples with boxes, masks or labels."""

    steps: list[Step]

    def __post_init__(self) -> None:
        require(all(callable(s) for s in self.steps), "every step must be callable")

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        for step in self.steps:
            s = step(s, rng)
        return s


BBoxCompose = SegCompose = Compose


@dataclass
class RandomApply:
    step: Step
    p: float = 0.5

    def __post_init__(self) -> None:
        chance(self.p)

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        return self.step(s, rng) if rng.random() < self.p else s


@dataclass
class OneOf:
    steps: list[Step]

    def __post_init__(self) -> None:
        require(len(self.steps) > 0, "there must be a step to choose")

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        return self.steps[int(rng.integers(len(self.steps)))](s, rng)


def on_image(f: Callable[[np.ndarray, np.random.Generator], np.ndarray]) -> Step:
    """A step that changes pixels only."""
    return lambda s, rng: {**s, "image": f(s["image"], rng)}


def keep_boxes(s: Sample, boxes: np.ndarray, original: np.ndarray, w: int, h: int, share: float) -> Sample:
    """Boxes clipped to the image; those with under the share of their original area go."""
    low, high = np.clip(boxes[:, :2], 0, [w, h]), np.clip(boxes[:, :2] + boxes[:, 2:], 0, [w, h])
    size = np.clip(high - low, 0, None)
    good = (size.prod(1) > 0) & (size.prod(1) >= share * original)
    return {"boxes": np.concatenate([low, size], axis=1)[good], "kept": s.get("kept", np.arange(len(boxes)))[good]}


def warped(s: Sample, matrix: np.ndarray, w: int, h: int, share: float) -> Sample:
    """Image, masks (nearest pixel) and boxes (the frame of their corners) under a homography."""
    out = {**s, "image": K.warp_perspective(s["image"], matrix, w, h)}
    x, y = np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))
    p = np.linalg.inv(matrix) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    col, row = np.rint(p[0] / p[2]).astype(int).reshape(h, w), np.rint(p[1] / p[2]).astype(int).reshape(h, w)
    for name in ("mask", "instances"):
        if s.get(name) is not None:
            m = s[name]
            inside = (row >= 0) & (row < m.shape[0]) & (col >= 0) & (col < m.shape[1])
            out[name] = np.where(inside, m[np.clip(row, 0, m.shape[0] - 1), np.clip(col, 0, m.shape[1] - 1)], 255 if name == "mask" else 0).astype(m.dtype)
    if s.get("boxes") is not None:
        b = s["boxes"]
        corners = np.stack([b[:, [0, 1]], b[:, [0, 1]] + b[:, [2, 3]] * [1, 0], b[:, [0, 1]] + b[:, [2, 3]] * [0, 1], b[:, [0, 1]] + b[:, [2, 3]]], axis=1)
        q = np.concatenate([corners, np.ones((*corners.shape[:2], 1))], axis=2) @ matrix.T
        q = q[..., :2] / q[..., 2:]
        frame = np.concatenate([q.min(1), q.max(1) - q.min(1)], axis=1)
        out |= keep_boxes(s, frame, frame[:, 2:].prod(1), w, h, share)
    return out


@dataclass
class RandomFlip:
    """Mirrors left and right (or up and down) with probability p."""

    p: float = 0.5
    horizontal: bool = True
    min_area_ratio: float = 0.1  # part of the interface; flips lose no area

    def __post_init__(self) -> None:
        chance(self.p)

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        if rng.random() >= self.p:
            return s
        turn = (lambda a: a[:, ::-1]) if self.horizontal else (lambda a: a[::-1])
        out = s | {n: np.ascontiguousarray(turn(s[n])) for n in ("image", "mask", "instances") if s.get(n) is not None}
        if s.get("boxes") is not None:
            b, k = s["boxes"].copy(), 0 if self.horizontal else 1
            b[:, k] = s["image"].shape[1 - k] - b[:, k] - b[:, k + 2]
            out["boxes"] = b
        return out


@dataclass
class RandomRotate:
    """By an angle from the range, about the centre."""

    degrees: tuple[float, float] = (-15, 15)
    min_area_ratio: float = 0.1

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        h, w = s["image"].shape[:2]
        t = math.radians(rng.uniform(*self.degrees))
        a, b = math.cos(t), math.sin(t)
        m = np.array([[a, b, (1 - a) * w / 2 - b * h / 2], [-b, a, b * w / 2 + (1 - a) * h / 2], [0, 0, 1]])
        return warped(s, m, w, h, self.min_area_ratio)


def cut(s: Sample, x: int, y: int, w: int, h: int, share: float) -> Sample:
    out = s | {n: s[n][y : y + h, x : x + w].copy() for n in ("image", "mask", "instances") if s.get(n) is not None}
    if s.get("boxes") is not None:
        out |= keep_boxes(s, s["boxes"] - [x, y, 0, 0], s["boxes"][:, 2:].prod(1), w, h, share)
    return out


@dataclass
class RandomCrop:
    """A place of the given size; boxes stay by the share of their original area that is left."""

    width: int
    height: int
    min_area_ratio: float = 0.1

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        h, w = s["image"].shape[:2]
        require(self.width <= w and self.height <= h, "the crop must fit into the image")
        return cut(s, int(rng.integers(w - self.width + 1)), int(rng.integers(h - self.height + 1)), self.width, self.height, self.min_area_ratio)


def resized(s: Sample, w: int, h: int) -> Sample:
    old = s["image"].shape
    out = {**s, "image": K.resize(s["image"], w, h)}
    for name in ("mask", "instances"):
        if s.get(name) is not None:
            rows, cols = np.arange(h) * old[0] // h, np.arange(w) * old[1] // w
            out[name] = s[name][rows[:, None], cols[None, :]]
    if s.get("boxes") is not None:
        out["boxes"] = s["boxes"] * [w / old[1], h / old[0], w / old[1], h / old[0]]
    return out


@dataclass
class RandomResize:
    """The shorter side to a length from the range."""

    sizes: tuple[int, int] = (224, 256)

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        h, w = s["image"].shape[:2]
        scale = int(rng.integers(self.sizes[0], self.sizes[1] + 1)) / min(h, w)
        return resized(s, max(1, round(w * scale)), max(1, round(h * scale)))


@dataclass
class RandomZoom:
    """A crop of a share of the sides, back at the old size."""

    scale: tuple[float, float] = (0.7, 1.0)
    min_area_ratio: float = 0.1

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        h, w = s["image"].shape[:2]
        k = rng.uniform(*self.scale)
        cw, ch = max(1, round(w * k)), max(1, round(h * k))
        return resized(cut(s, int(rng.integers(w - cw + 1)), int(rng.integers(h - ch + 1)), cw, ch, self.min_area_ratio), w, h)


@dataclass
class RandomShear:
    degrees: float = 10
    min_area_ratio: float = 0.1

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        h, w = s["image"].shape[:2]
        m, k = np.eye(3), int(rng.integers(2))
        m[k, 1 - k] = math.tan(math.radians(rng.uniform(-self.degrees, self.degrees)))
        return warped(s, m, w, h, self.min_area_ratio)


@dataclass
class RandomPerspective:
    """Each corner moved by at most half of scale times the shorter side."""

    scale: float = 0.1
    min_area_ratio: float = 0.1

    def __call__(self, s: Sample, rng: np.random.Generator) -> Sample:
        from lumaframe.operators.camera import homography

        h, w = s["image"].shape[:2]
        corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
        reach = self.scale * min(w, h) / 2
        return warped(s, homography(corners, corners + rng.uniform(-reach, reach, (4, 2))), w, h, self.min_area_ratio)


def bounded(a: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Within 0 to 255, for float images too."""
    a = np.clip(a, 0, 255)
    return np.rint(a).astype(np.uint8) if like.dtype == np.uint8 else a.astype(like.dtype)


def random_brightness(low: float = 0.7, high: float = 1.3) -> Step:
    return on_image(lambda a, rng: bounded(a * rng.uniform(low, high), a))


def random_contrast(low: float = 0.7, high: float = 1.3) -> Step:
    def f(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        k = rng.uniform(low, high)
        return bounded(k * a + (1 - k) * a.mean(axis=(0, 1)), a)

    return on_image(f)


def color_jitter(brightness: float = 0.2, contrast: float = 0.2, saturation: float = 0.2, hue: float = 10) -> Step:
    def f(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        a = bounded(a * rng.uniform(1 - brightness, 1 + brightness), a)
        k = rng.uniform(1 - contrast, 1 + contrast)
        c = K.hsv(bounded(k * a + (1 - k) * a.mean(axis=(0, 1)), a)).astype(float)
        c[..., 1] = np.clip(c[..., 1] * rng.uniform(1 - saturation, 1 + saturation), 0, 255)
        c[..., 0] = np.rint(c[..., 0] + rng.uniform(-hue, hue)) % 180
        return K.bgr_from_hsv(np.rint(c).astype(np.uint8))

    return on_image(f)


def random_grayscale(p: float = 0.1) -> Step:
    chance(p)
    return RandomApply(on_image(lambda a, rng: K.bgr_from_gray(K.gray(a))), p)


def random_solarize(level: int = 128, p: float = 0.5) -> Step:
    return RandomApply(on_image(lambda a, rng: np.where(a >= level, 255 - a, a).astype(np.uint8)), p)


def random_posterize(bits: int = 4, p: float = 0.5) -> Step:
    require(1 <= bits <= 8, "bits must be from 1 to 8")
    return RandomApply(on_image(lambda a, rng: a & np.uint8(256 - (1 << (8 - bits)))), p)


def random_equalize(p: float = 0.5) -> Step:
    return RandomApply(on_image(lambda a, rng: K.equalize(a)), p)


def random_blur(low: int = 3, high: int = 7) -> Step:
    K.odd(low), K.odd(high)

    def f(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        k = low + 2 * int(rng.integers((high - low) // 2 + 1))
        return [K.gaussian_blur, K.median_blur, lambda i, d: K.bilateral_filter(i, d, 75, 75)][int(rng.integers(3))](a, k)

    return on_image(f)


def random_sharpness(low: float = 0.0, high: float = 2.0) -> Step:
    return on_image(lambda a, rng: K.unsharp_mask(a, 3, 0, rng.uniform(low, high)))


def random_erasing(p: float = 0.5, area: tuple[float, float] = (0.02, 0.33), aspect: tuple[float, float] = (0.3, 3.3), fill: int = 0) -> Step:
    """At most ten tries for a rectangle that fits."""

    def f(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if rng.random() >= p:
            return a
        for _ in range(10):
            size, ratio = rng.uniform(*area) * a.shape[0] * a.shape[1], math.exp(rng.uniform(math.log(aspect[0]), math.log(aspect[1])))
            h, w = round(math.sqrt(size * ratio)), round(math.sqrt(size / ratio))
            if 0 < h < a.shape[0] and 0 < w < a.shape[1]:
                y, x = int(rng.integers(a.shape[0] - h + 1)), int(rng.integers(a.shape[1] - w + 1))
                a = a.copy()
                a[y : y + h, x : x + w] = fill
                return a
        return a

    return on_image(f)


def grid_dropout(cells: int = 4, p: float = 0.3) -> Step:
    chance(p)

    def f(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        off = rng.random((cells, cells)) < p
        rows, cols = np.arange(a.shape[0]) * cells // a.shape[0], np.arange(a.shape[1]) * cells // a.shape[1]
        a = a.copy()
        a[off[rows[:, None], cols[None, :]]] = 0
        return a

    return on_image(f)


def random_gaussian_noise(low: float = 5, high: float = 20) -> Step:
    return on_image(lambda a, rng: bounded(a + rng.normal(0, rng.uniform(low, high), a.shape), a))


def random_salt_and_pepper(p: float = 0.02) -> Step:
    chance(p)

    def f(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        r, a = rng.random(a.shape[:2]), a.copy()
        a[r < p / 2] = 255
        a[(r >= p / 2) & (r < p)] = 0
        return a

    return on_image(f)


def mix_up(alpha: float = 0.4) -> Callable[[Sample, Sample, np.random.Generator], Sample]:
    def f(a: Sample, b: Sample, rng: np.random.Generator) -> Sample:
        K.same_size(a["image"], b["image"])
        k = rng.beta(alpha, alpha)
        return {**a, "image": bounded(k * a["image"].astype(float) + (1 - k) * b["image"], a["image"]), "labels": k * np.asarray(a["labels"]) + (1 - k) * np.asarray(b["labels"])}

    return f


def cut_mix(alpha: float = 1.0) -> Callable[[Sample, Sample, np.random.Generator], Sample]:
    """A patch of b in a; labels by the area that was really replaced."""

    def f(a: Sample, b: Sample, rng: np.random.Generator) -> Sample:
        K.same_size(a["image"], b["image"])
        h, w = a["image"].shape[:2]
        side = math.sqrt(1 - rng.beta(alpha, alpha))
        cy, cx = int(rng.integers(h)), int(rng.integers(w))
        y0, y1 = (int(np.clip(cy + d * round(h * side) / 2, 0, h)) for d in (-1, 1))
        x0, x1 = (int(np.clip(cx + d * round(w * side) / 2, 0, w)) for d in (-1, 1))
        image = a["image"].copy()
        image[y0:y1, x0:x1] = b["image"][y0:y1, x0:x1]
        k = 1 - (y1 - y0) * (x1 - x0) / (h * w)
        return {**a, "image": image, "labels": k * np.asarray(a["labels"]) + (1 - k) * np.asarray(b["labels"])}

    return f


def mix_compose(steps: list) -> Callable[[Sample, Sample, np.random.Generator], Sample]:
    """Pair steps in a row, always with the same second sample."""

    def f(a: Sample, b: Sample, rng: np.random.Generator) -> Sample:
        for step in steps:
            a = step(a, b, rng)
        return a

    return f


def augment(df: DataFrame, step: Step, key: str, seed: int = 0, boxes: str | None = None, mask: str | None = None) -> DataFrame:
    """df with its column image, and as given its boxes (array of structs with x, y, w, h) and mask, after the step."""
    box_type = df.schema[boxes].dataType if boxes else None
    made = "struct<image: struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary, fmt: string>"
    made += f", boxes: {box_type.simpleString()}" if boxes else ""
    made += ", mask: struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary, fmt: string>" if mask else ""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                s: Sample = {"image": decode(row["image"])}
                if boxes:
                    s["boxes"] = np.array([[b[c] for c in "xywh"] for b in row["boxes"]], float).reshape(-1, 4)
                if mask:
                    s["mask"] = decode(row["mask"])
                s = step(s, generator(int(row["key"]), seed))
                new = {"image": encode(s["image"], row["image"]["origin"])}
                if boxes:
                    kept = s.get("kept", np.arange(len(row["boxes"])))
                    new["boxes"] = [dict(row["boxes"][int(k)]) | dict(zip("xywh", map(float, b), strict=True)) for k, b in zip(kept, s["boxes"], strict=True)]
                if mask:
                    new["mask"] = encode(s["mask"])
                out.append(new)
            yield pd.DataFrame(out)

    parts = [F.col("image"), F.xxhash64(key).alias("key")] + ([F.col(boxes).alias("boxes")] if boxes else []) + ([F.col(mask).alias("mask")] if mask else [])
    done = df.withColumn("_a", F.pandas_udf(run, made + ">")(F.struct(*parts)))
    out = done.withColumn("image", F.col("_a.image"))
    out = out.withColumn(boxes, F.col("_a.boxes")) if boxes else out
    out = out.withColumn(mask, F.col("_a.mask")) if mask else out
    return out.drop("_a")


def flipped_boxes(x: Column, w: Column, width: Column) -> Column:
    return width - x - w


def cropped_box(x: Column, y: Column, w: Column, h: Column, cx: float, cy: float, cw: float, ch: float, share: float) -> Column:
    """A box in a crop's coordinates, clipped; null if under the share of its area is left."""
    x0, y0 = F.greatest(F.lit(0.0), x - cx), F.greatest(F.lit(0.0), y - cy)
    x1, y1 = F.least(F.lit(float(cw)), x + w - cx), F.least(F.lit(float(ch)), y + h - cy)
    area = F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)
    return F.when((area > 0) & (area >= share * w * h), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))

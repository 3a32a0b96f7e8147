"""Multi-object trackers and their evaluation.

A tracker is a state that is updated frame by frame. Batch: each source's frames in order, one source after the other in a task.
Streaming: the same state per source in Spark's state store (see streaming.trackers).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.errors import ParameterError, require
from lumaframe.operators.evaluation import iou_matrix
from lumaframe.operators.groups import Columns, per_group
from lumaframe.operators.matching import hungarian

OUT = "source_id string, frame long, track_id int, x double, y double, w double, h double, confidence double, age int, is_confirmed boolean"


@dataclass
class IouTracker:
    """Greedy by overlap: pairs over min_iou, the largest first; ties: least track, then least detection.

    A detection that nothing claims starts a track, confirmed at once. A track that is older than max_age frames
    since its last detection ends.
    """

    min_iou: float = 0.3
    max_age: int = 1
    next_id: int = 0
    tracks: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        require(0 <= self.min_iou <= 1 and self.max_age >= 0, "min_iou must be from 0 to 1, max_age 0 or more")

    def update(self, boxes: np.ndarray, confidence: np.ndarray) -> list[dict]:
        overlap = iou_matrix(np.array([t["box"] for t in self.tracks]).reshape(-1, 4), boxes)
        rows, cols = np.nonzero(overlap > self.min_iou)
        order = np.lexsort((cols, rows, -overlap[rows, cols]))
        taken: dict[int, int] = {}
        used: set[int] = set()
        for r, c in zip(rows[order].tolist(), cols[order].tolist(), strict=True):
            if r not in taken and c not in used:
                taken[r] = c
                used.add(c)
        for r, t in enumerate(self.tracks):
            if r in taken:
                t.update(box=boxes[taken[r]].tolist(), confidence=float(confidence[taken[r]]), age=0)
            else:
                t["age"] += 1
        self.tracks = [t for t in self.tracks if t["age"] <= self.max_age]
        for c in range(len(boxes)):
            if c not in used:
                self.tracks.append({"id": self.next_id, "box": boxes[c].tolist(), "confidence": float(confidence[c]), "age": 0})
                self.next_id += 1
        return [{**t, "confirmed": True} for t in self.tracks]


class Kalman:
    """State of a box: centre, area, aspect, and the speeds of the first three; only the covariance's scale matters."""

    MOVE = np.eye(7) + np.diag([1.0, 1, 1], 4)[:7, :7]
    SEE = np.eye(4, 7)
    STIR = np.diag([1, 1, 1, 1, 0.01, 0.01, 0.0001])
    BLUR = np.diag([1.0, 1, 10, 10])

    def __init__(self, box: list[float]):
        self.x = np.concatenate([measured(box), np.zeros(3)])
        self.p = np.diag([10.0, 10, 10, 10, 10000, 10000, 10000])

    def predict(self) -> None:
        if self.x[2] + self.x[6] <= 0:
            self.x[6] = 0
        self.x = self.MOVE @ self.x
        self.p = self.MOVE @ self.p @ self.MOVE.T + self.STIR

    def correct(self, box: list[float]) -> None:
        gain = self.p @ self.SEE.T @ np.linalg.inv(self.SEE @ self.p @ self.SEE.T + self.BLUR)
        self.x = self.x + gain @ (measured(box) - self.SEE @ self.x)
        self.p = (np.eye(7) - gain @ self.SEE) @ self.p

    @property
    def box(self) -> list[float]:
        area, aspect = max(self.x[2], 0.0), max(self.x[3], 1e-6)
        w = float(np.sqrt(area * aspect))
        h = float(area / w) if w > 0 else 0.0
        return [float(self.x[0] - w / 2), float(self.x[1] - h / 2), w, h]


def measured(box: list[float]) -> np.ndarray:
    x, y, w, h = box
    return np.array([x + w / 2, y + h / 2, w * h, w / h if h > 0 else 0.0])


@dataclass
class SortTracker:
    """Kalman prediction, then the assignment of greatest overlap; pairs under iou_threshold don't match.

    A track is confirmed from min_hits detections in all, and reports confidence 0. New tracks have age 0 and are
    predicted before they are matched in the next frame.
    """

    max_age: int = 3
    min_hits: int = 3
    iou_threshold: float = 0.3
    next_id: int = 0
    tracks: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        require(self.max_age >= 0 and self.min_hits >= 0 and 0 <= self.iou_threshold <= 1, "max_age and min_hits must be 0 or more, the threshold from 0 to 1")

    def predict(self) -> None:
        for t in self.tracks:
            t["filter"].predict()
            t["box"] = t["filter"].box
            t["age"] += 1

    def assign(self, boxes: np.ndarray, threshold: float) -> dict[int, int]:
        overlap = iou_matrix(np.array([t["box"] for t in self.tracks]).reshape(-1, 4), boxes)
        return {r: c for r, c in hungarian(1 - overlap) if overlap[r, c] >= threshold} if overlap.size else {}

    def hit(self, t: dict, box: np.ndarray) -> None:
        t["filter"].correct(box.tolist())
        t.update(box=t["filter"].box, age=0, hits=t["hits"] + 1)

    def start(self, box: np.ndarray) -> None:
        self.tracks.append({"id": self.next_id, "filter": Kalman(box.tolist()), "box": box.tolist(), "age": 0, "hits": 1})
        self.next_id += 1

    def seen(self) -> list[dict]:
        self.tracks = [t for t in self.tracks if t["age"] <= self.max_age]
        return [{"id": t["id"], "box": t["box"], "confidence": 0.0, "age": t["age"], "confirmed": t["hits"] >= self.min_hits} for t in self.tracks]

    def update(self, boxes: np.ndarray, confidence: np.ndarray) -> list[dict]:
        self.predict()
        pairs = self.assign(boxes, self.iou_threshold)
        for r, c in pairs.items():
            self.hit(self.tracks[r], boxes[c])
        for c in sorted(set(range(len(boxes))) - set(pairs.values())):
            self.start(boxes[c])
        return self.seen()


@dataclass
class ByteTracker(SortTracker):
    """Two rounds: the assignment of sure detections at an overlap of 0.3, then, track by track, the unsure ones.

    In the second round no detection is marked as used, so that two tracks can claim one, and the filter isn't corrected:
    only the box shown moves. Detections under the low threshold are dropped; only sure ones start tracks.
    """

    high_conf_threshold: float = 0.6
    low_conf_threshold: float = 0.1

    def __post_init__(self):
        if hasattr(super(), "__post_init__"):
            super().__post_init__()
        require(0 <= self.low_conf_threshold < self.high_conf_threshold <= 1, "thresholds must be from 0 to 1, the low one under the high one")

    def update(self, boxes: np.ndarray, confidence: np.ndarray) -> list[dict]:
        self.predict()
        sure = boxes[confidence >= self.high_conf_threshold]
        unsure = boxes[(confidence >= self.low_conf_threshold) & (confidence < self.high_conf_threshold)]
        pairs = self.assign(sure, 0.3)
        for r, c in pairs.items():
            self.hit(self.tracks[r], sure[c])
        for r, t in enumerate(self.tracks):
            if r not in pairs and len(unsure):
                overlap = iou_matrix(np.array([t["box"]]), unsure)[0]
                if overlap.max() > 0.3:
                    t.update(box=unsure[int(overlap.argmax())].tolist(), age=0, hits=t["hits"] + 1)
        for c in sorted(set(range(len(sure))) - set(pairs.values())):
            self.start(sure[c])
        return self.seen()


TRACKERS = {"iou": IouTracker, "sort": SortTracker, "byte": ByteTracker}


def tracker_of(kind: str, options: dict):
    if kind not in TRACKERS:
        raise ParameterError(f"kind must be one of {', '.join(TRACKERS)}")
    return TRACKERS[kind](**options)


def rows_of(source: str, frame: int, tracks: list[dict]) -> list[tuple]:
    return [(source, int(frame), t["id"], *map(float, t["box"]), t["confidence"], t["age"], t["confirmed"]) for t in tracks]


def track(detections: DataFrame, kind: str, **options) -> DataFrame:
    """The tracks of every frame, from rows (source_id, frame, k, x, y, w, h, confidence); k orders a frame's detections.

    One shuffle, by source_id. Frames without rows don't exist: a frame without detections is a row of null x.
    """
    tracker_of(kind, options)

    def run(g: Columns) -> Columns:
        tracker, out = tracker_of(kind, options), []
        starts = np.flatnonzero(np.concatenate([[True], g["frame"][1:] != g["frame"][:-1], [True]]))
        boxes = np.stack([g[c] for c in "xywh"], axis=1).astype(float)
        for a, b in zip(starts, starts[1:], strict=False):
            here = boxes[a:b]
            real = ~np.isnan(here[:, 0])
            out += rows_of(g["source_id"][0], g["frame"][a], tracker.update(here[real], g["confidence"][a:b][real]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 10
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [object, np.int64, np.int32, *[float] * 5, np.int32, bool]
        return {n: np.array(c, dtype=k) for n, c, k in zip(names, columns, kinds, strict=True)}

    cols = [F.col("source_id").cast("string"), F.col("frame").cast("long"), F.col("k").cast("long"), *[F.col(c).cast("double") for c in ("x", "y", "w", "h", "confidence")]]
    return per_group(detections.select(*cols), ["source_id"], ["frame", "k"], run, OUT)


def frame_matches(tracks: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """source_id, frame, gt_id, track_id, iou: per frame, pairs by falling overlap over the threshold, each truth and track once."""
    require(0 <= threshold <= 1, "threshold must be from 0 to 1")

    def run(g: Columns) -> Columns:
        boxes = np.stack([g[c] for c in "xywh"], axis=1).astype(float)
        cut = int((g["kind"] == 0).sum())
        overlap, found = iou_matrix(boxes[:cut], boxes[cut:]), []
        order = np.argsort(-overlap, axis=None, kind="stable") if overlap.size else []
        rows, cols = set(), set()
        for at in order:
            r, c = divmod(int(at), overlap.shape[1])
            if overlap[r, c] <= threshold:
                break
            if r not in rows and c not in cols:
                rows.add(r), cols.add(c)
                found.append((g["id"][r], g["id"][cut + c], overlap[r, c]))
        n = len(found)
        return {"source_id": np.repeat(g["source_id"][:1], n), "frame": np.repeat(g["frame"][:1], n), "gt_id": np.array([f[0] for f in found], np.int64), "track_id": np.array([f[1] for f in found], np.int64), "iou": np.array([f[2] for f in found], float)}

    box = [F.col(c).cast("double") for c in "xywh"]
    one = lambda df, key, kind: df.select(F.col("source_id").cast("string"), F.col("frame").cast("long"), F.col(key).cast("long").alias("id"), *box, F.lit(kind).alias("kind"))
    both = one(truths, "gt_id", 0).unionByName(one(tracks, "track_id", 1))
    return per_group(both, ["source_id", "frame"], ["kind", "id"], run, "source_id string, frame long, gt_id long, track_id long, iou double")


def tracking_eval(tracks: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, id_switches, mota, motp, precision, recall, idf1.

    A switch is a match of a truth to another track than in its last match, however long ago. MOTA may be negative and is
    0 without truth. IDF1 assigns whole truth identities to whole tracks by their matches, within each source.
    """
    matches = frame_matches(tracks, truths, threshold)
    last = F.lag("track_id").over(Window.partitionBy("source_id", "gt_id").orderBy("frame"))
    per = matches.withColumn("_last", last).agg(F.count("*").alias("tp"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("_iou"), F.count_if(F.col("_last").isNotNull() & (F.col("_last") != F.col("track_id"))).alias("id_switches"))
    met = matches.groupBy("source_id", "gt_id", "track_id").agg(F.count("*").cast("long").alias("n"))

    def identities(g: Columns) -> Columns:
        gts, gi = np.unique(g["gt_id"], return_inverse=True)
        ids, ti = np.unique(g["track_id"], return_inverse=True)
        n = np.zeros((len(gts), len(ids)))
        n[gi, ti] = g["n"]
        return {"idtp": np.array([int(sum(n[r, c] for r, c in hungarian(n.max() - n)))], np.int64)}

    idtp = per_group(met, ["source_id"], ["gt_id", "track_id"], identities, "idtp long").agg(F.coalesce(F.sum("idtp"), F.lit(0)).alias("_idtp"))
    nt, ng = tracks.agg(F.count("*").alias("_nt")), truths.agg(F.count("*").alias("_ng"))
    one = per.join(F.broadcast(idtp)).join(F.broadcast(nt)).join(F.broadcast(ng))  # single rows
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b.cast("double"), F.lit(0.0)))
    c = F.col
    fp, fn = c("_nt") - c("tp"), c("_ng") - c("tp")
    return one.select("tp", fp.alias("fp"), fn.alias("fn"), "id_switches", F.when(c("_ng") == 0, 0.0).otherwise(1 - (fn + fp + c("id_switches")) / F.nullif(c("_ng").cast("double"), F.lit(0.0))).alias("mota"), safe(c("_iou"), c("tp")).alias("motp"), safe(c("tp"), c("_nt")).alias("precision"), safe(c("tp"), c("_ng")).alias("recall"), safe(2 * c("_idtp"), c("_nt") + c("_ng")).alias("idf1"))

"""Evaluation of classifiers, detectors, segmentation and ranking, as grouped aggregates.

Confusion counts are partial aggregates: what streams in as updates in other engines is one groupBy here, and merging is
Spark's. Only the matching of detections is sequential; it runs frame by frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.errors import require
from lumaframe.operators.groups import Columns, per_group
from lumaframe.operators.running import running_sums

VOID = 255
THRESHOLDS = tuple((50 + 5 * k) / 100 for k in range(10))


def ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def accuracy(df: DataFrame) -> DataFrame:
    """Share of rows (pred, gt) that agree; 0 for none."""
    return df.agg(F.coalesce(F.avg((F.col("pred") == F.col("gt")).cast("double")), F.lit(0.0)).alias("accuracy"))


def scores_of(df: DataFrame, cls: int) -> DataFrame:
    """precision, recall and f1 of one class."""
    hit = F.coalesce(F.count_if((F.col("pred") == cls) & (F.col("gt") == cls)), F.lit(0))
    p, r = ratio(hit, F.count_if(F.col("pred") == cls)), ratio(hit, F.count_if(F.col("gt") == cls))
    return df.agg(p.alias("precision"), r.alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("gt", "pred").agg(F.count("*").alias("n"))


def class_eval(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """cls, name, precision, recall, f1, support of every class that is predicted or true.

    Built on the confusion counts, whose size is the square of the number of classes, not of the rows.
    """
    counts = confusion(df)
    sides = counts.select(F.col("gt").alias("cls"), "n", F.lit(0).alias("p"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(counts.select(F.col("pred").alias("cls"), F.lit(0).alias("n"), F.col("n").alias("p"), F.lit(0).alias("hit")))
    per = sides.groupBy("cls").agg(F.sum("n").alias("support"), F.sum("p").alias("_p"), F.sum("hit").alias("_h"))
    name = F.col("cls").cast("string")
    if names:
        name = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.col("cls").cast("int")), name)
    per = per.select("cls", name.alias("name"), ratio(F.col("_h"), F.col("_p")).alias("precision"), ratio(F.col("_h"), F.col("support")).alias("recall"), "support")
    return per.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def seg_eval(df: DataFrame, classes: int) -> DataFrame:
    """cls, iou, dice of every class with any hit or error, from pixel rows (pred, gt).

    Void truth (255) and truth outside the classes is skipped; a prediction outside them misses its truth but is no
    false alarm of any class.
    """
    require(classes > 0, "classes must be over 0")
    counts = df.where((F.col("gt") != VOID) & (F.col("gt") < classes)).groupBy("gt", "pred").agg(F.count("*").alias("n"))
    same = F.col("gt") == F.col("pred")
    sides = counts.select(F.col("gt").alias("cls"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(~same, F.col("n")).otherwise(0).alias("fn"))
    sides = sides.unionByName(counts.where(~same & (F.col("pred") < classes)).select(F.col("pred").alias("cls"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn")))
    per = sides.groupBy("cls").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return per.select("cls", ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("dice"))


def mean_iou(df: DataFrame, classes: int) -> DataFrame:
    return seg_eval(df, classes).agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("miou"), F.coalesce(F.avg("dice"), F.lit(0.0)).alias("mdice"))


def pr_curves(matches: DataFrame, truths: DataFrame, order: list[Column], by: tuple[str, ...] = ("cls",), on: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Running recall and precision, from matches (by, tp 0/1) in the given order and truths (on, n).

    Running sums by partitions, so one large group isn't one task; groups without truth have no curve.
    """
    curve = running_sums(matches.join(truths.where("n > 0"), list(on)), order, {"hits": F.col("tp").cast("long"), "rank": F.lit(1).cast("long")}, by)
    return curve.select(*by, "rank", ratio(F.col("hits"), F.col("n")).alias("recall"), ratio(F.col("hits"), F.col("rank")).alias("precision"))


def average_precision(curve: DataFrame, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Mean over recall levels 0.00, 0.01 .. 1.00 of the greatest precision at that recall or more.

    A point serves the levels up to its own, so per group the greatest precision of each level reached is taken, then
    the running greatest from above: 101 values a group at most, whatever the curve's length.
    """
    level = F.floor(F.col("recall") * 100 + 1e-9).cast("int")
    exact = F.when(level / 100.0 > F.col("recall"), level - 1).otherwise(level)
    best = curve.groupBy(*by, exact.alias("_level")).agg(F.max("precision").alias("p"))
    spread = best.groupBy(*by).agg(F.collect_list(F.struct("_level", "p")).alias("points"))
    levels = F.sequence(F.lit(0), F.lit(100))
    at = F.transform(levels, lambda t: F.coalesce(F.array_max(F.transform(F.filter("points", lambda q: q["_level"] >= t), lambda q: q["p"])), F.lit(0.0)))
    return spread.select(*by, (F.aggregate(at, F.lit(0.0), lambda s, v: s + v) / 101).alias("ap"))


def matched(g: Columns, thresholds: tuple[float, ...]) -> Columns:
    """Greedy matching in one frame: by falling confidence, each detection takes the free truth of its class with the
    greatest overlap if that is at least the threshold. Ties: least k. Rows: detections (kind 0) in this order, then truths.
    ``hits`` has a bit for each threshold."""
    cut = int((g["kind"] == 0).sum())
    boxes = np.stack([g[c] for c in "xywh"], axis=1)
    overlap = iou_matrix(boxes[:cut], boxes[cut:])
    overlap[g["cls"][:cut, None] != g["cls"][None, cut:]] = -1
    hits = np.zeros(cut, np.int64)
    if overlap.size:
        for t, level in enumerate(thresholds):
            free = overlap.copy()
            for i in range(cut):
                j = int(free[i].argmax())
                if free[i, j] >= level:
                    hits[i] |= 1 << t
                    free[:, j] = -1
    return {c: g[c][:cut] for c in ("frame", "k", "cls", "conf")} | {"hits": hits}


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of boxes (x, y, w, h), all with all of one frame."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    shared = np.clip(high - low, 0, None).prod(2)
    union = a[:, 2:].prod(1)[:, None] + b[:, 2:].prod(1)[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def detection_hits(dets: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """frame, k, cls, conf, hits of every detection: bit t is set if it is a hit at threshold t (62 at most). One shuffle, by frame."""
    require(0 < len(thresholds) <= 62, "1 to 62 thresholds")
    cols = ["frame", "k", "x", "y", "w", "h", "cls", "conf", "kind"]
    both = dets.withColumn("kind", F.lit(0)).select(*cols).unionByName(truths.withColumns({"kind": F.lit(1), "conf": F.lit(0)}).select(*cols))
    both = both.select("frame", F.col("k").cast("long"), *[F.col(c).cast("double") for c in "xywh"], F.col("cls").cast("string"), F.col("conf").cast("double"), "kind")
    both = both.withColumn("_o", -F.col("conf"))
    return per_group(both, ["frame"], ["kind", "_o", "k"], lambda g: matched(g, thresholds), "frame long, k long, cls string, conf double, hits long")


def detection_matches(dets: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """frame, k, cls, conf, level, tp of every detection at every threshold."""
    rows = detection_hits(dets, truths, thresholds).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))))
    return rows.select("frame", "k", "cls", "conf", "level", F.getbit("hits", F.col("level")).cast("int").alias("tp"))


def detection_eval(dets: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """cls, level, ap: every class of truths or detections; one that is only predicted has 0."""
    hits = detection_hits(dets, truths, thresholds)
    counts = truths.groupBy(F.col("cls").cast("string").alias("cls")).agg(F.count("*").alias("n"))
    levels = range(len(thresholds))
    sums = {f"_h{t}": F.shiftright("hits", t).bitwiseAND(1) for t in levels} | {"rank": F.lit(1).cast("long")}
    run = running_sums(hits.join(counts.where("n > 0"), "cls"), [F.col("conf").desc(), "frame", "k"], sums, ("cls",))  # all thresholds in one row
    curve = run.select("cls", "rank", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("level"), F.col(f"_h{t}").alias("hits")) for t in levels])).alias("_l"))
    curve = curve.select("cls", "_l.level", ratio(F.col("_l.hits"), F.col("n")).alias("recall"), ratio(F.col("_l.hits"), F.col("rank")).alias("precision"))
    found = average_precision(curve, ("cls", "level"))
    classes = counts.select("cls").union(dets.select(F.col("cls").cast("string"))).distinct()
    spine = classes.select("cls", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))).alias("level"))
    return spine.join(found, ["cls", "level"], "left").select("cls", "level", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_ap(evaluated: DataFrame) -> DataFrame:
    """map50 and map50_95 over all classes."""
    return evaluated.agg(F.coalesce(F.avg(F.when(F.col("level") == 0, F.col("ap"))), F.lit(0.0)).alias("map50"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map50_95"))


def roc(df: DataFrame) -> DataFrame:
    """threshold, fpr, tpr from rows (score, y 0/1), a point for each distinct score, all scores at least it."""
    per = df.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    sums = per.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    run = running_sums(per, [F.col("score").desc()], {"cp": F.col("p"), "cn": F.col("n")})
    return run.join(F.broadcast(sums)).select(F.col("score").alias("threshold"), ratio(F.col("cn"), F.col("tn")).alias("fpr"), ratio(F.col("cp"), F.col("tp")).alias("tpr"))


def auc(df: DataFrame) -> DataFrame:
    """Area under the curve of rows (score, y): the share of (positive, negative) pairs in right order, ties half.

    Equal to the trapezoid sum; from the counts of each distinct score and their running sum by range partitions.
    """
    per = df.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    up = running_sums(per, ["score"], {"cn": F.col("n")})
    return up.withColumn("won", F.col("p") * (F.col("cn") - F.col("n") / 2)).agg(ratio(F.sum("won"), F.sum("p") * F.sum("n")).alias("auc"))

"""Queries of the aggregates, evaluation and matching operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import distance
from lumaframe.operators import aggregates as A
from lumaframe.operators import evaluation as E
from lumaframe.operators import matching as M
from lumaframe.plans.inputs import BOX, IM, PR, boxes, images, pairs, rows, table
from lumaframe.plans.vision_sql import EVALUATED, MEAN_AP, SUPPRESSED

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def px(spark: SparkSession, sf: str) -> DataFrame:
    """img_id, y, x, v."""
    return rows(images(spark, sf), F.col("px")).select("img_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


@query(f"WITH {IM} SELECT img_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev FROM im GROUP BY img_id")
def mean_std_dev(spark, sf):
    return six(A.mean_std_dev(px(spark, sf)), "mean", "stddev")


@query(f"""WITH {IM}, r AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY v, i) AS lo, row_number() OVER (PARTITION BY img_id ORDER BY v DESC, i) AS hi FROM im)
SELECT l.img_id, l.v AS min_v, l.y AS min_y, l.x AS min_x, h.v AS max_v, h.y AS max_y, h.x AS max_x FROM r l JOIN r h USING (img_id) WHERE l.lo = 1 AND h.hi = 1""")
def min_max_loc(spark, sf):
    return A.min_max_loc(px(spark, sf))


@query(f"WITH {IM} SELECT img_id, sum(CASE WHEN v > 128 THEN 1 ELSE 0 END)::BIGINT AS n FROM im GROUP BY img_id")
def count_non_zero(spark, sf):
    return A.count_non_zero(px(spark, sf).withColumn("v", F.when(F.col("v") > 128, F.col("v")).otherwise(0)))


@query(f"WITH {IM} SELECT img_id, x AS at, sum(v)::BIGINT AS v FROM im GROUP BY ALL")
def reduce_sum(spark, sf):
    return A.reduce(px(spark, sf), 0, "sum")


@query(f"WITH {IM} SELECT img_id, y AS at, max(v) AS v FROM im GROUP BY ALL")
def reduce_max(spark, sf):
    return A.reduce(px(spark, sf), 1, "max")


@query(f"""WITH {IM}, b AS (SELECT img_id, CAST(t // 9 AS INT) AS y, CAST(t % 9 AS INT) AS x FROM (SELECT DISTINCT img_id FROM im), range(81) r(t))
SELECT b.img_id, b.y, b.x, coalesce(sum(p.v), 0)::BIGINT AS s, coalesce(sum(p.v * p.v), 0)::BIGINT AS sq FROM b LEFT JOIN im p ON p.img_id = b.img_id AND p.y < b.y AND p.x < b.x GROUP BY ALL""")
def integral_image(spark, sf):
    return A.integral_image(px(spark, sf), squares=True)


@query(f"""WITH {IM}, m AS (SELECT img_id, sum(v)::DOUBLE AS m00, sum(x * v)::DOUBLE AS m10, sum(y * v)::DOUBLE AS m01, sum(x * y * v)::DOUBLE AS m11, sum(x * x * v)::DOUBLE AS m20, sum(y * y * v)::DOUBLE AS m02 FROM im GROUP BY img_id)
SELECT img_id, m00, m10, m01, m11, m20, m02, round((m20 - m10 / m00 * m10) / m00 / m00, 6) AS nu20, round((m02 - m01 / m00 * m01) / m00 / m00, 6) AS nu02, round((m20 - m10 / m00 * m10) / m00 / m00 + (m02 - m01 / m00 * m01) / m00 / m00, 6) AS hu1 FROM m""")
def moments(spark, sf):
    return six(A.moments(px(spark, sf)).select("img_id", "m00", "m10", "m01", "m11", "m20", "m02", "nu20", "nu02", "hu1"), "nu20", "nu02", "hu1")


@query(f"WITH {IM}, s AS (SELECT img_id, CAST(b AS INT) AS bin FROM (SELECT DISTINCT img_id FROM im), range(16) r(b)) SELECT s.img_id, s.bin, count(p.v) AS n FROM s LEFT JOIN im p ON p.img_id = s.img_id AND p.v >= 32 AND p.v < 224 AND floor((p.v - 32) * 16 / 192.0) = s.bin GROUP BY ALL")
def calc_hist(spark, sf):
    return A.histogram(px(spark, sf), 16, 32, 224)


def _hists(spark, sf):
    count = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter(c, lambda v: F.floor(v / 32) == b)).cast("double"))
    return pairs(spark, sf).select("img_id", count(F.col("a")).alias("a"), count(F.col("b")).alias("b"))


_HI = f"WITH {PR}, s AS (SELECT img_id, CAST(k AS INT) AS k FROM (SELECT DISTINCT img_id FROM pr), range(8) r(k)), h AS (SELECT s.img_id, s.k, sum(CASE WHEN pr.a // 32 = k THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN pr.b // 32 = k THEN 1 ELSE 0 END)::DOUBLE AS q FROM s JOIN pr USING (img_id) GROUP BY ALL)"


@query(f"{_HI} SELECT img_id, round(coalesce(corr(p, q), 1), 6) AS correl, sum(least(p, q)) AS intersect, round(sum(CASE WHEN p = 0 THEN 0 ELSE (p - q) * (p - q) / p END), 6) AS chisqr, round(sqrt(greatest(0, 1 - sum(sqrt(p * q)) / sqrt(sum(p) * sum(q)))), 6) AS bhatt FROM h GROUP BY img_id")
def compare_hist(spark, sf):
    h, of = _hists(spark, sf), lambda m: F.round(distance.compare_hist(F.col("a"), F.col("b"), m), 6) + F.lit(0.0)
    return h.select("img_id", of("correl").alias("correl"), of("intersect").alias("intersect"), of("chisqr").alias("chisqr"), of("bhattacharyya").alias("bhatt"))


@query(f"""WITH {IM}, c AS (SELECT img_id, v, count(*) AS n FROM im GROUP BY ALL), r AS (SELECT img_id, v, sum(n) OVER (PARTITION BY img_id ORDER BY v) AS run FROM c)
SELECT p.img_id, p.y, p.x, CASE WHEN f.first = 64 THEN p.v ELSE CAST(round_even((r.run - f.first) * 255.0::DOUBLE / (64 - f.first), 0) AS INT) END AS v FROM im p JOIN r ON r.img_id = p.img_id AND r.v = p.v JOIN (SELECT img_id, min(run) AS first FROM r GROUP BY img_id) f ON f.img_id = p.img_id""")
def histogram_equalization(spark, sf):
    return A.histogram_equalization(px(spark, sf))


@query(f"WITH {PR} SELECT img_id, round(avg((a - b) * (a - b)), 6) AS mse FROM pr GROUP BY img_id")
def mse(spark, sf):
    a = px(spark, sf)
    return six(A.mse(a, a.withColumn("img_id", F.col("img_id") - 1)), "mse")


@query(f"WITH {PR} SELECT img_id, round(10 * log10(255.0 * 255.0 / avg((a - b) * (a - b))), 6) AS psnr FROM pr GROUP BY img_id")
def psnr(spark, sf):
    a = px(spark, sf)
    return six(A.psnr(a, a.withColumn("img_id", F.col("img_id") - 1)), "psnr")


@query(f"WITH {IM}, b AS (SELECT img_id, y // 2 AS yb, x // 2 AS xb, sum(v) AS s, count(*) AS n FROM im GROUP BY ALL) SELECT img_id, CAST(yb AS INT) AS yb, CAST(xb AS INT) AS xb, CASE WHEN s * sum(n) OVER (PARTITION BY img_id) > sum(s) OVER (PARTITION BY img_id) * n THEN 1 ELSE 0 END AS bit FROM b")
def block_mean_hash(spark, sf):
    return A.block_mean_hash(px(spark, sf), 2).withColumnsRenamed({"by": "yb", "bx": "xb"})


@query(f"WITH {IM}, l AS (SELECT img_id, v // 64 AS label, y, x FROM im) SELECT img_id, CAST(label AS INT) AS label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM l WHERE label > 0 GROUP BY img_id, label")
def component_map(spark, sf):
    return six(A.component_map(px(spark, sf).select("img_id", F.floor(F.col("v") / 64).cast("int").alias("label"), "y", "x")), "cx", "cy")


@query(f"{_HI.replace('WITH', 'WITH', 1)}, s2 AS (SELECT img_id, sum(least(p, q)) / 64 AS s FROM h GROUP BY img_id), b AS (SELECT CAST(k AS INT) AS bin FROM range(10) r(k)) SELECT b.bin, count(s2.s) AS n, round((SELECT avg(s) FROM s2), 6) AS mean, round((SELECT avg(CASE WHEN s > 0.5 THEN 1.0 ELSE 0.0 END) FROM s2), 6) AS share FROM b LEFT JOIN s2 ON least(9, floor(s2.s * 10)) = b.bin GROUP BY b.bin")
def iou_histogram(spark, sf):
    s = _hists(spark, sf).select((distance.compare_hist(F.col("a"), F.col("b"), "intersect") / 64).alias("s"))
    return six(A.bins_of(s, F.col("s"), 10, 0.5), "mean", "share")


def _classes(spark, sf):
    return table(spark, sf, "labels").select(F.col("toxic").cast("int").alias("pred"), F.col("quality").cast("int").alias("gt"))


@query("SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM labels")
def accuracy(spark, sf):
    return E.accuracy(_classes(spark, sf))


@query("WITH c AS (SELECT sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END)::DOUBLE AS h, sum(toxic)::DOUBLE AS p, sum(quality)::DOUBLE AS g FROM labels) SELECT round(h / p, 6) AS precision, round(h / g, 6) AS recall, round(2 * (h / p) * (h / g) / (h / p + h / g), 6) AS f1 FROM c")
def precision_recall_f1(spark, sf):
    return six(E.scores_of(_classes(spark, sf), 1), "precision", "recall", "f1")


@query("SELECT CAST(quality AS INT) AS gt, CAST(toxic AS INT) AS pred, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark, sf):
    return E.confusion(_classes(spark, sf))


_LINE = "SELECT CAST(l_partkey % 6 AS INT) AS gt, CAST(l_suppkey % 7 AS INT) AS pred FROM lineitem"


@query(f"WITH l AS ({_LINE}), c AS (SELECT CAST(k AS INT) AS cls FROM range(7) r(k)), s AS (SELECT cls, (SELECT count(*) FROM l WHERE gt = cls)::BIGINT AS support, (SELECT count(*) FROM l WHERE pred = cls) AS p, (SELECT count(*) FROM l WHERE pred = cls AND gt = cls) AS h FROM c), r AS (SELECT cls, support, CASE WHEN p = 0 THEN 0 ELSE h::DOUBLE / p END AS precision, CASE WHEN support = 0 THEN 0 ELSE h::DOUBLE / support END AS recall FROM s) SELECT cls, CASE WHEN cls < 3 THEN ['cat', 'dog', 'bird'][cls + 1] ELSE cls::VARCHAR END AS name, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r")
def class_eval(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_partkey") % 6).cast("int").alias("gt"), (F.col("l_suppkey") % 7).cast("int").alias("pred"))
    return six(E.class_eval(df, ["cat", "dog", "bird"]), "precision", "recall", "f1")


_SEG = "SELECT CASE WHEN l_partkey % 9 = 8 THEN 255 ELSE l_partkey % 9 END AS gt, l_suppkey % 8 AS pred FROM lineitem"


def _masks(spark, sf):
    gt = F.col("l_partkey") % 9
    return table(spark, sf, "lineitem").select(F.when(gt == 8, 255).otherwise(gt).cast("int").alias("gt"), (F.col("l_suppkey") % 8).cast("int").alias("pred"))


_SEGC = f"WITH l AS (SELECT * FROM ({_SEG}) WHERE gt <> 255 AND gt < 7), c AS (SELECT CAST(k AS INT) AS cls FROM range(7) r(k)), s AS (SELECT cls, (SELECT count(*) FROM l WHERE gt = cls AND pred = cls)::DOUBLE AS tp, (SELECT count(*) FROM l WHERE gt <> cls AND pred = cls) AS fp, (SELECT count(*) FROM l WHERE gt = cls AND pred <> cls) AS fn FROM c)"


@query(f"{_SEGC} SELECT cls, round(tp / (tp + fp + fn), 6) AS iou, round(2 * tp / (2 * tp + fp + fn), 6) AS dice FROM s WHERE tp + fp + fn > 0")
def seg_eval(spark, sf):
    return six(E.seg_eval(_masks(spark, sf), 7), "iou", "dice")


@query(f"{_SEGC} SELECT round(avg(tp / (tp + fp + fn)), 6) AS miou, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS mdice FROM s WHERE tp + fp + fn > 0")
def mean_iou(spark, sf):
    return six(E.mean_iou(_masks(spark, sf), 7), "miou", "mdice")


_RANK = "SELECT d.doc_id, l.toxic AS tp, d.n_chars, d.lang AS cls FROM labels l JOIN documents d USING (doc_id)"


def _ranked(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", F.col("toxic").alias("tp"), "n_chars", F.col("lang").alias("cls"))


_CURVE = f"WITH m AS ({_RANK}), t AS (SELECT cls, sum(tp) AS n FROM m GROUP BY cls), cv AS (SELECT m.cls, count(*) OVER w AS rank, sum(tp) OVER w::DOUBLE / t.n AS recall, sum(tp) OVER w::DOUBLE / count(*) OVER w AS precision FROM m JOIN t USING (cls) WHERE t.n > 0 WINDOW w AS (PARTITION BY m.cls ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))"


def _curve(spark, sf):
    r = _ranked(spark, sf)
    return E.pr_curves(r, r.groupBy("cls").agg(F.sum("tp").alias("n")), [F.col("n_chars").desc(), "doc_id"])


@query(f"{_CURVE} SELECT cls, rank, round(recall, 6) AS recall, round(precision, 6) AS precision FROM cv")
def pr_curves(spark, sf):
    return six(_curve(spark, sf), "recall", "precision")


@query(f"{_CURVE}, lv AS (SELECT k / 100.0::DOUBLE AS t FROM range(101) r(k)), b AS (SELECT c.cls, lv.t, coalesce(max(cv.precision), 0) AS p FROM (SELECT DISTINCT cls FROM cv) c CROSS JOIN lv LEFT JOIN cv ON cv.cls = c.cls AND cv.recall >= lv.t GROUP BY ALL) SELECT cls, round(sum(p) / 101, 6) AS ap FROM b GROUP BY cls")
def average_precision(spark, sf):
    return six(E.average_precision(_curve(spark, sf)), "ap")


@query("WITH r AS (SELECT d.n_chars AS score, l.toxic AS y FROM labels l JOIN documents d USING (doc_id)), t AS (SELECT DISTINCT score FROM r) SELECT t.score AS threshold, round((SELECT count(*) FROM r WHERE r.score >= t.score AND y = 0)::DOUBLE / (SELECT count(*) FROM r WHERE y = 0), 6) AS fpr, round((SELECT count(*) FROM r WHERE r.score >= t.score AND y = 1)::DOUBLE / (SELECT count(*) FROM r WHERE y = 1), 6) AS tpr FROM t")
def roc_curve(spark, sf):
    return six(E.roc(_ranked(spark, sf).select(F.col("n_chars").alias("score"), F.col("tp").alias("y"))), "fpr", "tpr")


@query("WITH r AS (SELECT d.n_chars AS score, l.toxic AS y FROM labels l JOIN documents d USING (doc_id)) SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM r p, r n WHERE p.y = 1 AND n.y = 0")
def roc_auc(spark, sf):
    return six(E.auc(_ranked(spark, sf).select(F.col("n_chars").alias("score"), F.col("tp").alias("y"))), "auc")


def _detections(spark, sf):
    b = boxes(spark, sf).withColumn("k", F.row_number().over(M.per("frame").orderBy("x", "y", "w", "h", "cls", "conf")).cast("bigint"))
    truths = b.select("frame", "k", (F.col("x") + F.col("k") % 3).alias("x"), "y", "w", "h", "cls")
    return b, truths


@query(EVALUATED)
def detection_eval(spark, sf):
    return six(E.detection_eval(*_detections(spark, sf)), "ap")


@query(MEAN_AP)
def mean_average_precision(spark, sf):
    return six(E.mean_ap(E.detection_eval(*_detections(spark, sf))), "map50", "map50_95")


_AH = f"{IM}, mn AS (SELECT img_id, avg(v) AS m FROM im GROUP BY img_id), hs AS (SELECT im.img_id, im.label, sum(CASE WHEN v > m THEN (CAST(1 AS UBIGINT) << i) ELSE 0 END)::UBIGINT AS h FROM im JOIN mn USING (img_id) GROUP BY ALL)"


def _hashes(spark, sf):
    return images(spark, sf).select("img_id", "label", distance.average_hash(F.col("px")).alias("h"))


@query(f"WITH {_AH} SELECT img_id, CASE WHEN h >= 9223372036854775808 THEN CAST(h::HUGEINT - 18446744073709551616 AS BIGINT) ELSE h::BIGINT END AS h FROM hs")
def average_hash(spark, sf):
    return _hashes(spark, sf).select("img_id", "h")


@query(f"WITH {_AH} SELECT least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b, count(*) AS n, CAST(sum(bit_count(xor(a.h, b.h))) AS BIGINT) AS d FROM hs a JOIN hs b ON a.img_id < b.img_id WHERE bit_count(xor(a.h, b.h)) <= 10 GROUP BY ALL")
def average_hash_pairs(spark, sf):
    """Pairs of images with near hashes, counted by their labels: near pairs of distinct hashes, and the images of each by label."""
    of = _hashes(spark, sf).groupBy("h", "label").agg(F.count("*").alias("n"))
    near = M.hamming_pairs(of.select(F.col("h").alias("id"), "h").distinct(), "id", "h", 10)
    side = lambda c: of.select(F.col("h").alias(c), F.col("label").alias(f"l{c}"), F.col("n").alias(f"n{c}"))
    apart = near.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.col("na") * F.col("nb"))
    alike = side("a").join(side("b"), (F.col("a") == F.col("b")) & (F.col("la") <= F.col("lb"))).withColumns({"d": F.lit(0), "n": F.when(F.col("la") == F.col("lb"), F.floor(F.col("na") * (F.col("na") - 1) / 2)).otherwise(F.col("na") * F.col("nb"))})
    both = apart.select("la", "lb", "n", "d").unionByName(alike.where("n > 0").select("la", "lb", "n", "d"))
    return both.groupBy(F.least("la", "lb").alias("label_a"), F.greatest("la", "lb").alias("label_b")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("d"))


@query(f"WITH {PR}, mn AS (SELECT img_id, avg(a) AS ma, avg(b) AS mb FROM pr GROUP BY img_id) SELECT pr.img_id, CAST(sum(CASE WHEN (a > ma) <> (b > mb) THEN 1 ELSE 0 END) AS INT) AS d FROM pr JOIN mn USING (img_id) GROUP BY pr.img_id")
def hamming_distance(spark, sf):
    return pairs(spark, sf).select("img_id", distance.hamming(distance.average_hash(F.col("a")), distance.average_hash(F.col("b"))).alias("d"))


@query(f"WITH {PR} SELECT img_id, round(sqrt(sum((a - b) * (a - b))), 6) AS d FROM pr GROUP BY img_id")
def l2_hash_distance(spark, sf):
    return six(pairs(spark, sf).select("img_id", distance.l2(F.col("a"), F.col("b")).alias("d")), "d")


@query(f"WITH {PR} SELECT img_id, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS s FROM pr GROUP BY img_id")
def cosine_similarity(spark, sf):
    return six(pairs(spark, sf).select("img_id", distance.cosine(F.col("a"), F.col("b")).alias("s")), "s")


#: Queries are the images whose id 50 divides, against all the others.
_D = f"{IM}, d AS (SELECT q.img_id AS q, t.img_id AS t, sum((q.v - t.v) * (q.v - t.v)) AS d2 FROM im q JOIN im t ON t.i = q.i AND t.img_id <> q.img_id WHERE q.img_id % 50 = 0 GROUP BY ALL)"


def _sets(spark, sf):
    v = images(spark, sf).select(F.col("img_id").alias("id"), F.col("px").alias("vec"))
    return v.where("id % 50 = 0"), v


@query(f"WITH {_D}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS k FROM d) SELECT q, t, round(sqrt(d2), 6) AS d FROM r WHERE k = 1")
def match_bf(spark, sf):
    return six(M.match_bf(*_sets(spark, sf), but_itself=True), "d")


@query(f"WITH {_D}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS k, row_number() OVER (PARTITION BY t ORDER BY d2, q) AS b FROM d) SELECT q, t, round(sqrt(d2), 6) AS d FROM r WHERE k = 1 AND b = 1 AND sqrt(d2) <= 400")
def match_bf_cross_check(spark, sf):
    return six(M.match_bf(*_sets(spark, sf), cross_check=True, max_distance=400, but_itself=True), "d")


@query(f"WITH {_D}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS k, lead(d2) OVER (PARTITION BY q ORDER BY d2, t) AS n2 FROM d) SELECT q, t, round(sqrt(d2), 6) AS d FROM r WHERE k = 1 AND n2 IS NOT NULL AND sqrt(d2) < 0.9 * sqrt(n2)")
def match_flann(spark, sf):
    return six(M.match_ratio(*_sets(spark, sf), ratio=0.9, but_itself=True), "d")


@query(f"WITH {BOX}, nb AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x, y, w, h, cls, conf) AS k FROM bx) SELECT a.frame, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS by, a.w AS aw, b.w AS bw, a.h AS ah, b.h AS bh, a.cls AS acls, b.cls AS bcls, a.conf AS aconf, b.conf AS bconf, round(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))::DOUBLE / (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))), 6) AS iou FROM nb a JOIN nb b USING (frame) WHERE a.k < b.k AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)")
def iou_pairs(spark, sf):
    b, _ = _detections(spark, sf)
    names = ("x", "y", "w", "h", "cls", "conf", "k")
    a, c = (b.select("frame", *[F.col(n).alias(s + n) for n in names]) for s in "ab")
    met = a.join(c, "frame").where("ak < bk").drop("ak", "bk")
    iou = distance.iou(*[F.col(s + n) for s in "ab" for n in ("x", "y", "w", "h")])
    return six(met.withColumn("iou", iou).where("iou > 0"), "iou")


@query(SUPPRESSED)
def non_maximum_suppression(spark, sf):
    return M.nms(boxes(spark, sf), ["frame"], [F.col("conf").desc(), "x", "y", "w", "h", "cls"], 0.3)

"""Queries of the point-wise operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaframe.functions import pixel
from lumaframe.plans.inputs import IM, PR, images, pairs, rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SAT = "CAST(least(255, greatest(0, round_even({}, 0))) AS INT)"
TABLE = [(i * 7 + 3) % 256 for i in range(256)]


def unary(name: str, op, sql: str, where: str = "") -> None:
    QUERIES[name] = lambda spark, sf: rows(images(spark, sf), op(F.col("px")))
    ORACLE[name] = f"WITH {IM} SELECT img_id, i, {sql} AS v FROM im {where}"


def binary(name: str, op, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: rows(pairs(spark, sf), op(F.col("a"), F.col("b")))
    ORACLE[name] = f"WITH {PR} SELECT img_id, i, {sql} AS v FROM pr"


def rounded(column):
    """Six decimals, without negative zeros."""
    return F.transform(column, lambda v: F.round(v, 6) + F.lit(0.0))


binary("add", pixel.add, "least(255, a + b)")
binary("subtract", pixel.subtract, "greatest(0, a - b)")
binary("multiply", lambda a, b: pixel.multiply(a, b, 0.01), SAT.format("CAST(a AS DOUBLE) * b * 0.01::DOUBLE"))
binary("divide", lambda a, b: pixel.divide(a, b, 100.0), f"CASE WHEN b = 0 THEN 0 ELSE {SAT.format('CAST(a AS DOUBLE) * 100.0::DOUBLE / b')} END")
binary("abs_diff", pixel.abs_diff, "abs(a - b)")
binary("bitwise_and", pixel.bitwise_and, "a & b")
binary("bitwise_or", pixel.bitwise_or, "a | b")
unary("bitwise_not", pixel.bitwise_not, "255 - v")
unary("invert", pixel.invert, "255 - v")
unary("brightness", lambda p: pixel.brightness(p, 40.5), SAT.format("v + 40.5::DOUBLE"))
unary("contrast", lambda p: pixel.contrast(p, 1.7), SAT.format("v * 1.7::DOUBLE"))
unary("convert_scale_abs", lambda p: pixel.convert_scale_abs(p, -1.3, 20.0), SAT.format("abs(v * (-1.3)::DOUBLE + 20.0::DOUBLE)"))
unary("lut", lambda p: pixel.lut(p, TABLE), "(v * 7 + 3) % 256")
unary("gamma_correction", lambda p: pixel.gamma(p, 2.2), "CAST(round_even(255 * pow(v / 255.0::DOUBLE, 2.2::DOUBLE), 0) AS INT)")
unary("gamma_correction_float", lambda p: rounded(pixel.gamma_float(pixel.to_float(p), 0.5)), "round(least(1, greatest(0, pow(v / 255.0::DOUBLE, 0.5::DOUBLE))), 6)")
for _mode, _above, _below in (("binary", "255", "0"), ("binary_inv", "0", "255"), ("trunc", "120", "v"), ("to_zero", "v", "0"), ("to_zero_inv", "0", "v")):
    unary(f"threshold_{_mode}", lambda p, m=_mode: pixel.threshold(p, 120, 255, m), f"CASE WHEN v > 120 THEN {_above} ELSE {_below} END")
unary("to_float32", lambda p: rounded(pixel.to_float(p)), "round(v / 255.0::DOUBLE, 6)")
unary("from_float32", lambda p: pixel.to_bytes(pixel.to_float(p)), "v")
unary("standardize", lambda p: rounded(pixel.standardize(p, 127.5, 64.0)), "round((v - 127.5::DOUBLE) / 64.0::DOUBLE, 6)")
unary("random_solarize", lambda p: pixel.solarize(p, 128), "CASE WHEN v >= 128 THEN 255 - v ELSE v END")
unary("random_posterize", lambda p: pixel.posterize(p, 3), "v & 224")
binary("apply_mask", lambda a, b: pixel.apply_mask(a, pixel.threshold(b, 127)), "CASE WHEN b > 127 THEN a ELSE 0 END")
binary("weighted_blend", lambda a, b: pixel.weighted_blend(a, b, 0.3), SAT.format("a * 0.3::DOUBLE + b * (1 - 0.3::DOUBLE)"))
binary("alpha_blend", lambda a, b: pixel.alpha_blend(a, pixel.invert(a), b), SAT.format("a * (1 - b / 255.0::DOUBLE) + (255 - a) * (b / 255.0::DOUBLE)"))
binary("in_range", lambda a, b: pixel.in_range([a, b], [64, 100], [192, 160]), "CASE WHEN a BETWEEN 64 AND 192 AND b BETWEEN 100 AND 160 THEN 255 ELSE 0 END")
binary("to_gray", lambda a, b: pixel.to_gray(a, b, pixel.invert(a)), SAT.format("a * 0.114::DOUBLE + b * 0.587::DOUBLE + (255 - a) * 0.299::DOUBLE"))
binary("merge_channels", lambda a, b: pixel.interleave(a, b, pixel.invert(a)), "0")
ORACLE["merge_channels"] = f"WITH {PR} SELECT img_id, i * 3 + k AS i, CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE 255 - a END AS v FROM pr, (VALUES (0), (1), (2)) c(k)"
binary("split_channels", lambda a, b: pixel.channel(pixel.interleave(a, b, pixel.invert(a)), 1, 3), "b")

_OTSU = f"""WITH {IM}, lv AS (SELECT DISTINCT img_id, v AS level FROM im), st AS (SELECT l.img_id, l.level, sum(CASE WHEN p.v <= l.level THEN 1 ELSE 0 END)::DOUBLE AS n0, sum(CASE WHEN p.v <= l.level THEN p.v ELSE 0 END)::DOUBLE AS s0, count(*)::DOUBLE AS n, sum(p.v)::DOUBLE AS s
 FROM lv l JOIN im p ON p.img_id = l.img_id GROUP BY ALL), sc AS (SELECT img_id, level, CASE WHEN n0 = 0 OR n = n0 THEN 0 ELSE pow((n - n0) * s0 - n0 * (s - s0), 2) / (n0 * (n - n0)) END AS f FROM st),
 best AS (SELECT img_id, level FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY f DESC, level) AS r FROM sc) WHERE r = 1)"""
QUERIES["threshold_otsu"] = lambda spark, sf: rows(images(spark, sf), pixel.threshold(F.col("px"), 0, 255, "otsu"))
ORACLE["threshold_otsu"] = f"{_OTSU} SELECT p.img_id, p.i, CASE WHEN p.v > b.level THEN 255 ELSE 0 END AS v FROM im p JOIN best b USING (img_id)"

_RANGE = "(max(v) OVER (PARTITION BY img_id) - min(v) OVER (PARTITION BY img_id))::DOUBLE"
unary("normalize", lambda p: rounded(pixel.normalize(p)), f"CASE WHEN {_RANGE} < 1e-10 THEN 0 ELSE round((v - min(v) OVER (PARTITION BY img_id)) / {_RANGE}, 6) END")
unary("normalize_to", lambda p: rounded(pixel.normalize_to(p, -1.0, 3.0)), f"CASE WHEN {_RANGE} < 1e-10 THEN 0 ELSE round(-1 + (v - min(v) OVER (PARTITION BY img_id)) * 4.0::DOUBLE / {_RANGE}, 6) END")


def moved(name: str, op, size: int, width: int, sql: str, value: str = "v") -> None:
    """Operators that move pixels: sql gives the source (y, x) of the target's (ty, tx), null for the fill value 9."""
    QUERIES[name] = lambda spark, sf: rows(images(spark, sf), op(F.col("px")))
    ORACLE[name] = f"WITH {IM}, ids AS (SELECT DISTINCT img_id FROM im), tg AS (SELECT img_id, CAST(t AS INT) AS i, CAST(t // {width} AS INT) AS ty, CAST(t % {width} AS INT) AS tx FROM ids, range({size}) r(t)), src AS (SELECT img_id, i, {sql} FROM tg) SELECT s.img_id, s.i, coalesce(p.v, 9) AS v FROM src s LEFT JOIN im p ON p.img_id = s.img_id AND p.y = s.sy AND p.x = s.sx"


moved("crop", lambda p: pixel.crop(p, 8, 1, 2, 5, 4), 20, 5, "ty + 2 AS sy, tx + 1 AS sx")
moved("center_crop", lambda p: pixel.center_crop(p, 8, 8, 5, 3), 15, 5, "ty + 2 AS sy, tx + 1 AS sx")
moved("flip_horizontal", lambda p: pixel.flip(p, 8, 8, "horizontal"), 64, 8, "ty AS sy, 7 - tx AS sx")
moved("flip_vertical", lambda p: pixel.flip(p, 8, 8, "vertical"), 64, 8, "7 - ty AS sy, tx AS sx")
moved("flip_both", lambda p: pixel.flip(p, 8, 8, "both"), 64, 8, "7 - ty AS sy, 7 - tx AS sx")
moved("pad_constant", lambda p: pixel.pad(p, 8, 8, 1, 2, 3, 0, "constant", 9), 121, 11, "CASE WHEN ty - 1 BETWEEN 0 AND 7 AND tx - 3 BETWEEN 0 AND 7 THEN ty - 1 END AS sy, tx - 3 AS sx")
moved("pad_replicate", lambda p: pixel.pad(p, 8, 8, 1, 2, 3, 0, "replicate"), 121, 11, "greatest(0, least(7, ty - 1)) AS sy, greatest(0, least(7, tx - 3)) AS sx")
moved("pad_reflect", lambda p: pixel.pad(p, 8, 8, 1, 2, 3, 0, "reflect"), 121, 11, "CASE WHEN ty - 1 > 7 THEN 14 - (ty - 1) ELSE abs(ty - 1) END AS sy, abs(tx - 3) AS sx")
moved("pad_to_square", lambda p: pixel.pad_to_square(pixel.crop(p, 8, 0, 0, 8, 5), 8, 5, "constant", 9), 64, 8, "CASE WHEN ty - 1 BETWEEN 0 AND 4 THEN ty - 1 END AS sy, tx AS sx")

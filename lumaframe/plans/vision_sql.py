"""SQL of operators that need a recursion, or constants of their own."""

from __future__ import annotations

import numpy as np

from lumaframe.operators.evaluation import THRESHOLDS
from lumaframe.operators.kernels import WHITE, XYZ
from lumaframe.plans.inputs import BOX, IM, PV
from lumaframe.plans.kernel_sql import _BGR, BYTE, G5, MIRROR, _three, around, bilinear, offsets, scaled, values

_NEXT = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) n(dy, dx)"
_MIRROR16 = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 15 THEN 30 - ({0}) ELSE {0} END"
_UP = [(dy, dx, float(4 * G5[dy + 2, dx + 2])) for dy, dx in offsets(5)]
_TILT = np.linalg.inv(np.array([[1, 0.1, 0], [0, 1, 0], [0.01, 0, 1]]))
_at = lambda row: " + ".join(f"{float(c)!r}::DOUBLE * {t}" for c, t in zip(row, ("tx", "ty", "1"), strict=True))

#: By query, of those that round to six decimals.
STEPS: dict[str, str] = {
    "connected_components": f"""WITH RECURSIVE {IM}, f AS (SELECT img_id, y, x, i FROM im WHERE v > 128), r(img_id, i, y, x, j) AS (SELECT img_id, i, y, x, i FROM f UNION SELECT r.img_id, f.i, f.y, f.x, r.j FROM r CROSS JOIN {_NEXT} JOIN f ON f.img_id = r.img_id AND f.y = r.y + n.dy AND f.x = r.x + n.dx WHERE r.j <= f.i),
 m AS (SELECT img_id, i, min(j) AS j FROM r GROUP BY img_id, i), l AS (SELECT img_id, i, dense_rank() OVER (PARTITION BY img_id ORDER BY j) AS l FROM m) SELECT im.img_id, im.i, coalesce(l.l, 0)::DOUBLE AS v FROM im LEFT JOIN l ON l.img_id = im.img_id AND l.i = im.i""",
    "flood_fill": f"""WITH RECURSIVE {IM}, r(img_id, i, y, x, v) AS (SELECT img_id, i, y, x, v FROM im WHERE i = 0 UNION SELECT r.img_id, f.i, f.y, f.x, f.v FROM r CROSS JOIN {_NEXT} JOIN im f ON f.img_id = r.img_id AND f.y = r.y + n.dy AND f.x = r.x + n.dx AND f.v BETWEEN r.v - 20 AND r.v + 20)
 SELECT im.img_id, im.i, CASE WHEN r.i IS NULL THEN im.v ELSE 7 END::DOUBLE AS v FROM im LEFT JOIN r ON r.img_id = im.img_id AND r.i = im.i""",
    "pyr_up": f"""WITH {PV}, o(dy, dx, k) AS (VALUES {values(_UP)}), t AS (SELECT img_id, px, CAST(t AS INT) AS i, {_MIRROR16.format('(t // 16 + dy)')} AS y, {_MIRROR16.format('(t % 16 + dx)')} AS x, k FROM pv, range(256) r(t), o)
 SELECT img_id, i, {BYTE.format('sum(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN k * px[y // 2 * 8 + x // 2 + 1] ELSE 0 END)')} AS v FROM t GROUP BY img_id, i""",
    "warp_perspective": f"WITH {PV}, {bilinear(8, 8, f'({_at(_TILT[0])}) / ({_at(_TILT[2])})', f'({_at(_TILT[1])}) / ({_at(_TILT[2])})', True)} SELECT img_id, i, v FROM s",
    "harris_corner": "WITH "
    + IM
    + ", "
    + around("im", "gx", values([(dy, dx, float(dx * (2 - abs(dy)))) for dy, dx in offsets(3)]), "o.k, ", "sum(k * v) / 2040.0::DOUBLE")
    + ", "
    + around("im", "gy", values([(dy, dx, float(dy * (2 - abs(dx)))) for dy, dx in offsets(3)]), "o.k, ", "sum(k * v) / 2040.0::DOUBLE")
    + ", "
    + ", ".join(
        f"q{n} AS (SELECT a.img_id, a.y, a.x, a.i, a.v * b.v AS v FROM {a} a JOIN {b} b ON a.img_id = b.img_id AND a.i = b.i), " + around(f"q{n}", n, "(-1, -1), (-1, 0), (0, -1), (0, 0)", "", "sum(v)")
        for n, a, b in (("xx", "gx", "gx"), ("xy", "gx", "gy"), ("yy", "gy", "gy"))
    )
    + ", h AS (SELECT a.img_id, a.i, a.v * c.v - b.v * b.v - 0.04::DOUBLE * (a.v + c.v) ** 2 AS r FROM xx a JOIN xy b ON a.img_id = b.img_id AND a.i = b.i JOIN yy c ON a.img_id = c.img_id AND a.i = c.i), e AS (SELECT img_id, min(r) AS low, max(r) AS high FROM h GROUP BY img_id)"
    + f" SELECT h.img_id, h.i, CASE WHEN high > low THEN {BYTE.format('(r - low) * 255 / (high - low)')} ELSE 0 END AS v FROM h JOIN e ON h.img_id = e.img_id",
}

_LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {0} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({0} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_CURVE = "CASE WHEN {0} > 0.008856::DOUBLE THEN cbrt({0}) ELSE 7.787::DOUBLE * {0} + 16 / 116.0::DOUBLE END"
_dot = lambda row, names: "(" + " + ".join(f"{float(c)!r}::DOUBLE * {n}" for c, n in zip(row, names, strict=True)) + ")"
_LAB = f"""{_BGR}, n AS (SELECT img_id, i, {_LINEAR.format('r')} AS r, {_LINEAR.format('g')} AS g, {_LINEAR.format('b')} AS b FROM c), t AS (SELECT img_id, i, {', '.join(f"{_dot(XYZ[k], 'rgb')} / {float(WHITE[k])!r}::DOUBLE AS t{k}" for k in range(3))} FROM n),
 lab AS (SELECT img_id, i, {BYTE.format("CASE WHEN t1 > 0.008856::DOUBLE THEN 116 * cbrt(t1) - 16 ELSE 903.3::DOUBLE * t1 END * 255 / 100")} AS l, {BYTE.format(f"500 * ({_CURVE.format('t0')} - {_CURVE.format('t1')}) + 128")} AS a, {BYTE.format(f"200 * ({_CURVE.format('t1')} - {_CURVE.format('t2')}) + 128")} AS b FROM t)"""
_SOLID = "CASE WHEN {0} > 0.206893::DOUBLE THEN {0} * {0} * {0} ELSE ({0} - 16 / 116.0::DOUBLE) / 7.787::DOUBLE END"
_GAMMA = "CASE WHEN {0} <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * {0} ELSE 1.055::DOUBLE * pow({0}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END"
_INVERSE = np.linalg.inv(XYZ)
_FROM_LAB = f"""{_LAB}, u AS (SELECT *, l * 100 / 255.0::DOUBLE AS h FROM lab), f AS (SELECT img_id, i, a, b, CASE WHEN h > 7.9996::DOUBLE THEN (h + 16) / 116 ELSE h / 903.3::DOUBLE * 7.787::DOUBLE + 16 / 116.0::DOUBLE END AS fy FROM u),
 w AS (SELECT img_id, i, fy + (a - 128) / 500 AS fx, fy, fy - (b - 128) / 200 AS fz FROM f), s AS (SELECT img_id, i, {', '.join(f"({_SOLID.format(n)}) * {float(WHITE[k])!r}::DOUBLE AS s{k}" for k, n in enumerate(("fx", "fy", "fz")))} FROM w),
 g AS (SELECT img_id, i, {', '.join(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_dot(_INVERSE[k], ('s0', 's1', 's2'))})) AS c{k}" for k in range(3))} FROM s)"""

#: By query, of those that give all numbers of a result, rounded to four decimals.
VISION: dict[str, str] = {
    "to_lab": f"WITH {_LAB} {_three('lab', 'l', 'a', 'b')}",
    "to_bgr_from_lab": f"WITH {_FROM_LAB} " + _three("g", *[BYTE.format(f"({_GAMMA.format(c)}) * 255") for c in ("c2", "c1", "c0")]),
    "segment_argmax": f"""WITH {PV}, t AS (SELECT img_id, px, CAST(t AS INT) AS i, CAST(t // 12 * 8 // 12 AS INT) AS y, CAST(t % 12 * 8 // 12 AS INT) AS x FROM pv, range(144) r(t)), c AS (SELECT img_id, i, px[y * 8 + x + 1] AS a, px[x * 8 + y + 1] AS b, px[(7 - y) * 8 + x + 1] AS c FROM t)
 SELECT img_id, i, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END::DOUBLE AS v FROM c""",
}


def overlap(a: str, b: str) -> str:
    shared = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"({shared}::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {shared}))"


SUPPRESSED = f"""WITH RECURSIVE {BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, x, y, w, h, cls) AS r FROM bx), g AS (SELECT frame, list({{'x': x, 'y': y, 'w': w, 'h': h, 'cls': cls, 'conf': conf}} ORDER BY r) AS b FROM o GROUP BY frame),
 n(frame, b, k, kept) AS (SELECT frame, b, 1, [b[1]] FROM g UNION ALL SELECT frame, b, k + 1, CASE WHEN len(list_filter(kept, lambda q: {overlap('q', 'b[k + 1]')} > 0.3::DOUBLE)) > 0 THEN kept ELSE list_append(kept, b[k + 1]) END FROM n WHERE k < len(b)),
 u AS (SELECT frame, unnest(kept) AS q FROM n WHERE k = len(b)) SELECT frame, CAST(q.x AS INT) AS x, CAST(q.y AS INT) AS y, CAST(q.w AS INT) AS w, CAST(q.h AS INT) AS h, q.cls AS cls, q.conf AS conf FROM u"""

#: Detections are the boxes, truths the same moved by k % 3; c: the truths that may go with a detection, best first.
_EVALUATED = f"""WITH RECURSIVE {BOX}, dt AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x, y, w, h, cls, conf) AS k FROM bx), gt AS (SELECT frame, k, x + k % 3 AS x, y, w, h, cls FROM dt),
 ov AS (SELECT a.frame, a.k, b.k AS t, {overlap('a', 'b')} AS o FROM dt a JOIN gt b ON a.frame = b.frame AND a.cls = b.cls), c AS (SELECT frame, k, list({{'t': t, 'o': o}} ORDER BY o DESC, t) AS c FROM ov WHERE o >= 0.5::DOUBLE GROUP BY frame, k),
 q AS (SELECT dt.frame, list({{'k': dt.k, 'c': coalesce(c.c, [])}} ORDER BY dt.conf DESC, dt.k) AS d FROM dt LEFT JOIN c ON c.frame = dt.frame AND c.k = dt.k GROUP BY dt.frame),
 lv(level, least) AS (VALUES {values([(i, float(t)) for i, t in enumerate(THRESHOLDS)])}),
 m(frame, level, least, d, n, used, hit) AS (SELECT frame, level, least::DOUBLE, d, 0, [CAST(-1 AS BIGINT)], CAST(-1 AS BIGINT) FROM q, lv UNION ALL
  SELECT frame, level, least, d, n + 1, list_append(used, h), h FROM (SELECT *, coalesce(list_filter(d[n + 1].c, lambda z: z.o >= least AND NOT list_contains(used, z.t))[1].t, -1) AS h FROM m WHERE n < len(d)) z),
 tp AS (SELECT frame, level, d[n].k AS k, CASE WHEN hit >= 0 THEN 1 ELSE 0 END AS tp FROM m WHERE n > 0),
 tt AS (SELECT cls, count(*) AS total FROM gt GROUP BY cls), rk AS (SELECT dt.cls, tp.level, tp.tp, sum(tp.tp) OVER w AS hits, count(*) OVER w AS rank FROM tp JOIN dt ON dt.frame = tp.frame AND dt.k = tp.k WINDOW w AS (PARTITION BY dt.cls, tp.level ORDER BY dt.conf DESC, dt.frame, dt.k ROWS UNBOUNDED PRECEDING)),
 cu AS (SELECT rk.cls, rk.level, hits::DOUBLE / total AS recall, hits::DOUBLE / rank AS precision FROM rk JOIN tt ON tt.cls = rk.cls), lb AS (SELECT cls, level, CAST(floor(recall * 100 + 1e-9::DOUBLE) AS INT) AS f, recall, precision FROM cu),
 le AS (SELECT cls, level, CASE WHEN f / 100.0::DOUBLE > recall THEN f - 1 ELSE f END AS f, max(precision) AS p FROM lb GROUP BY ALL),
 pts AS (SELECT s.cls, s.level, r.t, coalesce(max(le.p), 0) AS p FROM (SELECT DISTINCT cls, level FROM le) s CROSS JOIN range(101) r(t) LEFT JOIN le ON le.cls = s.cls AND le.level = s.level AND le.f >= r.t GROUP BY ALL),
 ap AS (SELECT cls, level, sum(p) / 101 AS ap FROM pts GROUP BY cls, level)"""
EVALUATED = f"{_EVALUATED} SELECT CAST(cls AS VARCHAR) AS cls, CAST(level AS INT) AS level, round(ap, 6) AS ap FROM ap"
MEAN_AP = f"{_EVALUATED} SELECT round(avg(CASE WHEN level = 0 THEN ap END), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM ap"

_C16 = f"{PV}, {scaled(16, 16)}, p16 AS (SELECT img_id, list(v ORDER BY i) AS q FROM s GROUP BY img_id), c16 AS (SELECT img_id, CAST(t AS INT) AS i, CAST(t // 16 AS INT) AS y, CAST(t % 16 AS INT) AS x, q[t + 1] AS b, q[t % 16 * 16 + t // 16 + 1] AS g, 255 - q[t + 1] AS r FROM p16, range(256) r(t))"
_T = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - 1) * 11 + (y - 1) * 8) / 185.0::DOUBLE))"


def _painted(share: str) -> list[str]:
    """Green over the three channels, by its share of each pixel."""
    return [f"round_even({c} + ({share}) * ({k} - {c}), 0)" for c, k in (("b", 0), ("g", 255), ("r", 0))]


_ON_LINE = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - sqrt((x - 1 - {_T} * 11) ** 2 + (y - 1 - {_T} * 8) ** 2)))"
_ON_CIRCLE = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - abs(sqrt((x - 8) ** 2.0 + (y - 8) ** 2.0) - 5)))"
_ON_FRAME = "CASE WHEN x BETWEEN 2 AND 10 AND y BETWEEN 3 AND 10 AND (x IN (2, 10) OR y IN (3, 10)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_RAY = "(SELECT img_id, px, CAST(t AS INT) AS i, (t % 8 - 4) / 8.0::DOUBLE AS x, (t // 8 - 4) / 8.0::DOUBLE AS y FROM pv, range(64) r(t))"


def _mapped(bend: str) -> str:
    """Both coordinates of a map: first all of x, then all of y."""
    rays = f"m AS (SELECT *, {bend} AS k FROM (SELECT *, sqrt(x * x + y * y) AS d FROM {_RAY}))"
    return f"WITH {PV}, {rays} SELECT img_id, i, round(x * k * 8 + 4, 4) AS v FROM m UNION ALL SELECT img_id, i + 64, round(y * k * 8 + 4, 4) FROM m"


_PIECE = "CASE WHEN gy < 8 AND gx < 8 THEN px[gy * 8 + gx + 1] WHEN gy < 8 AND gx > 9 THEN px[(gx - 10) * 8 + gy + 1] WHEN gy > 9 AND gx < 8 THEN 255 - px[(gy - 10) * 8 + gx + 1] ELSE 0 END"
VISION |= {
    "draw_line": f"WITH {_C16} {_three('c16', *_painted(_ON_LINE))}",
    "draw_circle": f"WITH {_C16} {_three('c16', *_painted(_ON_CIRCLE))}",
    "draw_rectangle": f"WITH {_C16} {_three('c16', *_painted(_ON_FRAME))}",
    "montage": f"WITH {PV}, t AS (SELECT img_id, px, t, t // 3 // 18 AS gy, t // 3 % 18 AS gx FROM pv, range(972) r(t)) SELECT img_id, CAST(t AS INT) AS i, ({_PIECE})::DOUBLE AS v FROM t",
    "top_k_classes": f"WITH {IM}, k AS (SELECT img_id, x, v, row_number() OVER (PARTITION BY img_id ORDER BY v DESC, x) - 1 AS r FROM im WHERE y = 0) SELECT img_id, CAST(2 * r + e AS INT) AS i, CASE e WHEN 0 THEN x::DOUBLE ELSE round(v / 255.0::DOUBLE, 4) END AS v FROM k, range(2) s(e) WHERE r < 3",
    "instance_masks": f"WITH {PV} SELECT img_id, CAST(t AS INT) AS i, CASE WHEN 1 / (1 + exp(-((px[t + 1] / 128.0::DOUBLE - 1) + 0.5::DOUBLE * (px[t + 33] / 128.0::DOUBLE - 1)))) >= 0.5::DOUBLE THEN 1 ELSE 0 END::DOUBLE AS v FROM pv, range(32) r(t)",
    "undistort_map": _mapped("1 + d * d * (px[1] / 2550.0::DOUBLE) + d * d * d * d * 0.01::DOUBLE"),
    "fisheye_init_rectify_map": _mapped("CASE WHEN d > 1e-12::DOUBLE THEN atan(d) * (1 + atan(d) * atan(d) * (px[1] / 2550.0::DOUBLE)) / d ELSE 1 END"),
}

_LINES = "ln AS (SELECT k, r, CAST(least(63, greatest(0, round_even(31.5::DOUBLE + (r - 31) * cos(pi() * k / 40), 0))) AS INT) AS x, CAST(least(63, greatest(0, round_even(31.5::DOUBLE + (r - 31) * sin(pi() * k / 40), 0))) AS INT) AS y FROM range(40) a(k), range(63) b(r))"
_COSINES = "cs AS (SELECT u, n, cos(pi() * (2 * n + 1) * u / 64) * CASE WHEN u = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END AS c FROM range(8) a(u), range(32) b(n))"
#: By query, of those that give a list of numbers as they are.
HASHES: dict[str, str] = {
    "radial_variance_hash": f"WITH {PV}, {scaled(64, 64)}, p64 AS (SELECT img_id, list(v ORDER BY i) AS q FROM s GROUP BY img_id), {_LINES} SELECT img_id, CAST(k AS INT) AS i, round(var_pop(q[y * 64 + x + 1]), 6) AS v FROM p64, ln GROUP BY img_id, k",
    "p_hash": f"""WITH {PV}, {scaled(32, 32)}, {_COSINES}, h AS (SELECT s.img_id, s.i // 32 AS y, cs.u, sum(cs.c * s.v) AS v FROM s JOIN cs ON cs.n = s.i % 32 GROUP BY ALL), d AS (SELECT h.img_id, cs.u * 8 + h.u - 1 AS k, sum(cs.c * h.v) AS v FROM h JOIN cs ON cs.n = h.y GROUP BY ALL),
 m AS (SELECT img_id, avg(v) AS m FROM d WHERE k >= 0 GROUP BY img_id) SELECT d.img_id, 0 AS i, CAST(sum(CASE WHEN d.v > m.m THEN CAST(1 AS BIGINT) << k ELSE 0 END) AS BIGINT) AS v FROM d JOIN m USING (img_id) WHERE k >= 0 GROUP BY d.img_id""",
}


def _bent(bend: str) -> str:
    """Samples of the image at the bent places of its pixels; outside it stands 0."""
    x, y = "((tx - 4) / 8.0::DOUBLE)", "((ty - 4) / 8.0::DOUBLE)"
    k = bend.format(f"sqrt({x} * {x} + {y} * {y})")
    return f"WITH {PV}, {bilinear(8, 8, f'{x} * ({k}) * 8 + 4', f'{y} * ({k}) * 8 + 4', True)} SELECT img_id, i, v FROM s"


_POSE = """v AS (SELECT img_id, [x / 255.0::DOUBLE FOR x IN px] AS v FROM pv), a AS (SELECT img_id, v[1] * 0.4::DOUBLE - 0.2::DOUBLE AS rx, v[2] * 0.4::DOUBLE - 0.2::DOUBLE AS ry, v[3] * 0.4::DOUBLE - 0.2::DOUBLE AS rz,
 v[4] * 0.1::DOUBLE - 0.1::DOUBLE AS tx, v[5] * 0.1::DOUBLE - 0.1::DOUBLE AS ty, 0.4::DOUBLE + v[6] * 0.2::DOUBLE AS tz FROM v), n AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS t FROM a),
 u AS (SELECT *, CASE WHEN t < 1e-12::DOUBLE THEN 0 ELSE rx / t END AS x, CASE WHEN t < 1e-12::DOUBLE THEN 0 ELSE ry / t END AS y, CASE WHEN t < 1e-12::DOUBLE THEN 0 ELSE rz / t END AS z FROM n)"""
#: A point turned about the axis (x, y, z) by t: p cos t + axis x p sin t + axis (axis . p)(1 - cos t); the board lies in the plane 0.
_TURNED = """b AS (SELECT CAST(k AS INT) AS k, k % 5 * 0.03::DOUBLE AS px, k // 5 * 0.03::DOUBLE AS py FROM range(20) r(k)),
 c AS (SELECT img_id, k, px * cos(t) - z * py * sin(t) + x * (x * px + y * py) * (1 - cos(t)) + tx AS cx, py * cos(t) + z * px * sin(t) + y * (x * px + y * py) * (1 - cos(t)) + ty AS cy, (x * py - y * px) * sin(t) + z * (x * px + y * py) * (1 - cos(t)) + tz AS cz FROM u, b),
 q AS (SELECT img_id, k, cx / cz AS x, cy / cz AS y, cx / cz * (cx / cz) + cy / cz * (cy / cz) AS r FROM c),
 d AS (SELECT img_id, k, x * (1 + r * (0.1::DOUBLE - r * 0.05::DOUBLE)) + 0.002::DOUBLE * x * y + 0.001::DOUBLE * (r + 2 * x * x) AS x, y * (1 + r * (0.1::DOUBLE - r * 0.05::DOUBLE)) + 0.001::DOUBLE * (r + 2 * y * y) + 0.002::DOUBLE * x * y AS y FROM q)"""
VISION |= {
    "undistort": _bent("1 + {0} * {0} * (0.1::DOUBLE + {0} * {0} * 0.01::DOUBLE)"),
    "fisheye_undistort": _bent("CASE WHEN {0} > 1e-12::DOUBLE THEN atan({0}) * (1 + atan({0}) * atan({0}) * (0.05::DOUBLE + atan({0}) * atan({0}) * 0.01::DOUBLE)) / {0} ELSE 1 END"),
    "project_points": f"WITH {PV}, {_POSE}, {_TURNED} SELECT img_id, 2 * k AS i, round(x * 500 + 320, 4) AS v FROM d UNION ALL SELECT img_id, 2 * k + 1, round(y * 510 + 240, 4) FROM d",
}
#: Means over 5 x 5 shifts, weighted by the mirrored 3 x 3 means of the squared differences.
STEPS["nl_means_denoising"] = f"""WITH {PV}, sh AS (SELECT a - 2 AS sy, b - 2 AS sx, a * 5 + b AS s FROM range(5) q(a), range(5) r(b)),
 df AS (SELECT pv.img_id, s, CAST(t AS INT) AS i, px[({MIRROR.format('(t // 8 + sy)')}) * 8 + ({MIRROR.format('(t % 8 + sx)')}) + 1] AS q, px[t + 1] AS v FROM pv, sh, range(64) g(t)),
 dl AS (SELECT img_id, s, list((q - v) * (q - v) ORDER BY i) AS d, list(q ORDER BY i) AS q FROM df GROUP BY img_id, s),
 nb AS (SELECT img_id, s, CAST(t AS INT) AS i, q[t + 1] AS q, d[({MIRROR.format('(t // 8 + dy)')}) * 8 + ({MIRROR.format('(t % 8 + dx)')}) + 1] AS d FROM dl, range(64) g(t), (VALUES {values(offsets(3))}) o(dy, dx)),
 w AS (SELECT img_id, s, i, any_value(q) AS q, exp(-avg(d) / 100) AS w FROM nb GROUP BY ALL) SELECT img_id, i, {BYTE.format('sum(w * q) / sum(w)')} AS v FROM w GROUP BY img_id, i"""

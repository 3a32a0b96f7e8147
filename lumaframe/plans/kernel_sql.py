"""SQL of kernels that work in several steps: a chain of small tables over the 8x8 images."""

from __future__ import annotations

import math

import numpy as np

from lumaframe.plans.inputs import IM, PV

MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
CLAMP = "least(7, greatest(0, {0}))"
BYTE = "CAST(least(255, greatest(0, round_even({}, 0))) AS DOUBLE)"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


def offsets(h: int, w: int | None = None) -> list[tuple[int, int]]:
    w = w or h
    return [(y - h // 2, x - w // 2) for y in range(h) for x in range(w)]


def around(source: str, name: str, table: str, columns: str, value: str, border: str | None = MIRROR, v: str = "v") -> str:
    """A step ``name``: an aggregate over each pixel's neighbours in ``source`` at the offsets of a VALUES table; border None leaves out what lies outside."""
    at = lambda c: f"(c.{c} + o.d{c})"
    px = f"p{name}"
    where = "" if border else f"WHERE {at('y')} BETWEEN 0 AND 7 AND {at('x')} BETWEEN 0 AND 7"
    place = f"({border.format(at('y'))}) * 8 + ({border.format(at('x'))}) + 1" if border else f"{at('y')} * 8 + {at('x')} + 1"
    inner = f"SELECT c.img_id, c.y, c.x, c.i, {columns} q.px[{place}] AS v FROM {source} c JOIN {px} q ON q.img_id = c.img_id CROSS JOIN o_{name} o {where}"
    names = columns.replace("o.", "")
    return f"{px} AS (SELECT img_id, list({v} ORDER BY i) AS px FROM {source} GROUP BY img_id), o_{name}(dy, dx{', ' + names.rstrip(', ') if names else ''}) AS (VALUES {table}), {name} AS (SELECT img_id, y, x, i, {value} AS v FROM ({inner}) n GROUP BY img_id, y, x, i)"


def extreme(source: str, name: str, k: int, f: str) -> str:
    return around(source, name, values(offsets(k)), "", f"{f}(v)", None)


def bilinear(columns: int, rows: int, sx: str, sy: str, inside: bool = False, fill: float = 0.0, extra: str = "") -> str:
    """A step ``s``: samples of a target grid at the source coordinates (sx, sy) of its (tx, ty); inside: outside the image stands ``fill``."""
    grid = f"g AS (SELECT img_id, px, CAST(t AS INT) AS i, {sx} AS sx, {sy} AS sy FROM (SELECT img_id, px, t, t % {columns} AS tx, t // {columns} AS ty FROM pv, range({columns * rows}) r(t)))"
    cell = f"f AS (SELECT *, CAST(floor(sx) AS INT) AS x0, CAST(floor(sy) AS INT) AS y0 FROM g)"

    def at(dy: int, dx: int) -> str:
        y, x = f"(y0 + {dy})", f"(x0 + {dx})"
        v = f"px[{CLAMP.format(y)} * 8 + {CLAMP.format(x)} + 1]"
        return f"CASE WHEN {y} BETWEEN 0 AND 7 AND {x} BETWEEN 0 AND 7 THEN {v} ELSE {fill} END" if inside else v

    mix = f"(({at(0, 0)}) * (1 - (sx - x0)) + ({at(0, 1)}) * (sx - x0)) * (1 - (sy - y0)) + (({at(1, 0)}) * (1 - (sx - x0)) + ({at(1, 1)}) * (sx - x0)) * (sy - y0)"
    return f"{grid}, {cell}, s AS (SELECT img_id, i, {BYTE.format(mix)} AS v FROM f)"


def scaled(columns: int, rows: int) -> str:
    """The half-pixel rule of resizing, clamped to the image."""
    axis = lambda t, n: f"least(7.0::DOUBLE, greatest(0.0::DOUBLE, ({t} + 0.5::DOUBLE) * 8 / {n} - 0.5::DOUBLE))"
    return bilinear(columns, rows, axis("tx", columns), axis("ty", rows))


def gauss(k: int, sigma: float) -> np.ndarray:
    g = np.array([math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)])
    g /= g.sum()
    return np.outer(g, g)


def weighted(w: np.ndarray) -> str:
    h = w.shape[0]
    return values([(y - h // 2, x - h // 2, float(w[y, x])) for y in range(h) for x in range(h)])


G5 = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1]) / 256
OUT = "SELECT img_id, i, v::DOUBLE AS v FROM {}"
BOTH = "SELECT a.img_id, a.i, ({})::DOUBLE AS v FROM im a JOIN {} b ON a.img_id = b.img_id AND a.i = b.i"
SOBEL = values([(dy, dx, float(dx * (2 - abs(dy))), float(dy * (2 - abs(dx)))) for dy, dx in offsets(3)])
GRADIENT = around("im", "d", SOBEL, "o.kx, o.ky, ", "{}")
OPENED = lambda k: f"{extreme('im', 'e', k, 'min')}, {extreme('e', 'd', k, 'max')}"
CLOSED = lambda k: f"{extreme('im', 'e', k, 'max')}, {extreme('e', 'd', k, 'min')}"

KERNELS: dict[str, str] = {
    "median_blur": f"WITH {IM}, {around('im', 'm', values(offsets(3)), '', 'list_sort(list(v))[5]', CLAMP)} {OUT.format('m')}",
    "sobel_edge": f"WITH {IM}, {GRADIENT.format('round_even(least(255, sqrt(sum(kx * v) ** 2 + sum(ky * v) ** 2)), 0)')} {OUT.format('d')}",
    "morph_open": f"WITH {IM}, {OPENED(3)} {OUT.format('d')}",
    "morph_close": f"WITH {IM}, {CLOSED(3)} {OUT.format('d')}",
    "top_hat": f"WITH {IM}, {OPENED(9)} {BOTH.format('a.v - b.v', 'd')}",
    "black_hat": f"WITH {IM}, {CLOSED(9)} {BOTH.format('b.v - a.v', 'd')}",
    "unsharp_mask": f"WITH {IM}, {around('im', 'd', weighted(gauss(5, 1.0)), 'o.k, ', BYTE.format('sum(k * v)'))} {BOTH.format('least(255, greatest(0, 2 * a.v - b.v))', 'd')}",
    "adaptive_threshold": f"WITH {IM}, {around('im', 'd', values(offsets(11)), '', BYTE.format('sum(v) / 121.0::DOUBLE'), CLAMP)} {BOTH.format('CASE WHEN a.v > b.v - 2 THEN 255 ELSE 0 END', 'd')}",
    "pyr_down": f"WITH {IM}, {around('im', 'd', weighted(G5), 'o.k, ', BYTE.format('sum(k * v)'))} SELECT img_id, CAST(y // 2 * 4 + x // 2 AS INT) AS i, v FROM d WHERE y % 2 = 0 AND x % 2 = 0",
    "resize": f"WITH {PV}, {scaled(12, 5)} {OUT.format('s')}",
    "letter_box": f"WITH {PV}, {scaled(9, 9)}, c AS (SELECT img_id, CAST(t AS INT) AS i, t % 12 - 1 AS tx, t // 12 AS ty FROM pv, range(108) r(t)) SELECT c.img_id, c.i, coalesce(s.v, 114)::DOUBLE AS v FROM c LEFT JOIN s ON s.img_id = c.img_id AND s.i = c.ty * 9 + c.tx AND c.tx BETWEEN 0 AND 8",
    "bilateral_filter": "WITH "
    + IM
    + ", "
    + around("im", "m", values([(y, x, float(x * x + y * y)) for y, x in offsets(9) if x * x + y * y <= 16]), "c.v AS c0, o.r2, ", "round_even(sum(exp(-r2 / 11250.0::DOUBLE - (v - c0) * (v - c0) / 11250.0::DOUBLE) * v) / sum(exp(-r2 / 11250.0::DOUBLE - (v - c0) * (v - c0) / 11250.0::DOUBLE)), 0)").replace("(dy, dx, c.v AS c0, r2)", "(dy, dx, r2)")
    + " "
    + OUT.format("m"),
}

_PAIR = f"{PV}, pr AS (SELECT p.img_id, CAST(r.i AS INT) AS i, CAST(r.i // 8 AS INT) AS y, CAST(r.i % 8 AS INT) AS x, p.px[r.i + 1]::DOUBLE AS a, q.px[r.i + 1]::DOUBLE AS b FROM pv p JOIN pv q ON q.img_id = p.img_id + 1, range(64) r(i)), pq AS (SELECT img_id, list(a ORDER BY i) AS pa, list(b ORDER BY i) AS pb FROM pr GROUP BY img_id)"


def _both(table: str, columns: str, sums: str) -> str:
    """Sums over the mirrored neighbourhoods of a pair of images: s has a row a pixel."""
    place = f"({MIRROR.format('(c.y + o.dy)')}) * 8 + ({MIRROR.format('(c.x + o.dx)')}) + 1"
    return f"WITH {_PAIR}, o(dy, dx, {columns}) AS (VALUES {table}), nb AS (SELECT c.img_id, c.i, o.*, q.pa[{place}] AS a, q.pb[{place}] AS b FROM pr c JOIN pq q ON q.img_id = c.img_id CROSS JOIN o), s AS (SELECT img_id, i, {sums} FROM nb GROUP BY img_id, i)"


KERNELS["ssim"] = (
    _both(weighted(gauss(11, 1.5)), "k", "sum(k * a) AS ma, sum(k * b) AS mb, sum(k * a * a) AS aa, sum(k * b * b) AS bb, sum(k * a * b) AS ab")
    + " SELECT img_id, round(avg(((2 * ma * mb + 6.5025::DOUBLE) * (2 * (ab - ma * mb) + 58.5225::DOUBLE)) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (aa - ma * ma + bb - mb * mb + 58.5225::DOUBLE))), 6) AS v FROM s GROUP BY img_id"
)
KERNELS["gmsd"] = (
    _both(values([(dy, dx, -dx / 3, -dy / 3) for dy, dx in offsets(3)]), "kx, ky", "sqrt(sum(kx * a) ** 2 + sum(ky * a) ** 2) AS ga, sqrt(sum(kx * b) ** 2 + sum(ky * b) ** 2) AS gb")
    + " SELECT img_id, round(stddev_pop((2 * ga * gb + 0.0026::DOUBLE) / (ga * ga + gb * gb + 0.0026::DOUBLE)), 6) AS v FROM s GROUP BY img_id"
)

#: The colour image of the queries: the image, its transpose and its inverse as blue, green and red.
_BGR = f"{PV}, c AS (SELECT m.img_id, m.i, m.v::DOUBLE AS b, w.px[m.x * 8 + m.y + 1]::DOUBLE AS g, (255 - m.v)::DOUBLE AS r FROM im m JOIN pv w USING (img_id))"
def _three(source: str, *channels: str) -> str:
    return " UNION ALL ".join(f"SELECT img_id, CAST(i * 3 + {k} AS INT) AS i, round(({e})::DOUBLE, 4) AS v FROM {source}" for k, e in enumerate(channels))


_LUMA = "b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE"
_HSV = f"""{_BGR}, m AS (SELECT *, greatest(b, g, r) AS hi, greatest(b, g, r) - least(b, g, r) AS d FROM c), t AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN (g - b) / d WHEN hi = g THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END * 30 AS t FROM m),
 hsv AS (SELECT img_id, i, round_even(CASE WHEN t < 0 THEN t + 180 ELSE t END, 0) % 180 AS h, CASE WHEN hi = 0 THEN 0 ELSE {BYTE.format("255 * d / hi")} END AS s, hi AS v FROM t)"""
_YCC = f"{_BGR}, l AS (SELECT *, {_LUMA} AS l FROM c), ycc AS (SELECT img_id, i, {BYTE.format('l')} AS y, {BYTE.format('(r - l) * 0.713::DOUBLE + 128')} AS cr, {BYTE.format('(b - l) * 0.564::DOUBLE + 128')} AS cb FROM l)"
_BACK = f"""{_HSV}, k AS (SELECT img_id, i, CAST(floor(h / 30) AS INT) % 6 AS k, v, v * (1 - s / 255.0::DOUBLE) AS p, v * (1 - s / 255.0::DOUBLE * (h / 30 - floor(h / 30))) AS q, v * (1 - s / 255.0::DOUBLE * (1 - (h / 30 - floor(h / 30)))) AS t FROM hsv)"""

COLORS: dict[str, str] = {
    "to_hsv": f"WITH {_HSV} {_three('hsv', 'h', 's', 'v')}",
    "to_ycrcb": f"WITH {_YCC} {_three('ycc', 'y', 'cr', 'cb')}",
    "to_bgr_from_hsv": f"WITH {_BACK} " + _three("k", *[BYTE.format(f"CASE k {' '.join(f'WHEN {n} THEN {c}' for n, c in enumerate(row))} END") for row in (["p", "p", "t", "v", "v", "q"], ["t", "v", "v", "q", "p", "p"], ["v", "q", "p", "p", "t", "v"])]),
    "to_bgr_from_ycrcb": f"WITH {_YCC} " + _three("ycc", BYTE.format("y + 1.773::DOUBLE * (cb - 128)"), BYTE.format("y - 0.714::DOUBLE * (cr - 128) - 0.344::DOUBLE * (cb - 128)"), BYTE.format("y + 1.403::DOUBLE * (cr - 128)")),
}

COLORS["match_template"] = f"""WITH {PV}, w AS (SELECT img_id, CAST(t // 6 AS INT) AS y, CAST(t % 6 AS INT) AS x, list_sum(list_transform(range(9), lambda k: (px[(t // 6 + k // 3) * 8 + t % 6 + k % 3 + 1] - px[(2 + k // 3) * 8 + 3 + k % 3 + 1]) ** 2)) AS s FROM pv, range(36) r(t)),
 b AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY s, y, x) AS r FROM w) SELECT img_id, CAST(k AS INT) AS i, CASE k WHEN 0 THEN x WHEN 1 THEN y ELSE s END::DOUBLE AS v FROM b, range(3) g(k) WHERE r = 1"""

"""Point-wise operators on images held as arrays of pixel values in row order.

All are expressions over one row: no shuffle, no Python worker. Two images of one operator must be in the same row, by a
join on their ids. Values of 8-bit images are whole numbers from 0 to 255.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.errors import ParameterError, require

MODES = ("binary", "binary_inv", "trunc", "to_zero", "to_zero_inv", "otsu")


def saturated(v: Column) -> Column:
    """Rounded to even and clamped to 0..255."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v))).cast("int")


def each(image: Column, f) -> Column:
    return F.transform(image, f)


def both(a: Column, b: Column, f) -> Column:
    """f over pixels in pairs; null where the sizes differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once a row, not again for each pixel that uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def add(a: Column, b: Column) -> Column:
    return both(a, b, lambda x, y: F.least(F.lit(255), x + y))


def subtract(a: Column, b: Column) -> Column:
    return both(a, b, lambda x, y: F.greatest(F.lit(0), x - y))


def multiply(a: Column, b: Column, scale: float = 1.0) -> Column:
    return both(a, b, lambda x, y: saturated(x.cast("double") * y * scale))


def divide(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Where the divisor is 0 the quotient is 0."""
    return both(a, b, lambda x, y: F.when(y == 0, F.lit(0)).otherwise(saturated(x.cast("double") * scale / F.nullif(y.cast("double"), F.lit(0.0)))))


def abs_diff(a: Column, b: Column) -> Column:
    return both(a, b, lambda x, y: F.abs(x - y))


def bitwise_and(a: Column, b: Column) -> Column:
    return both(a, b, lambda x, y: x.bitwiseAND(y))


def bitwise_or(a: Column, b: Column) -> Column:
    return both(a, b, lambda x, y: x.bitwiseOR(y))


def invert(image: Column) -> Column:
    return each(image, lambda x: 255 - x)


bitwise_not = invert


def brightness(image: Column, delta: float) -> Column:
    return each(image, lambda x: saturated(x + F.lit(float(delta))))


def contrast(image: Column, factor: float) -> Column:
    require(factor > 0, "factor must be over 0")
    return each(image, lambda x: saturated(x * F.lit(float(factor))))


def convert_scale_abs(image: Column, alpha: float = 1.0, beta: float = 0.0) -> Column:
    return each(image, lambda x: saturated(F.abs(x * F.lit(float(alpha)) + F.lit(float(beta)))))


def lut(image: Column, table: list[int]) -> Column:
    """The table's entry for each pixel. The table is part of the plan, as one folded literal."""
    require(len(table) == 256, "a table has 256 entries")
    entries = F.expr(f"array({', '.join(map(str, table))})")
    return each(image, lambda x: F.get(entries, x))


def gamma(image: Column, g: float) -> Column:
    require(g > 0, "gamma must be over 0")
    return lut(image, [min(255, max(0, round(255 * (i / 255) ** g))) for i in range(256)])


def gamma_float(image: Column, g: float) -> Column:
    require(g > 0, "gamma must be over 0")
    return each(image, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(x, F.lit(float(g))))))


def threshold(image: Column, thresh: float, high: float = 255, mode: str = "binary") -> Column:
    """Strictly over the threshold counts as above it."""
    if mode not in MODES:
        raise ParameterError(f"mode must be one of {', '.join(MODES)}")
    if mode == "otsu":
        return bound(otsu(image), lambda level: threshold_at(image, level, high))
    above = {"binary": lambda x: F.lit(high), "binary_inv": lambda x: F.lit(0), "trunc": lambda x: F.lit(thresh), "to_zero": lambda x: x, "to_zero_inv": lambda x: F.lit(0)}[mode]
    below = {"binary": lambda x: F.lit(0), "binary_inv": lambda x: F.lit(high), "trunc": lambda x: x, "to_zero": lambda x: F.lit(0), "to_zero_inv": lambda x: x}[mode]
    return each(image, lambda x: F.when(x > F.lit(thresh), above(x)).otherwise(below(x)).cast("int"))


def threshold_at(image: Column, level: Column, high: float = 255) -> Column:
    return each(image, lambda x: F.when(x > level, F.lit(high)).otherwise(0).cast("int"))


def otsu(image: Column) -> Column:
    """The level that splits the pixels with the largest variance between classes; of equal ones the least.

    The between-class variance is n0 n1 (m0 - m1) ** 2; with whole sums it is compared as
    (n1 s0 - n0 s1) ** 2 / (n0 n1). Only levels that occur can be the best, so the sorted distinct values are tried.
    """
    def best(total: Column) -> Column:
        def score(level: Column) -> Column:
            zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s"))
            part = F.aggregate(image, zero, lambda t, x: F.when(x <= level, F.struct((t["n"] + 1).alias("n"), (t["s"] + x).alias("s"))).otherwise(t))
            return bound(part, lambda p: F.struct(between(p["n"], p["s"], total).alias("value"), (-level).alias("back")))

        return F.array_max(F.transform(F.array_distinct(image), score))

    def between(n0: Column, s0: Column, total: Column) -> Column:
        n0, s0, n1, s1 = n0.cast("double"), s0.cast("double"), (F.size(image) - n0).cast("double"), (total - s0).cast("double")
        return F.when((n0 == 0) | (n1 == 0), 0.0).otherwise(F.pow(n1 * s0 - n0 * s1, F.lit(2.0)) / F.nullif(n0 * n1, F.lit(0.0)))

    return -bound(F.aggregate(image, F.lit(0).cast("bigint"), lambda s, x: s + x), best).getField("back")


def in_range(channels: list[Column], low: list[float], high: list[float]) -> Column:
    """255 where every channel is within its bounds, both included."""
    require(len(channels) == len(low) == len(high) > 0, "one bound a channel")
    inside = F.transform(channels[0], lambda x: x.between(low[0], high[0]))
    for c, lo, hi in zip(channels[1:], low[1:], high[1:], strict=True):
        inside = F.zip_with(inside, c, _within(lo, hi))
    return F.transform(inside, lambda x: F.when(x, 255).otherwise(0))


def _within(low: float, high: float):
    return lambda s, x: s & x.between(low, high)


def apply_mask(image: Column, mask: Column) -> Column:
    return both(image, mask, lambda x, m: F.when(m == 0, F.lit(0)).otherwise(x))


def weighted_blend(a: Column, b: Column, alpha: float) -> Column:
    require(0 <= alpha <= 1, "alpha must be from 0 to 1")
    return both(a, b, lambda x, y: saturated(x * F.lit(float(alpha)) + y * F.lit(1 - float(alpha))))


def alpha_blend(image: Column, overlay: Column, alpha: Column) -> Column:
    """The overlay over the image, by the overlay's alpha channel (0 to 255)."""
    share = F.transform(alpha, lambda x: x / 255.0)
    over = F.zip_with(overlay, share, lambda q, s: F.struct(q.alias("q"), s.alias("s")))
    return F.zip_with(image, over, lambda p, t: saturated(p * (1 - t["s"]) + t["q"] * t["s"]))


def low(image: Column) -> Column:
    return F.array_min(image)


def high(image: Column) -> Column:
    return F.array_max(image)


def normalize_to(image: Column, lo: float, hi: float) -> Column:
    """Stretched over lo..hi; an image of one value becomes 0, even where 0 is outside."""
    require(lo < hi, "lo must be under hi")
    def stretched(ends: Column) -> Column:
        span = (ends["high"] - ends["low"]).cast("double")
        return F.transform(image, lambda x: F.when(span < 1e-10, 0.0).otherwise(F.lit(float(lo)) + (x - ends["low"]) * F.lit(float(hi - lo)) / F.nullif(span, F.lit(0.0))))

    return bound(F.struct(low(image).alias("low"), high(image).alias("high")), stretched)


def normalize(image: Column) -> Column:
    return normalize_to(image, 0.0, 1.0)


def standardize(image: Column, mean: float, std: float) -> Column:
    require(std > 0, "std must be over 0")
    return each(image, lambda x: (x - F.lit(float(mean))) / F.lit(float(std)))


def to_float(image: Column) -> Column:
    return each(image, lambda x: x / F.lit(255.0))


def to_bytes(image: Column) -> Column:
    return each(image, lambda x: saturated(x * 255.0))


def to_gray(b: Column, g: Column, r: Column) -> Column:
    """Luminosity, rounded; within one level of fixed-point weights."""
    return F.zip_with(F.zip_with(b, g, lambda x, y: x * F.lit(0.114) + y * F.lit(0.587)), r, lambda s, z: saturated(s + z * F.lit(0.299)))


def solarize(image: Column, level: int) -> Column:
    return each(image, lambda x: F.when(x >= level, 255 - x).otherwise(x))


def posterize(image: Column, bits: int) -> Column:
    require(1 <= bits <= 8, "bits must be from 1 to 8")
    return each(image, lambda x: x.bitwiseAND(F.lit(256 - (1 << (8 - bits)))))


def channel(image: Column, k: int, channels: int) -> Column:
    """One plane of interleaved pixels."""
    require(0 <= k < channels, "no such channel")
    return F.filter(image, lambda x, i: i % channels == k)


def interleave(*planes: Column) -> Column:
    """Interleaved pixels of planes of one size."""
    rows = F.transform(planes[0], lambda x: F.array(x))
    for p in planes[1:]:
        rows = F.zip_with(rows, p, lambda r, x: F.concat(r, F.array(x)))
    return F.flatten(rows)


def crop(image: Column, width: int, x: int, y: int, w: int, h: int) -> Column:
    require(x >= 0 and y >= 0 and w > 0 and h > 0 and x + w <= width, "the region must lie in the image")
    return F.filter(image, lambda v, i: (i % width >= x) & (i % width < x + w) & (F.floor(i / width) >= y) & (F.floor(i / width) < y + h))


def center_crop(image: Column, width: int, height: int, w: int, h: int) -> Column:
    require(w <= width and h <= height, "the region must lie in the image")
    return crop(image, width, (width - w) // 2, (height - h) // 2, w, h)


def flip(image: Column, width: int, height: int, how: str = "horizontal") -> Column:
    if how not in ("horizontal", "vertical", "both"):
        raise ParameterError("how must be horizontal, vertical or both")
    last = F.lit(width * height - 1)
    if how == "both":
        return F.reverse(image)
    at = (lambda i: i - i % width + (width - 1 - i % width)) if how == "horizontal" else (lambda i: last - (i - i % width) - (width - 1) + i % width)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.get(image, at(i).cast("int")))


def pad(image: Column, width: int, height: int, top: int, bottom: int, left: int, right: int, mode: str = "constant", value: int = 0) -> Column:
    """constant, replicate, or reflect (the edge pixel not repeated)."""
    require(min(top, bottom, left, right) >= 0 and max(top, bottom, left, right) > 0, "one side must grow, none may shrink")
    if mode not in ("constant", "reflect", "replicate"):
        raise ParameterError("mode must be constant, reflect or replicate")
    new = width + left + right

    def inside(k: Column, n: int) -> Column:
        if mode == "replicate":
            return F.greatest(F.lit(0), F.least(F.lit(n - 1), k))
        k = F.abs(k)
        return F.when(k > n - 1, 2 * (n - 1) - k).otherwise(k)

    def pixel(i: Column) -> Column:
        y, x = F.floor(i / new) - top, i % new - left
        if mode == "constant":
            return F.when((y >= 0) & (y < height) & (x >= 0) & (x < width), F.get(image, (y * width + x).cast("int"))).otherwise(F.lit(value))
        return F.get(image, (inside(y, height) * width + inside(x, width)).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(new * (height + top + bottom) - 1)), pixel)


def pad_to_square(image: Column, width: int, height: int, mode: str = "constant", value: int = 0) -> Column:
    side = max(width, height)
    dx, dy = side - width, side - height
    return image if dx == dy == 0 else pad(image, width, height, dy // 2, dy - dy // 2, dx // 2, dx - dx // 2, mode, value)

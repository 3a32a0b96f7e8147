"""Distances and likenesses of vectors, hashes and boxes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is empty or of length zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (size == 0), 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ, of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Bits that differ, of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def packed(bits: Column) -> Column:
    """A long from up to 64 truth values, the first as its lowest bit."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def average_hash(image: Column) -> Column:
    """64 bits of an 8x8 image: whether each pixel is over the mean."""
    mean = total(image) / F.size(image)
    return packed(F.flatten(F.transform(F.array(mean), lambda m: F.transform(image, lambda x: x > m))))


def iou(x1: Column, y1: Column, w1: Column, h1: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    """Intersection over union of two boxes; 0 if the union has no area."""
    width = F.greatest(F.lit(0.0), F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2))
    height = F.greatest(F.lit(0.0), F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2))
    shared = width * height
    union = w1 * h1 + w2 * h2 - shared
    return F.when(union <= 0, 0.0).otherwise(shared / F.nullif(union.cast("double"), F.lit(0.0)))


def psnr(mse: Column) -> Column:
    return F.when(mse < 1e-10, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / mse))


def compare_hist(a: Column, b: Column, method: str = "correl") -> Column:
    """correl, chisqr, intersect, bhattacharyya, chisqr_alt or kl_div of two histograms of one size."""
    n = F.size(a)
    sa, sb = total(a), total(b)
    if method == "correl":
        top = n * dot(a, b) - sa * sb
        size = F.sqrt(n * dot(a, a) - sa * sa) * F.sqrt(n * dot(b, b) - sb * sb)
        return F.when(size == 0, 1.0).otherwise(top / F.nullif(size, F.lit(0.0)))
    if method == "chisqr":
        return total(F.zip_with(a, b, lambda x, y: F.when(x == 0, 0.0).otherwise((x - y) * (x - y) / F.nullif(x.cast("double"), F.lit(0.0)))))
    if method == "chisqr_alt":
        return 2 * total(F.zip_with(a, b, lambda x, y: F.when(x + y == 0, 0.0).otherwise((x - y) * (x - y) / F.nullif((x + y).cast("double"), F.lit(0.0)))))
    if method == "intersect":
        return total(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")))
    if method == "bhattacharyya":
        size = F.sqrt(sa * sb)
        return F.when(size == 0, 1.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - total(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y))) / F.nullif(size, F.lit(0.0)))))
    if method == "kl_div":
        return total(F.zip_with(a, b, lambda x, y: F.when(x == 0, 0.0).otherwise(x * F.ln(x / F.when(y == 0, F.lit(1e-10)).otherwise(y.cast("double"))))))
    raise ValueError(f"no method {method}")

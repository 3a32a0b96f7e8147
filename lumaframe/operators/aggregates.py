"""Aggregates over pixel rows: one row a pixel, (img_id, y, x, v) or with a channel column.

Every aggregate groups by img_id, with partial aggregation before the shuffle; running sums are windows within one image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.errors import ParameterError, require


def mean_std_dev(px: DataFrame, by: tuple[str, ...] = ("img_id",)) -> DataFrame:
    """Mean and population deviation."""
    return px.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"))


def min_max_loc(px: DataFrame) -> DataFrame:
    """Least and greatest value and where, in row order, each is first."""
    low, high = F.min(F.struct("v", "y", "x")), F.min(F.struct((-F.col("v")).alias("n"), "y", "x"))
    out = px.groupBy("img_id").agg(low.alias("lo"), high.alias("hi"))
    return out.select("img_id", F.col("lo.v").alias("min_v"), F.col("lo.y").alias("min_y"), F.col("lo.x").alias("min_x"), (-F.col("hi.n")).alias("max_v"), F.col("hi.y").alias("max_y"), F.col("hi.x").alias("max_x"))


def count_non_zero(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg(F.count_if(F.col("v") != 0).alias("n"))


def reduce(px: DataFrame, axis: int, how: str = "sum") -> DataFrame:
    """To one row (axis 0: a value a column) or one column (axis 1: a value a row)."""
    require(axis in (0, 1), "axis must be 0 or 1")
    f = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}.get(how)
    if f is None:
        raise ParameterError("how must be sum, avg, max or min")
    return px.groupBy("img_id", F.col("x" if axis == 0 else "y").alias("at")).agg(f("v").alias("v"))


def integral_image(px: DataFrame, squares: bool = False) -> DataFrame:
    """Summed-area table, one row and column larger, with a border of zeros: sums of what lies above and left."""
    along = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("img_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    values = {"s": F.col("v")} | ({"sq": F.col("v") * F.col("v")} if squares else {})
    part = px.select("img_id", "y", "x", *[F.sum(c).over(along).alias(k) for k, c in values.items()])
    inner = part.select("img_id", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), *[F.sum(k).over(down).alias(k) for k in values])
    size = px.groupBy("img_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    top = size.select("img_id", F.lit(0).alias("y"), F.explode(F.sequence(F.lit(0), F.col("mx") + 1)).alias("x"))
    left = size.select("img_id", F.explode(F.sequence(F.lit(1), F.col("my") + 1)).alias("y"), F.lit(0).alias("x"))
    border = top.unionByName(left)
    return inner.unionByName(border.select("*", *[F.lit(0).cast("bigint").alias(k) for k in values]))


def moments(px: DataFrame) -> DataFrame:
    """Raw moments to order 3, central and normalised central moments, and Hu's seven."""
    raw = {(i, j): F.sum(F.pow(F.col("x").cast("double"), F.lit(float(i))) * F.pow(F.col("y").cast("double"), F.lit(float(j))) * F.col("v")) for i in range(4) for j in range(4) if i + j <= 3}
    m = px.groupBy("img_id").agg(*[c.alias(f"m{i}{j}") for (i, j), c in raw.items()])
    area = F.nullif(F.col("m00"), F.lit(0.0))
    m = m.withColumns({"cx": F.coalesce(F.col("m10") / area, F.lit(0.0)), "cy": F.coalesce(F.col("m01") / area, F.lit(0.0))})
    c = F.col
    m = m.withColumns({
        "mu20": c("m20") - c("cx") * c("m10"), "mu11": c("m11") - c("cx") * c("m01"), "mu02": c("m02") - c("cy") * c("m01"),
        "mu30": c("m30") - 3 * c("cx") * c("m20") + 2 * c("cx") * c("cx") * c("m10"), "mu03": c("m03") - 3 * c("cy") * c("m02") + 2 * c("cy") * c("cy") * c("m01"),
        "mu21": c("m21") - 2 * c("cx") * c("m11") - c("cy") * c("m20") + 2 * c("cx") * c("cx") * c("m01"), "mu12": c("m12") - 2 * c("cy") * c("m11") - c("cx") * c("m02") + 2 * c("cy") * c("cy") * c("m10"),
    })
    for k in ("20", "11", "02", "30", "21", "12", "03"):
        power = 1 + (int(k[0]) + int(k[1])) / 2
        m = m.withColumn(f"nu{k}", F.coalesce(c(f"mu{k}") / F.pow(area, F.lit(power)), F.lit(0.0)))
    p, q, r, t = c("nu30") + c("nu12"), c("nu21") + c("nu03"), c("nu30") - 3 * c("nu12"), 3 * c("nu21") - c("nu03")
    d, e = c("nu20") - c("nu02"), c("nu11")
    hu = [c("nu20") + c("nu02"), d * d + 4 * e * e, r * r + t * t, p * p + q * q, r * p * (p * p - 3 * q * q) + t * q * (3 * p * p - q * q), d * (p * p - q * q) + 4 * e * p * q, t * p * (p * p - 3 * q * q) - r * q * (3 * p * p - q * q)]
    return m.withColumns({f"hu{k + 1}": h for k, h in enumerate(hu)})


def histogram(px: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """img_id, bin, n for every bin; values outside [low, high) count nowhere."""
    require(bins > 0 and low < high, "bins must be over 0 and low under high")
    at = F.floor((F.col("v") - low) * bins / (high - low)).cast("int").alias("bin")
    counts = px.where((F.col("v") >= low) & (F.col("v") < high)).groupBy("img_id", at).agg(F.count("*").alias("n"))
    spine = px.select("img_id").distinct().select("img_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counts, ["img_id", "bin"], "left").select("img_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_equalization(px: DataFrame) -> DataFrame:
    """img_id, y, x, v: values by the running count of their histogram, from the first value's on; flat images stay."""
    order = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img_id")
    counts = px.groupBy("img_id", "v").agg(F.count("*").alias("n")).select("img_id", "v", F.sum("n").over(order).alias("run"), F.sum("n").over(whole).alias("total"))
    first = F.min("run").over(whole)
    new = F.when(F.col("total") == first, F.col("v")).otherwise(F.rint((F.col("run") - first) * 255.0 / F.nullif((F.col("total") - first).cast("double"), F.lit(0.0))).cast("int"))
    return px.join(counts.select("img_id", F.col("v").alias("_v"), new.alias("new")).withColumnRenamed("img_id", "_id"), (F.col("img_id") == F.col("_id")) & (F.col("v") == F.col("_v"))).select("img_id", "y", "x", F.col("new").alias("v"))


def mse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean squared difference of images of one id and size, over all channels."""
    keys = ["img_id", "y", "x"] + (["c"] if "c" in a.columns else [])
    return a.join(b.withColumnRenamed("v", "_w"), keys).groupBy("img_id").agg(F.avg(F.pow((F.col("v") - F.col("_w")).cast("double"), F.lit(2.0))).alias("mse"))


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    from lumaframe.functions.distance import psnr as of

    return mse(a, b).select("img_id", of(F.col("mse")).alias("psnr"))


def component_map(labels: DataFrame) -> DataFrame:
    """Area, bounding box and centroid of every label over 0 of (img_id, y, x, label)."""
    box = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")]
    return labels.where("label > 0").groupBy("img_id", "label").agg(F.count("*").alias("area"), *box, F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def block_mean_hash(px: DataFrame, block: int) -> DataFrame:
    """img_id, block, bit: whether a block's mean is over the image's, by rows of blocks."""
    require(block > 0, "block must be over 0")
    size = Window.partitionBy("img_id")
    by, bx = F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx")
    means = px.groupBy("img_id", by, bx).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    over = F.col("s") * F.sum("n").over(size) > F.sum("s").over(size) * F.col("n")
    return means.select("img_id", "by", "bx", over.cast("int").alias("bit"))


def bins_of(scores: DataFrame, score: Column, bins: int, threshold: float) -> DataFrame:
    """Histogram of scores from 0 to 1, a score of 1 in the last bin, with the mean and the share over the threshold."""
    require(bins > 0, "bins must be over 0")
    at = F.least(F.lit(bins - 1), F.floor(score * bins).cast("int")).alias("bin")
    per = scores.groupBy(at).agg(F.count("*").alias("n"))
    spine = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = scores.agg(F.avg(score).alias("mean"), F.avg((score > threshold).cast("double")).alias("share"))
    return spine.join(per, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n")).join(F.broadcast(total))  # one row

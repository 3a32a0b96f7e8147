"""Inputs that the queries derive from the tables, and the same derivations in SQL.

The tables hold no images or boxes; these stand-ins make the operators' logic checkable, not image decoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, label, px: each embedding as an 8x8 image of whole values, 32 to a unit around 128."""
    px = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 32 + 128))).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("img_id"), "label", px.alias("px"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, a, b: each image and the next one."""
    im = images(spark, sf_dir)
    return im.select("img_id", F.col("px").alias("a")).join(im.select((F.col("img_id") - 1).alias("img_id"), F.col("px").alias("b")), "img_id")


def rows(df: DataFrame, pixels: Column, value: str = "v") -> DataFrame:
    """img_id, i, value: one row a pixel."""
    return df.select("img_id", pixels.alias("_p")).select("img_id", F.posexplode("_p").alias("i", value))


IM = "im AS (SELECT CAST(vec_id AS BIGINT) AS img_id, label, CAST(i AS INT) AS i, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(least(255, greatest(0, floor(CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) * 32 + 128))) AS INT) AS v FROM embeddings, range(64) r(i))"
#: Whole images are joined, not their pixels.
PV = IM + ", pv AS (SELECT img_id, list(v ORDER BY i) AS px FROM im GROUP BY img_id)"
PR = PV + ", pr AS (SELECT p.img_id, CAST(r.i AS INT) AS i, p.px[r.i + 1] AS a, q.px[r.i + 1] AS b FROM pv p JOIN pv q ON q.img_id = p.img_id + 1, range(64) r(i))"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, k, x, y, w, h, cls, conf: distinct boxes, numbered within their frame, from the lines of an order."""
    li = table(spark, sf_dir, "lineitem")
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int")
    return li.select(
        F.col("l_orderkey").cast("bigint").alias("frame"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("x"), (F.col("l_quantity").cast("int") % 7 * 5 + F.col("l_linenumber")).alias("y"),
        (10 + hundredths("l_discount")).alias("w"), (10 + hundredths("l_tax")).alias("h"), (F.col("l_partkey") % 3).cast("int").alias("cls"), (F.col("l_suppkey") % 97).cast("int").alias("conf"),
    ).distinct()


BOX = """bx AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS frame, l_linenumber * 10 + CAST(l_quantity AS INT) AS x, CAST(l_quantity AS INT) % 7 * 5 + l_linenumber AS y,
 10 + CAST(round(l_discount * 100) AS INT) AS w, 10 + CAST(round(l_tax * 100) AS INT) AS h, CAST(l_partkey % 3 AS INT) AS cls, CAST(l_suppkey % 97 AS INT) AS conf FROM lineitem)"""

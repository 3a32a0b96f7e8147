"""Queries of the lazy views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaframe.functions import pixel
from lumaframe.operators.views import View, compose
from lumaframe.plans.inputs import IM, images, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_EV = "ev AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def view(spark, sf) -> View:
    return View(table(spark, sf, "events").select("event_id", "ts", F.col("value").alias("value")), ("ts", "event_id"))


@query(f"WITH {_EV} SELECT event_id, value FROM ev WHERE k < 100")
def view_take(spark, sf):
    return view(spark, sf).take(100).to_df().select("event_id", "value")


@query(f"WITH {_EV} SELECT event_id, value FROM ev WHERE k >= 9000 OR k >= (SELECT count(*) FROM ev) - 500 AND k >= 9000")
def view_drop(spark, sf):
    return view(spark, sf).drop(9000).to_df().select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value > 100 AND event_id % 3 = 0")
def view_filter(spark, sf):
    return view(spark, sf).filter("event_id % 3 = 0").filter(F.col("value") > 100).to_df().select("event_id", "value")


@query("SELECT event_id, round(value * 2 + 1, 6) AS value FROM events")
def view_transform(spark, sf):
    return view(spark, sf).transform(lambda v: v * 2, "double").transform(lambda v: v + 1, "double").to_df().select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, round(value * 2, 6) AS value FROM events WHERE value * 2 > 900")
def view_filter_after_transform(spark, sf):
    return view(spark, sf).transform(lambda v: v * 2, "double").filter(F.col("value") > 900).to_df().select("event_id", F.round("value", 6).alias("value"))


@query(f"WITH {_EV} SELECT event_id, round(value * 2, 6) AS value FROM ev WHERE k < 16")
def view_transform_take(spark, sf):
    return view(spark, sf).transform(lambda v: v * 2, "double").take(16).to_df().select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS index FROM events WHERE value > 200")
def view_enumerate(spark, sf):
    return view(spark, sf).filter("value > 200").enumerate().to_df().select("event_id", "index")


@query("WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE value > 200), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT event_id, o_orderkey AS other FROM a JOIN b USING (k)")
def view_zip(spark, sf):
    other = View(table(spark, sf, "orders"), ("o_orderdate", "o_orderkey"), "o_orderkey")
    return view(spark, sf).filter("value > 200").zip(other).to_df().select("event_id", "other")


@query(f"WITH {_EV} SELECT k // 7 AS batch, count(*) AS n, round(min(value), 6) AS low, round(sum(value), 4) AS total FROM ev GROUP BY ALL")
def view_batch(spark, sf):
    chunks = view(spark, sf).batch(7)
    return chunks.select("batch", F.size("items").cast("bigint").alias("n"), F.round(F.array_min("items"), 6).alias("low"), F.round(F.aggregate("items", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"WITH {IM} SELECT img_id, CAST(sum(CASE WHEN 255 - least(255, v + 20) > 100 THEN 255 ELSE 0 END) AS INT) AS total FROM im GROUP BY img_id")
def pipe_operators(spark, sf):
    step = lambda f: lambda df: df.withColumn("px", f(F.col("px")))
    chain = compose(step(lambda p: pixel.brightness(p, 20)), step(pixel.invert), step(lambda p: pixel.threshold(p, 100)))
    return images(spark, sf).transform(chain).select("img_id", F.aggregate("px", F.lit(0), lambda s, x: s + x).alias("total"))

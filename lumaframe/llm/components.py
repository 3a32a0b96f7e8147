"""Connected components of a graph given by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """id, root for every end of a link: root is the least id reachable. edges: a, b (long).

    Alternates large-star and small-star steps until the links no longer change; each node then points at its
    root. A step is a minimum by node, with partial aggregation, and a join; its links are checkpointed to the
    shared folder, so lineage stays short and a lost executor costs one step. No component is ever collected.
    """
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select("v", F.col("m").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        links = checkpointed(small)
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
        if state == now:
            break
        state = now
    return links.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(links.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())

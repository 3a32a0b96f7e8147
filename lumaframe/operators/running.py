"""Running sums in an order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.operators.views import held_in_order


def running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """df with inclusive running sums in the given order, from the start of each group.

    Rows are range-partitioned by group and order, whatever the groups' sizes; each partition's rows are summed by themselves,
    and a table with a row a partition and group holds what comes before. So neither one large group nor one order over all
    rows is one task.
    """
    held = held_in_order(df, [*by, *order])
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    rows = held.withColumns({"_part": F.shiftrightunsigned("_id", 33), "_place": place} | {f"_v{k}": v for k, v in enumerate(sums.values())})
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(sums))])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    met = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = Window.partitionBy(*by, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_r{k}": F.sum(f"_v{k}").over(own) for k in range(len(sums))}).join(before, met)
    return rows.select(*[F.col(c) for c in df.columns], *[(F.col(f"_r{k}") + F.col(f"_b{k}")).alias(name) for k, name in enumerate(sums)])

"""Lazy ordered views over a collection of rows.

A view is a DataFrame with an order and a list of kernels that wait to be applied. take and drop go below waiting
kernels, which do not change the number of rows, so a kernel runs only for rows that are kept; all waiting kernels are
fused into one pandas UDF when the view is forced. A filter on a kernel's output is a barrier: the kernels are
applied first, once, as a column that the optimiser may not compute again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaframe.errors import ParameterError, require

Kernel = Callable[[object], object]


@dataclass(frozen=True)
class View:
    """An ordered collection. order: columns that put rows in order; ties must not exist or not matter."""

    df: DataFrame
    order: tuple[str, ...] = ("ord",)
    column: str = "value"
    pending: tuple[Kernel, ...] = field(default=())
    result: str | T.DataType | None = None

    def transform(self, kernel: Kernel, result: str | T.DataType) -> View:
        """The kernel on each value of the column, when the view is forced; result: the type it leaves there."""
        return replace(self, pending=(*self.pending, kernel), result=result)

    def select(self, expression: Column) -> View:
        """A built-in expression for the column."""
        return replace(self.forced(), df=self.forced().df.withColumn(self.column, expression))

    def filter(self, condition: Column | str) -> View:
        """Rows that meet a condition on other columns than the kernels' result go before the kernels run."""
        names = set(_names(self.df, condition))
        if self.pending and self.column in names:
            return replace(self.forced(barrier=True), df=self.forced(barrier=True).df.where(condition))
        return replace(self, df=self.df.where(condition))

    def take(self, n: int) -> View:
        require(n >= 0, "n must be 0 or more")
        return replace(self, df=self.df.orderBy(*self.order).limit(n))

    def drop(self, n: int) -> View:
        require(n >= 0, "n must be 0 or more")
        return replace(self, df=self.df.orderBy(*self.order).offset(n))

    def enumerate(self, name: str = "index", start: int = 0) -> View:
        """Positions from 0 in the view's order, after whatever was filtered."""
        return replace(self, df=positions(self.df, self.order, name, start))

    def zip(self, other: View, name: str = "other") -> View:
        """Rows of two views in pairs by position, as many as the shorter has."""
        a, b = self.forced(), other.forced()
        left = positions(a.df, a.order, "_at", 0)
        right = positions(b.df, b.order, "_at", 0).select("_at", F.col(b.column).alias(name))
        return replace(a, df=left.join(right, "_at").drop("_at"))

    def batch(self, n: int) -> DataFrame:
        """batch, items: chunks of n values in order, the last maybe shorter."""
        require(n > 0, "n must be over 0")
        done = self.forced()
        at = positions(done.df, done.order, "_at", 0)
        return at.groupBy(F.floor(F.col("_at") / n).alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.col(done.column).alias("v")))), lambda s: s["v"]).alias("items"))

    def forced(self, barrier: bool = False) -> View:
        """The view with its kernels in the plan, as one UDF."""
        if not self.pending:
            return self
        kernels = self.pending

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                values = []
                for v in part:
                    for k in kernels:
                        v = None if v is None else k(v)
                    values.append(v)
                yield pd.Series(values, dtype=object)

        udf = F.pandas_udf(run, self.result)
        if barrier:
            udf = udf.asNondeterministic()
        return replace(self, df=self.df.withColumn(self.column, udf(F.col(self.column))), pending=(), result=None)

    def to_df(self) -> DataFrame:
        return self.forced().df

    def to_list(self) -> list:
        """The values, in order, in the driver; they are sorted there, as a sort in the plan would run the kernels again for its bounds."""
        done = self.forced()
        got = done.df.select(F.struct(*done.order).alias("o"), F.col(done.column).alias("v")).collect()
        return [r["v"] for r in sorted(got, key=lambda r: tuple(r["o"]))]


def _names(df: DataFrame, condition: Column | str) -> list[str]:
    plan = df.where(condition)._jdf.queryExecution().analyzed()
    refs = plan.expressions().head().references().toSeq()
    return [refs.apply(i).name() for i in range(refs.length())]


def checkpointing(spark: SparkSession) -> None:
    """Sets the folder of checkpoints, if it isn't yet: that of spark.checkpoint.dir, which all executors share; a local one
    only where the session is local."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ParameterError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="lumaframe-")
    spark.sparkContext.setCheckpointDir(found)


def held_in_order(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df range-partitioned and sorted, checkpointed, with _id: the partition's number above the place in it, 33 bits."""
    checkpointing(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint().withColumn("_id", F.monotonically_increasing_id())


def positions(df: DataFrame, order: tuple[str, ...], name: str, start: int = 0) -> DataFrame:
    """df with exact positions from start in the given order, by range partitions and their counts.

    No window over all rows: rows are range-partitioned and sorted, each partition's rows are counted, and positions are the
    partition's start plus the place in it. The partitions are held for both passes by a checkpoint.
    """
    held = held_in_order(df, list(order))
    part, within = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    starts, total = [], start
    for r in sorted(held.groupBy(part.alias("part")).count().collect()):
        starts += [F.lit(int(r["part"])), F.lit(total)]
        total += r["count"]
    begin = F.element_at(F.create_map(*starts), part.cast("int")) if starts else F.lit(start)
    return held.withColumn(name, (begin + within).cast("bigint")).drop("_id")


def grouped_positions(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """Positions from 0 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps in a row, as one step for DataFrame.transform."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run

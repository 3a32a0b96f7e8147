"""What several corpus operators need: the shared folder, checkpoints and exact row numbers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where that is unset and the session is local (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="lumaframe-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> None:
    """Fewer rows and bytes in an Arrow batch than Spark's defaults, as rows are whole texts; a session's own choice stays."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there; their lineage ends."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with its exact global row numbers from 0 in the given order, and the number of rows.

    The rows are range-partitioned and sorted (one shuffle), checkpointed, and numbered from the partitions'
    counts, of which there is one a partition; no window or task ever holds all rows. The position of a row in
    the input is the last sort key: equal rows, which any numbering may swap, then spread over partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_at", F.monotonically_increasing_id())
    ordered = checkpointed(keyed.repartitionByRange(parts, *order, "_at").sortWithinPartitions(*order, "_at").drop("_at"))
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id())
    part, within = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = sorted(ordered.groupBy(part.alias("part")).count().collect())
    starts, total = {}, 0
    for r in counts:
        starts[r["part"]] = total
        total += r["count"]
    if not total:
        return ordered.select(*df.columns, F.lit(0).cast("bigint").alias(name)), 0
    start = F.element_at(F.create_map(*[F.lit(int(x)) for kv in starts.items() for x in kv]), part.cast("int"))
    return ordered.select(*df.columns, (start.cast("bigint") + within).alias(name)), total


#: Rows that are broadcast at most, where a table's size is counted first.
MOST_BROADCAST = 500_000
#: Bits of the table by which thinned() sorts out rows: at most 2 ** 18 rows of 16 bytes are broadcast, whatever the input.
THIN_BITS = 24


def broadcast_if_small(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows (of a few numbers each); df is counted for it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def thinned(df: DataFrame, column: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """Those rows of df whose number in the column is in wanted too, and perhaps some others (or, inside False, the rest); no row of df moves.

    The numbers' last THIN_BITS hash bits are laid out as a table of bits, whose size doesn't depend on the input, and
    broadcast. A join on the column itself must follow; it shuffles only what is left.
    """
    place = lambda name: F.xxhash64(F.col(name).cast("long")).bitwiseAND((1 << THIN_BITS) - 1)
    at, slot, bits = (fresh(x, df) for x in ("at", "slot", "bits"))
    table = wanted.select(place(column).alias(at)).groupBy(F.shiftright(at, 6).alias(slot)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} & 63 AS int))")).alias(bits))
    marked = df.withColumn(at, place(column)).withColumn(slot, F.shiftright(at, 6))
    met = marked.join(F.broadcast(table), slot, "inner" if inside else "left").where(F.expr(f"(shiftrightunsigned(coalesce({bits}, 0L), cast({at} & 63 AS int)) & 1) = {int(inside)}"))
    return met.select(*[F.col(c) for c in df.columns])


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose number in the column isn't in keys (one column). Up to MOST_BROADCAST keys no row of df moves;
    beyond, only those that thinned() lets through are shuffled."""
    key = fresh("key", df)
    keys = keys.toDF(key)
    met = lambda rows, k: rows.join(k, F.col(column) == F.col(key), "left_anti")
    if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return met(df, F.broadcast(keys))
    keys = checkpointed(keys)
    return met(thinned(df, column, keys.withColumnRenamed(key, column)), keys).unionByName(thinned(df, column, keys.withColumnRenamed(key, column), inside=False))


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name that no table here has."""
    taken = {c.lower() for df in dfs for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def remove_folder(spark: SparkSession, uri: str) -> None:
    """Removes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

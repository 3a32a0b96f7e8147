"""Reproducible shuffling and sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.shared import numbered

ROUNDS = 6
WALKS = 16


def permuted(number: str, n: int, seed: int = 0) -> Column:
    """Where the permutation of [0, n) sends the long column ``number``.

    The network works on pairs (left, right) from [0, a) x [0, b), a * b >= n with a * b - n < a, so nearly every
    pass ends inside [0, n). A row outside walks on along its cycle until it is inside. For n up to 289 the walk
    is as long as there are pairs outside, which no cycle can exceed; beyond, 16 passes leave a row outside with
    a probability under n ** -8, and such a row would raise an error, never be misplaced.
    """
    if n < 1:
        return F.lit(None).cast("bigint")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    walks = 1 + min(a * b - n, WALKS)
    keys = ", ".join(f"{seed * 1000 + k}L" for k in range(1, ROUNDS + 1))
    left = f"(s.l + pmod(xxhash64(s.r, k), {a}L)) % {a}L"
    half = f"aggregate(array({keys}), t, (s, k) -> named_struct('l', {left}, 'r', (s.r + pmod(xxhash64({left}, -k), {b}L)) % {b}L))"
    walked = (
        f"aggregate(sequence(1, {walks}), named_struct('l', {number} div {b}L, 'r', {number} % {b}L), "
        f"(t, i) -> if(i > 1 and t.l * {b}L + t.r < {n}L, t, {half}), t -> t.l * {b}L + t.r)"
    )
    return F.expr(f"get(transform(array({walked}), p -> if(p < {n}L, p, raise_error('the walk left the domain'))), 0)")


def shard(df: DataFrame, shards: int, order: list[Column], seed: int = 0) -> DataFrame:
    """df with row_number, position, shard and slot.

    Rows are numbered in the given order, the numbers are permuted, and position p goes to slot p div shards of
    shard p mod shards: shards differ by at most one row, slots have no gaps, and both can be computed from the
    row number alone, or turned back. The same rows give the same result however they are stored or partitioned.
    Rows that are equal in every column of df may swap numbers. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows, n = numbered(df, order)
    rows = rows.withColumn("position", permuted("row_number", n, seed))
    return rows.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / shards) if n < (1 << 50) else F.expr(f"position div {shards}L")})


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row, by the law ``rows``.

    Size is the text's UTF-8 bytes plus 1, null counting as no bytes; its CRC-32 is that of the empty text then.
    Numbers follow doc_id (nulls first), then CRC-32 and size. Only these small columns are shuffled. Further
    columns of docs, whatever their names, are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(small, shards, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.shared import broadcast_if_small, checkpointed, fresh, thinned, without

#: Fixed masks: the token offsets that a seed looks at. Any 12 tokens with 2 substitutions hold a clean seed of one of them.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 4, 5, 6))
#: Letters of scripts that are written without blanks.
ALONE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
WINDOW = 12
SHARE = 0.8
MOST_SEEDS = 1_000_000
#: Tokens of the benchmark that are broadcast at most, 8 bytes each.
MOST_TOKENS = 4_000_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters, marks and digits, in order; a Han, Kana or Thai letter is one by itself."""
    low = F.lower(text)
    apart = F.when(low.rlike(ALONE), F.regexp_replace(low, f"({ALONE})", " $1 ")).otherwise(low)
    words = F.filter(F.split(apart, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def pieces(n: int, share: float) -> list[tuple[int, int]]:
    """(first token, number) of the parts of an item of n tokens, one more than may differ: one of them is whole."""
    parts = n - math.ceil(n * share - 1e-9) + 1
    bounds = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def mask_seeds(n: Column, hashes: Column, mask: tuple[int, ...], number: int) -> Column:
    """Hashes of one mask at all places of a text of n tokens, in order; the mask must fit."""
    return F.transform(F.sequence(F.lit(0), n - mask[-1] - 1), lambda i: F.xxhash64(F.lit(number), *[hashes[i + o] for o in mask]))


def seeds(n: Column, hashes: Column, masks: list[tuple[int, ...]]) -> Column:
    """Hashes of all masks at all places: those of the first mask in order of place, then those of the next."""
    none = F.expr("cast(array() as array<bigint>)")
    return F.flatten(F.array(*[F.when(n > m[-1], mask_seeds(n, hashes, m, k)).otherwise(none) for k, m in enumerate(masks)]))


def placed(n: Column, at: Column, masks: list[tuple[int, ...]]) -> Column:
    """Place of the seed with this number."""
    out, before = None, F.lit(0)
    for m in masks:
        inside = at < before + F.greatest(n - m[-1], F.lit(0))
        out = F.when(inside, at - before) if out is None else out.when(inside, at - before)
        before = before + F.greatest(n - m[-1], F.lit(0))
    return out


def item_seeds(items: DataFrame, masks: tuple[tuple[int, ...], ...], window: int, share: float) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """item_id, item_at, seed of all items, and all masks. Items shorter than the window are cut into parts as they stand."""
    lengths = [r[0] for r in items.where(F.col("n_item") < window).select("n_item").distinct().collect()]  # fewer than the window
    parts = sorted({(n, a, m) for n in lengths for a, m in pieces(n, share)})
    every = [*masks, *[tuple(range(m)) for m in sorted({m for _, _, m in parts})]]
    long = items.where(F.col("n_item") >= window)
    tables = [long.select("item_id", F.posexplode(mask_seeds(F.col("n_item"), F.col("item"), m, k)).alias("item_at", "seed")) for k, m in enumerate(masks)]
    for n, a, m in parts:
        k = every.index(tuple(range(m)), len(masks))
        seed = F.xxhash64(F.lit(k), *[F.col("item")[a + o] for o in range(m)])
        tables.append(items.where(F.col("n_item") == n).select("item_id", F.lit(a).alias("item_at"), seed.alias("seed")))
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    return table, every


def matches(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """As overlaps, for each different text: mark (XXH64 of the text), item_id and top, the best place."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("item")).distinct()
    items = checkpointed(items.withColumn("n_item", F.size("item")).where("n_item > 0"))
    table, every = item_seeds(items, masks, window, share)
    table = broadcast_if_small(table, MOST_SEEDS)

    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("mark"), F.col("text"))
    hashed = texts.select("mark", token_hashes(F.col("text")).alias("doc")).withColumn("n_doc", F.size("doc"))
    probes = hashed.select("mark", "n_doc", F.posexplode(seeds(F.col("n_doc"), F.col("doc"), every)).alias("number", "seed"))
    hits = probes.join(table, "seed").select("mark", "item_id", (placed(F.col("n_doc"), F.col("number"), every) - F.col("item_at")).alias("shift"))
    hits = checkpointed(hits.distinct())

    whole = thinned(texts, "mark", hits).join(broadcast_if_small(hits.select("mark").distinct()), "mark", "left_semi").dropDuplicates(["mark"])
    met = hits.join(whole.select("mark", token_hashes(F.col("text")).alias("doc")), "mark")
    tokens = items.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]
    met = met.join(F.broadcast(items) if tokens <= MOST_TOKENS else items, "item_id")
    agree = F.transform(F.sequence(F.lit(0), F.col("n_item") - 1), lambda i: F.when((i + F.col("shift") >= 0) & (i + F.col("shift") < F.size("doc")), (F.get("doc", (i + F.col("shift")).cast("int")) == F.col("item")[i]).cast("int")).otherwise(0))
    met = met.select("mark", "item_id", "shift", "n_item", F.least(F.lit(window), F.col("n_item")).alias("w"), agree.alias("agree"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_item") - F.col("w") + 1), lambda i: total(F.slice("agree", i, F.col("w")))))
    met = met.withColumn("best", best).where(F.col("best") >= F.ceil(F.col("w") * F.lit(math.floor(share * 1000)) / 1000))
    top = F.max(F.struct("best", total(F.col("agree")).alias("matched"), (-F.col("shift")).alias("back"), "n_item")).alias("top")
    return met.groupBy("mark", "item_id").agg(top)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, doc_start, matched, best, n_tokens: documents that hold a passage of a benchmark item.

    A document overlaps an item if, with the item laid at some place of the document, some ``window`` neighbouring
    tokens (all of a shorter item) agree in at least ``share`` of the places. Places are found by seeds: with the
    default masks every such window of 12 has one; a shorter item is cut into one part more than tokens may differ, of
    which one is whole. Each candidate place is checked on all tokens. Of an item's places in a document the best
    is reported: its first token, the tokens that agree, and those in the best window.

    Null and empty texts have no tokens and overlap nothing; texts of any length are taken whole. Equal texts are judged
    once; rows that share a doc_id each count, and make one row an item; so do rows without one. Seeds of the benchmark are
    broadcast up to MOST_SEEDS rows and shuffled beyond; only the texts that met a seed are read again, and of the
    others nothing is shuffled. Other columns of either table are ignored; empty tables give no rows.
    """
    found = checkpointed(matches(docs, benchmark, masks, window, share))
    ids = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    rows = thinned(ids, "mark", found).join(found, "mark").groupBy("doc_id", "item_id").agg(F.max("top").alias("top"))
    return rows.select("doc_id", "item_id", (-F.col("top.back")).cast("long").alias("doc_start"), F.col("top.matched").cast("long").alias("matched"), F.col("top.best").cast("long").alias("best"), F.col("top.n_item").cast("long").alias("n_tokens"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that overlap no item, all columns; each row is judged by its own text, whatever rows share its doc_id."""
    mark = fresh("mark", docs)
    dirty = checkpointed(matches(docs, benchmark, **how).select("mark").distinct())
    return without(docs.withColumn(mark, F.xxhash64("text")), mark, dirty).select(*[F.col(c) for c in docs.columns])

"""Document fingerprints by a homomorphic hash of the multiset of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.shared import numbered

IDENTITY = 8
LANES = 64
MASK = (1 << 32) - 1
EIGHTS = 0x0101010101010101
CHUNK = 127
BLOCK = 2048
MOST_BLOCKS = 50_000
WIDTH = 16 + 8 * IDENTITY + 8 * LANES


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def identity(text: Column) -> Column:
    """IDENTITY sums over the paragraphs of 32-bit hashes, each modulo 2 ** 32, as one hex string."""
    lanes = [F.aggregate(paragraphs(text), F.lit(0).cast("bigint"), _adder(k)) for k in range(IDENTITY)]
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 8, "0") for x in lanes])


def _adder(k: int):
    return lambda s, p: (s + F.xxhash64(p, F.lit(k)).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))


def units(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words of each paragraph, and of its last word; never none."""
    words = F.transform(paragraphs(text), lambda p: F.split(p, " "))
    return F.flatten(F.transform(words, lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.xxhash64(a, b))))


def lane_sums(unit: Column) -> list[Column]:
    """Aggregates over at most CHUNK units: how many have each bit set, eight 8-bit counters to a long, none of them over 127."""
    return [F.sum(F.shiftrightunsigned(unit, k).bitwiseAND(F.lit(EIGHTS))).alias(f"_s{k}") for k in range(8)]


def lanes_of(chunks: Column) -> Column:
    """The LANES counts from the chunks' counters, modulo 2 ** 32."""
    eighth = lambda j: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(chunks, F.lit(0).cast("bigint"), lambda s, c: s + F.shiftrightunsigned(F.get(c, k), 8 * j).bitwiseAND(F.lit(255))).bitwiseAND(F.lit(MASK)))
    return F.flatten(F.array(*[eighth(j) for j in range(LANES // 8)]))


def written(n: Column, ident: Column, lanes: Column) -> Column:
    """n (16 digits), the identity lanes and the word-pair lanes (8 digits each), in hex."""
    digits = F.transform(lanes, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0"))
    return F.concat(F.lpad(F.lower(F.hex(n)), 16, "0"), ident, F.array_join(digits, ""))


def _field(fp: Column, start: int, width: int) -> Column:
    return F.conv(F.substring(fp, start + 1, width), 16, 10).cast("bigint")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two texts' paragraphs together (sign 1), or of a's without b's (sign -1).

    Lanes are added or taken away modulo 2 ** 32, which is what makes insertion and deletion of paragraphs cheap:
    no text is read again.
    """
    lane = lambda at, w: F.lpad(F.lower(F.hex(F.pmod(_field(a, at, w) + sign * _field(b, at, w), F.lit(1 << 32)))), w, "0")
    return F.concat(lane(0, 16), *[lane(16 + 8 * k, 8) for k in range(IDENTITY + LANES)])


def likeness(na: Column, a: Column, nb: Column, b: Column) -> Column:
    """Cosine of the two lane vectors, from 0 to 1.

    A lane's value is twice its count less the number of units: a sum of +1 and -1, so that the vectors' product
    estimates how many word pairs two texts share, with an error of about 1 / sqrt(LANES) of the geometric mean.
    """

    def vector(n: Column, lanes: Column) -> Column:
        return F.transform(lanes, lambda c: (2 * c - n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = vector(na, a), vector(nb, b)
    size = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size)))


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_units, ident and lanes for every row; keys must tell rows apart. Grouped by the keys."""
    known = df.select(*keys, identity(F.col(text)).alias("ident"), F.col(text).alias("_text"))  # before the explosion, once a row
    exploded = known.select(*keys, "ident", F.posexplode(units(F.col("_text"))).alias("_at", "unit"))
    sums = exploded.groupBy(*keys, "ident", F.floor(F.col("_at") / CHUNK).alias("_chunk")).agg(F.count("*").alias("_n"), *lane_sums(F.col("unit")))
    whole = sums.groupBy(*keys, "ident").agg(F.sum("_n").alias("n_units"), F.collect_list(F.array(*[f"_s{k}" for k in range(8)])).alias("_chunks"))
    return whole.select(*keys, "n_units", "ident", lanes_of(F.col("_chunks")).alias("lanes"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by as many from the head of
    the next document (fewer if that is shorter). Order: falling doc_id, null last, equal ones by text hash; after the
    last document comes the first, and a lone document follows itself. A null text is an empty one.

    Texts are shuffled once, by blocks of neighbours in that order. The bounds of the blocks come from exact row
    numbers of ids and text hashes, at most MOST_BLOCKS of them; a block's first document also goes, as neighbour only, to the
    block before. Rows that share a doc_id, or have none, are in several blocks, but for those that share the text too.
    Texts of any length are taken whole; an empty table gives no rows; other columns of docs are ignored.
    """
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").asc()]
    ids, n = numbered(small.select("doc_id", F.xxhash64("text").alias("mark")), order)
    step = max(BLOCK, -(-n // MOST_BLOCKS))
    bounds = {(r[0] if r[0] is not None else -(1 << 63), r[1]) for r in ids.where(F.col("row_number") % step == 0).select("doc_id", "mark").collect()}
    bounds = sorted(bounds, key=lambda b: (-b[0], b[1]))
    count = max(1, len(bounds))
    table, marks = (f"array({', '.join(_long(b[k]) for b in bounds or [(0, 0)])})" for k in (0, 1))
    steps = ", ".join(str(1 << k) for k in range(count.bit_length() - 1, -1, -1))
    own = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    keyed = small.withColumns({"key": own, "mark": F.xxhash64("text")})
    found = F.expr(f"aggregate(array({steps}), 0, (p, s) -> if(p + s <= {count} and (get({table}, p + s - 1) > key or get({table}, p + s - 1) = key and get({marks}, p + s - 1) <= mark), p + s, p)) - 1")
    keyed = keyed.withColumn("at", found).withColumn("first", F.expr(f"get({table}, at) = key and get({marks}, at) = mark"))
    homes = F.expr(f"if(first, array(named_struct('block', at, 'own', true), named_struct('block', pmod(at - 1, {count}), 'own', false)), array(named_struct('block', at, 'own', true)))")
    dealt = keyed.withColumn("home", F.explode(homes)).select("home.block", "home.own", "doc_id", "mark", "text")

    row = Window.partitionBy("block").orderBy(F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "mark")
    placed = dealt.select("block", "own", "doc_id", "text", F.row_number().over(row).alias("pos"), F.lead("text").over(row).alias("next"))
    chars = F.length("text")
    placed = placed.select("block", "own", "doc_id", "pos", "text", chars.cast("bigint").alias("n_chars"), F.expr("concat(substring(text, 1, length(text) - length(text) div 3), substring(next, 1, int(length(text) div 3)))").alias("edited"))
    sides = F.expr("if(own, array(named_struct('side', 0, 'body', text), named_struct('side', 1, 'body', edited)), array(named_struct('side', 0, 'body', text)))")
    both = placed.withColumn("sha", F.when(F.col("own"), F.sha2("edited", 256))).select("block", "own", "doc_id", "pos", "n_chars", "sha", F.explode(sides).alias("s")).select("block", "own", "doc_id", "pos", "n_chars", "sha", "s.side", "s.body")
    prints = fingerprints(both, ["block", "own", "doc_id", "pos", "n_chars", "sha", "side"], "body")

    line = Window.partitionBy("block").orderBy("pos", "side")
    what = F.struct("n_units", "ident", "lanes")
    met = prints.select("*", F.lead(what, 1).over(line).alias("e"), F.lead(what, 2).over(line).alias("x")).where("own and side = 0")
    mine, theirs, after = written(F.col("n_units"), F.col("ident"), F.col("lanes")), written(F.col("e.n_units"), F.col("e.ident"), F.col("e.lanes")), written(F.col("x.n_units"), F.col("x.ident"), F.col("x.lanes"))
    near = lambda other, fp: F.when(fp == F.col("fingerprint"), 1.0).otherwise(likeness(F.col("n_units"), F.col("lanes"), F.col(f"{other}.n_units"), F.col(f"{other}.lanes")))
    out = met.withColumns({"fingerprint": mine, "edited_fingerprint": theirs, "_after": after})
    return out.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("e", F.col("edited_fingerprint")).alias("near_edited"), near("x", F.col("_after")).alias("near_next"))


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"

"""Near-duplicates at a Jaccard similarity, found by Golay keys of wide SimHash fingerprints and checked on the texts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.components import components
from lumaframe.llm.memo import claim
from lumaframe.llm.shared import broadcast_if_small, checkpointed, fresh, small_batches, thinned, without
from lumaframe.llm.shingle_sets import compared, row_mark, scattered, shingle_sets
from lumaframe.llm.simhash import CHECKS, LENGTH, golay, syndromes

#: 64-bit words of a fingerprint, and its segments of a codeword's length.
WORDS = 12
SEGMENTS = 64 * WORDS // LENGTH
#: Codewords are sought with every change of a segment's so many least certain bits; the NEAREST ones make keys.
UNCERTAIN, NEAREST = 4, 2
#: Share of pairs just at the similarity that may meet in no key.
MISS = 0.001
#: A key has so many bits less than the number of rows has: about 2 ** FEWER rows meet in a key by chance. Bits more would need keys more.
FEWER = 10
#: Segments that make keys of two whole codewords, by which groups of copies are joined first.
STARS = 8
#: Fingerprints are let through to the check of the texts up to so many deviations over the bits that differ on average at the
#: limit; SMALL / n of the bits more for sets of n shingles, as a few shingles make no normal sums. FIRST: the same for the first words alone.
DEVIATIONS, FIRST, SMALL = 3.2, (4, 3.6), 0.18
#: Keys with more rows than DENSE are dealt out to blocks of BLOCK rows, every two of which meet.
DENSE, BLOCK = 1 << 14, 1 << 13
#: Classes with more texts than this aren't laid against themselves there.
LARGE = 1024
#: Rows of a group that are laid against others at once, and bytes of texts of a side in a meeting of the check.
LAID, CHECKED = 512, 2 << 20
CHUNK = 1 << 15


class Keys(NamedTuple):
    """How many keys, and further bits of each, for so many rows."""

    number: int
    plain: int
    star_plain: int


def apart(share: float) -> float:
    """Share of a fingerprint's bits that differ on average in sets of a Jaccard similarity."""
    return math.acos(min(1.0, 2 * share / (1 + share))) / math.pi


def wide(hashes: np.ndarray) -> np.ndarray:
    """(WORDS, n) 64-bit hashes from n of them."""
    factors = scattered(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        z = hashes[None, :] * factors[:, None]
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
    return z


def counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the shingles' wide hashes set each bit, added in bit planes."""
    total = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        rows, weight = wide(hashes[i : i + CHUNK]), 1
        while rows.shape[1]:
            carries = []
            while rows.shape[1] > 1:
                k = rows.shape[1] // 3
                if k:
                    a, b, c = rows[:, :k], rows[:, k : 2 * k], rows[:, 2 * k : 3 * k]
                    half = a ^ b
                    carries.append(a & b | half & c)
                    half ^= c
                    rows = np.concatenate([half, rows[:, 3 * k :]], axis=1)
                else:
                    carries.append(rows[:, :1] & rows[:, 1:])
                    rows = rows[:, :1] ^ rows[:, 1:]
            total += weight * np.unpackbits(np.ascontiguousarray(rows[:, 0]).view(np.uint8), bitorder="little").astype(np.int64)
            rows, weight = np.concatenate(carries, axis=1) if carries else rows[:, :0], 2 * weight
    return total


def codewords(margins: np.ndarray) -> np.ndarray:
    """Indices of the NEAREST codewords of segments, by the bits' margins (rows of LENGTH); -1 where none is left.

    Every change of the least certain bits is decoded; a codeword's distance is the sum of the margins it overrules.
    """
    certain = np.abs(margins)
    word = (margins > 0) @ (1 << np.arange(LENGTH))
    weak = np.argsort(certain, axis=1, kind="stable")[:, :UNCERTAIN]
    least, found = golay()[1], []
    for k in range(1 << UNCERTAIN):
        changed = word.copy()
        for j in range(UNCERTAIN):
            if k >> j & 1:
                changed ^= 1 << weak[:, j]
        found.append(changed ^ least[syndromes(changed)])
    found = np.stack(found, axis=1)
    away = np.zeros(found.shape, np.int64)
    for i in range(LENGTH):
        away += (((found ^ word[:, None]) >> i) & 1) * certain[:, i : i + 1]
    away = away << LENGTH | found  # ties: the lesser codeword
    out = np.full((len(margins), NEAREST), -1, np.int64)
    never = np.iinfo(np.int64).max
    for j in range(NEAREST):
        best = away.min(axis=1)
        left = best < never
        out[left, j] = (best[left] & ((1 << LENGTH) - 1)) >> CHECKS
        away[away == best[:, None]] = never
    return out


@lru_cache(maxsize=8)
def meeting(share: float) -> float:
    """How often sets of this similarity share one of a segment's codewords, from 8,000 made pairs."""
    rng, c = np.random.default_rng(7), 2 * share / (1 + share)
    x, y = rng.normal(size=(2, 8000, LENGTH))
    a, b = (codewords(np.rint(1e4 * m).astype(np.int64)) for m in (x, c * x + math.sqrt(1 - c * c) * y))
    return float(((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).mean())


def keys_for(rows: int, share: float) -> Keys:
    """Keys grow slowly with the number of rows, so that chance meetings stay in proportion and recall stays as it is."""
    bits = math.ceil(math.log2(max(rows, 2)))
    plain = min(LENGTH, max(0, bits - FEWER - 12))
    met = meeting(share) * (1 - apart(share)) ** plain
    return Keys(math.ceil(math.log(MISS) / math.log1p(-met)), plain, min(LENGTH, max(0, bits + 6 - 24)))


def keys_of(margins: np.ndarray, how: Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, number * NEAREST) keys, -1 for none, (rows, STARS) keys of two codewords, and (rows, number * 3) bytes: the codewords of each key."""
    n = len(margins)
    segments = margins[:, : SEGMENTS * LENGTH].reshape(n, SEGMENTS, LENGTH)
    used = max(2 * STARS, min(how.number, SEGMENTS))
    near = codewords(segments[:, :used].reshape(-1, LENGTH)).reshape(n, used, NEAREST)
    shown = ((segments > 0) @ (1 << np.arange(LENGTH))).astype(np.int64)
    keys = np.empty((n, how.number, NEAREST), np.int64)
    for k in range(how.number):
        key = k << 40 | near[:, k % SEGMENTS] << 24 | (shown[:, beside(k)] & ((1 << how.plain) - 1))[:, None]
        keys[:, k] = np.where(near[:, k % SEGMENTS] >= 0, key, -1)
    stars = np.empty((n, STARS), np.int64)
    for k in range(STARS):
        more = shown[:, (2 * k + SEGMENTS // 2) % SEGMENTS] & ((1 << how.star_plain) - 1)
        stars[:, k] = k << 50 | near[:, 2 * k, 0] << 36 | near[:, 2 * k + 1, 0] << 24 | more
    first = near[:, np.arange(how.number) % SEGMENTS]
    first = (first[:, :, 0] | np.where(first[:, :, 1] < 0, first[:, :, 0], first[:, :, 1]) << 12).astype("<u4")
    return keys.reshape(n, -1), stars, np.ascontiguousarray(first).view(np.uint8).reshape(n, -1, 4)[:, :, :3].reshape(n, -1)


def beside(k: int) -> int:
    """The segment that lends key k its plain bits."""
    return (k + SEGMENTS // 2 + k // SEGMENTS) % SEGMENTS


def listed(rows: np.ndarray) -> pa.ListArray:
    """A list of each row's numbers but the negative ones."""
    kept = rows >= 0
    offsets = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[kept]))


PRINTS = "doc_id long, row long, mark long, id long, n int, fp binary, keys array<long>, stars array<long>"


def printed(batches: Iterable[pa.RecordBatch], shingle: int, how: Keys) -> Iterator[pa.RecordBatch]:
    import xxhash

    claim("")
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            ids, sizes, margins = [], [], np.zeros((batch.num_rows, 64 * WORDS), np.int64)
            for i, s in enumerate(shingle_sets(batch.column(1), shingle)):
                ids.append(int.from_bytes(xxhash.xxh64_digest(s.tobytes()), "little", signed=True))
                sizes.append(len(s))
                margins[i] = 2 * counts(s) - len(s)
            keys, stars, near = keys_of(margins, how)
            prints = np.concatenate([np.packbits(margins > 0, axis=1, bitorder="little"), near], axis=1)
            none = np.array(sizes) == 0  # all such rows are one node
            keys[none], stars[none] = -1, -1
            arrays = [batch.column(0), batch.column(2), batch.column(3), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array([p.tobytes() for p in prints], pa.binary()), listed(keys), listed(stars)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PRINTS.split(", ")])


def most_apart(sizes: np.ndarray, share: float, words: int = WORDS, deviations: float = DEVIATIONS) -> np.ndarray:
    """Bits of whole fingerprints, or of their first words, that may differ in sets of these sizes."""
    p, bits = apart(share), 64 * words
    return np.rint(bits * (p + SMALL / np.maximum(sizes, 1)) + deviations * math.sqrt(bits * p * (1 - p))).astype(np.int16)


class Group(NamedTuple):
    """Rows that share a key (or two blocks of them): fingerprints, and the codewords of each row's keys."""

    key: int
    side: np.ndarray
    ids: np.ndarray
    roots: np.ndarray
    sizes: np.ndarray
    prints: np.ndarray
    near: np.ndarray

    def some(self, rows: slice) -> Group:
        return Group(self.key, *(c[rows] for c in self[1:]))


def forest(g: Group, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Near rows of different classes, nearest first, as many as connect them. Of more than LAID rows so many at once, each time with the first."""
    a, b = [], []
    for at in range(1, len(g.ids), LAID):
        rows = np.concatenate([[0], np.arange(at, min(at + LAID, len(g.ids)))])
        label = np.unique(g.roots[rows], return_inverse=True)[1]
        far = np.zeros((len(rows), len(rows)), np.int16)
        for k in range(WORDS):
            far += np.bitwise_count(g.prints[rows, k][:, None] ^ g.prints[rows, k][None, :])
        small, large = np.minimum.outer(g.sizes[rows], g.sizes[rows]), np.maximum.outer(g.sizes[rows], g.sizes[rows])
        x, y = np.nonzero(np.triu((far <= most_apart(small, share)) & (small >= share * large - 1e-6) & (label[:, None] != label[None, :]), 1))
        order = np.argsort(far[x, y], kind="stable")
        x, y = x[order], y[order]
        while len(x):
            a.append(g.ids[rows[x[0]]])
            b.append(g.ids[rows[y[0]]])
            label[label == label[x[0]]] = label[y[0]]
            left = label[x] != label[y]
            x, y = x[left], y[left]
    return np.array(a, np.int64), np.array(b, np.int64)


def crossing(g: Group, share: float, how: Keys) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near rows of different classes, in the least of the keys that they share, some at a time, nearest first. Blocks meet, or one block itself."""
    left = np.flatnonzero(g.side == 0)
    right = np.flatnonzero(g.side == 1) if g.side.any() else left
    words, deviations = FIRST
    first = most_apart(g.sizes, share, words, deviations)
    for i in range(0, len(left), LAID):
        mine, others = left[i : i + LAID], right[i:] if right is left else right
        far = np.zeros((len(mine), len(others)), np.int16)
        for k in range(words):
            far += np.bitwise_count(g.prints[mine, k][:, None] ^ g.prints[others, k][None, :])
        x, y = np.nonzero(far <= np.maximum(first[mine][:, None], first[others][None, :]))
        x, y = mine[x], others[y]
        good = g.roots[x] != g.roots[y]
        if right is left:
            good &= x < y
        x, y = x[good], y[good]
        for j in range(0, len(x), 1 << 16):
            a, b = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
            small, large = np.minimum(g.sizes[a], g.sizes[b]), np.maximum(g.sizes[a], g.sizes[b])
            away = np.bitwise_count(g.prints[a] ^ g.prints[b]).sum(axis=1, dtype=np.int16)
            good = np.flatnonzero((away <= most_apart(small, share)) & (small >= share * large - 1e-6))
            good = good[np.argsort(away[good], kind="stable")]
            a, b = a[good], b[good]
            if len(a):
                good = ~met_before(g, a, b, how)
                yield g.ids[a[good]], g.ids[b[good]]


def met_before(g: Group, a: np.ndarray, b: np.ndarray, how: Keys) -> np.ndarray:
    """Whether the pairs share a lesser key than the group's."""
    own, codeword = g.key >> 40, g.key >> 24 & 0xFFF
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    packed = g.near[rows].reshape(len(rows), -1, 3).astype(np.int64)
    packed = packed[:, :, 0] | packed[:, :, 1] << 8 | packed[:, :, 2] << 16
    two = np.stack([packed & 0xFFF, packed >> 12], axis=2)
    before = np.zeros(len(a), bool)
    bits = np.unpackbits(np.ascontiguousarray(g.prints[rows]).view(np.uint8), axis=1, bitorder="little") if how.plain else None
    for k in range(own + 1):
        same = np.zeros(len(a), bool)
        for i in range(2):
            for j in range(2):
                same |= (two[a, k, i] == two[b, k, j]) & ((k < own) | (two[a, k, i] < codeword))
        if how.plain and k < own:
            plain = bits[:, beside(k) * LENGTH :][:, : how.plain]
            same &= (plain[a] == plain[b]).all(axis=1)
        before |= same
    return before


def grouped(batches: Iterable[pa.RecordBatch], most: int = 1 << 62) -> Iterator[Group]:
    """Runs of rows with one meet, of two rows or more; runs of over most rows in parts, each with the first row."""
    held: list[pa.RecordBatch] = []

    def group(rows: pa.Table | pa.RecordBatch) -> Group:
        width = len(rows.column("fp")[0].as_py())
        prints = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint8).reshape(-1, width)
        ids, roots = rows.column("id").to_numpy(), rows.column("root").to_numpy()
        return Group(rows.column("key")[0].as_py(), rows.column("side").to_numpy(), ids, roots, rows.column("n").to_numpy(), np.ascontiguousarray(prints[:, : 8 * WORDS]).view("<u8"), prints[:, 8 * WORDS :])

    def runs(rows: pa.Table, ends: bool) -> Iterator[Group]:
        meet = rows.column("meet").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], meet[1:] != meet[:-1]]))
        last = len(meet) if ends else int(starts[-1])
        held[:] = rows.slice(last).to_batches()
        if last:
            whole = group(rows.slice(0, last))
            key = rows.column("key").to_numpy()
            for a, b in zip(starts, [*starts[1:], len(meet)], strict=True):
                if b <= last and b - a > 1:
                    yield whole.some(slice(int(a), int(b)))._replace(key=int(key[a]))

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch])
            if held and rows.num_rows > most and rows.column("meet")[0] == rows.column("meet")[-1]:
                yield group(rows)
                held[:] = rows.slice(0, 1).to_batches()
            else:
                yield from runs(rows, False)
    if held:
        yield from runs(pa.Table.from_batches(held), True)


#: Pairs as lists: a row, its class, its partners and their classes.
LISTS = "a long, root long, bs array<long>, roots array<long>"


def lists(g: Group, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs as LISTS, in their order: those of the row whose class has fewer rows here. So an entry makes few rows, whatever its pairs."""
    order = np.argsort(g.ids, kind="stable")
    ids, roots = g.ids[order], g.roots[order]
    number = np.unique(roots, return_inverse=True, return_counts=True)
    number = number[2][number[1]]
    for a, b in pairs:
        if not len(a):
            continue
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        turn = (number[a] > number[b]) | (number[a] == number[b]) & (ids[a] > ids[b])
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        order = np.argsort(a, kind="stable")
        own, first = np.unique(a[order], return_index=True)
        offsets, b = pa.array(np.append(first, len(b)).astype(np.int32)), b[order]
        arrays = [pa.array(ids[own]), pa.array(roots[own])] + [pa.ListArray.from_arrays(offsets, pa.array(x[b])) for x in (ids, roots)]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in LISTS.split(", ")])


def met(batches: Iterable[pa.RecordBatch], share: float, how: Keys, every: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of the groups whose texts are to be compared, as LISTS."""
    claim("")
    for g in grouped(batches) if every else grouped(batches, 16 * LAID):
        yield from lists(g, crossing(g, share, how) if every else [forest(g, share)])


def entries(nodes: DataFrame, keys: str) -> DataFrame:
    return nodes.where(F.size(keys) > 0).select(F.explode(keys).alias("key"), "id", "root", "n", "fp").withColumns({"meet": F.col("key"), "side": F.lit(0)})


def meetings(seated: DataFrame, share: float, how: Keys, every: bool) -> DataFrame:
    """LISTS of what the rows that share a meeting make; these are dealt out by it once. The same list may come more than once."""
    rows = seated.select("meet", "key", "side", "id", "root", "n", "fp").repartition("meet").sortWithinPartitions("meet", "side", "id")
    return checkpointed(rows.mapInArrow(partial(met, share=share, how=how, every=every), LISTS))


def crossing_pairs(nodes: DataFrame, share: float, how: Keys) -> DataFrame:
    """LISTS of near rows of different classes that share a key. The rows of a key that more than DENSE have are dealt out to
    blocks, and every two blocks meet by themselves, so no task holds more than two; blocks of one large class don't meet each other."""
    seated = entries(nodes, "keys")
    dense = checkpointed(seated.groupBy("key").count().where(F.col("count") > DENSE).select("key"))
    if dense.isEmpty():
        return meetings(seated, share, how, every=True)
    large = nodes.where("root <> id").groupBy("root").count().where(F.col("count") >= LARGE).select("root", F.col("root").alias("space"))
    inside = nodes.join(broadcast_if_small(checkpointed(large)), "root", "left").withColumn("space", F.coalesce("space", F.lit(0)))
    inside = inside.withColumn("key", F.explode("keys")).join(broadcast_if_small(dense), "key", "left_semi").drop("keys")
    sizes = checkpointed(inside.groupBy("key", "space").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    parts = sizes.select("key", "space", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("key", F.struct("space", "i").alias("part"))
    meets = parts.withColumnRenamed("part", "p").join(parts.withColumnRenamed("part", "q"), "key").where("p <= q and (p.space <> q.space or p.space = 0)")
    meets = checkpointed(meets)
    of = inside.join(broadcast_if_small(sizes), ["key", "space"]).withColumn("part", F.struct("space", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("i")))
    sides = F.array(F.struct(F.col("p").alias("part"), F.lit(0).alias("side")), F.struct(F.col("q").alias("part"), F.lit(1).alias("side")))
    seats = meets.withColumn("seat", F.explode(F.when(F.col("p") == F.col("q"), F.slice(sides, 1, 1)).otherwise(sides))).select("key", F.col("seat.part").alias("part"), F.xxhash64("key", "p", "q").alias("meet"), F.col("seat.side").alias("side"))
    dealt = of.join(broadcast_if_small(checkpointed(seats)), ["key", "part"])
    light = seated.join(broadcast_if_small(dense), "key", "left_anti")
    return meetings(light, share, how, every=True).unionByName(meetings(dealt, share, how, every=True))


def placed(batches: Iterable[pa.RecordBatch], sides: int) -> Iterator[pa.RecordBatch]:
    """LISTS with the meeting of two sides, and the first partner as b; partners of different sides are different rows."""
    side = lambda x: (scattered(x.astype(np.uint64)) % np.uint64(sides)).astype(np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, root, bs, roots = (batch.column(c) for c in ("a", "root", "bs", "roots"))
        owner = np.repeat(np.arange(batch.num_rows), np.asarray(bs.value_lengths()))
        a, root, bs, roots = a.to_numpy(), root.to_numpy(), bs.flatten().to_numpy(), roots.flatten().to_numpy()
        mine, other = side(a)[owner], side(bs)
        order = np.argsort(owner * sides + other, kind="stable")
        owner, other, bs, roots = owner[order], other[order], bs[order], roots[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])]))
        meet = np.minimum(mine, other)[first] * sides + np.maximum(mine, other)[first]
        offsets = pa.array(np.append(first, len(bs)).astype(np.int32))
        own = owner[first]
        arrays = [pa.array(x) for x in (meet, a[own], bs[first], root[own])] + [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (bs, roots)]
        yield pa.RecordBatch.from_arrays(arrays, ["meet", "a", "b", "root", "bs", "roots"])


def seats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """meet, id: the rows of lists, each once a meeting and batch. Without meetings all are one, 0."""
    for batch in batches:
        a, bs = batch.column("a").to_numpy(), batch.column("bs")
        meet = batch.column("meet").to_numpy() if "meet" in batch.schema.names else np.zeros(len(a), np.int64)
        meet, ids = np.concatenate([meet, np.repeat(meet, np.asarray(bs.value_lengths()))]), np.concatenate([a, bs.flatten().to_numpy()])
        order = np.lexsort((ids, meet))
        meet, ids = meet[order], ids[order]
        new = np.concatenate([[True], (meet[1:] != meet[:-1]) | (ids[1:] != ids[:-1])])[: len(ids)]
        yield pa.RecordBatch.from_arrays([pa.array(meet[new]), pa.array(ids[new])], ["meet", "id"])


SEATS = "meet long, id long"


def handed(whole: DataFrame, pairs: DataFrame, sides: int) -> DataFrame:
    """meet, a, b, root, bs, roots, text: the pairs, without texts, and the texts (id, text) of each meeting of two sides, b being null.

    pairs: LISTS, or a, b. A text is in so many meetings at most.
    """
    if "bs" not in pairs.columns:
        pairs = pairs.select("a", F.col("a").alias("root"), F.array("b").alias("bs"), F.array("b").alias("roots"))
    met = checkpointed(pairs.mapInArrow(partial(placed, sides=sides), f"meet long, a long, b long, {LISTS[8:]}"))
    given = broadcast_if_small(checkpointed(met.mapInArrow(seats, SEATS).distinct()))
    given = whole.join(given, "id").select("meet", F.col("id").alias("a"), "text")
    return met.withColumn("text", F.lit(None).cast("string")).unionByName(given, allowMissingColumns=True)


def verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, share: float) -> DataFrame:
    """a, b: of the pairs (LISTS) those whose sets are similar enough, by their texts, as many as connect the classes. texts: text, mark (a hash of it).

    Texts are dealt out to sides, and each two sides with a pair meet: a text goes once to each meeting in which it has pairs, not once a pair.
    """
    ends = checkpointed(pairs.mapInArrow(seats, SEATS).select("id").distinct().join(nodes.select("id", "mark"), "id"))
    whole = thinned(texts, "mark", ends).join(broadcast_if_small(ends), "mark").dropDuplicates(["id"]).select("id", "text")
    whole = checkpointed(whole)
    sides = max(8, -(-(whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHECKED))
    both = handed(whole, pairs, sides).repartition("meet").sortWithinPartitions("meet", F.col("b").isNotNull(), "a")
    return checkpointed(both.mapInArrow(partial(compared, shingle=shingle, share=share), "a long, b long"))


def similar_classes(docs: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """doc_id, row (see row_mark), root, component_id of every row: classes of documents linked by a Jaccard similarity of share or more.

    A text's SimHash fingerprint has 64 * WORDS bits, from its set of shingles, repeats counting once. Segments of it
    are decoded to their nearest Golay codewords, uncertain bits first; texts that share a codeword and some further bits
    meet, and those whose fingerprints are near enough are checked on the whole sets. So no link is wrong; a pair just at the limit
    is missed with a chance of about 0.002 (MISS, DEVIATIONS and FIRST; fewer above it), whatever the number of rows: above 4 million, keys get longer
    and more with log2 of it.

    Rows with equal sets are one node. Copies are joined first, by keys of two codewords, of whose rows as many pairs
    are checked as connect them; then rows of different classes that share a key, all of them. Keys with very many rows are laid
    out in blocks. root numbers the classes; component_id is the least doc_id of the documents reachable by links (null only where
    all of them are null). A null text is an empty one, and all texts without words are equal; an empty table gives no rows;
    texts of any length are taken whole; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row_mark().alias("row"), F.xxhash64(text).alias("mark"))
    how = keys_for(docs.count(), share)
    rows = checkpointed(docs.mapInArrow(partial(printed, shingle=shingle, how=how), PRINTS))
    nodes = checkpointed(rows.groupBy("id").agg(F.first(F.struct("mark", "n", "fp", "keys", "stars")).alias("x")).select("id", "x.*"))
    texts = docs.select("text", "mark")

    pairs = meetings(entries(nodes.withColumn("root", F.col("id")), "stars"), share, how, every=False)
    found = verified(texts, nodes, pairs, shingle, share)
    roots = broadcast_if_small(components(found))  # else every row's fingerprint and keys would be shuffled for it
    labelled = nodes.select("id", "n", "fp", "keys").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rest = crossing_pairs(labelled, share, how)
    if not rest.isEmpty():
        roots = components(checkpointed(found.unionByName(verified(texts, nodes, rest, shingle, share))))
    named = checkpointed(rows.groupBy("id").agg(F.min("doc_id").alias("least")).join(roots, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root")))
    tops = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))
    lookup = checkpointed(named.join(tops, "root").select("id", "root", "component_id"))
    return rows.select("doc_id", "row", "id").join(lookup, "id").select("doc_id", "row", "root", "component_id")


def distinct_rows(docs: DataFrame, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """docs with one row of each class of near-duplicates, all columns: that with the least doc_id, or one without if none has any.

    Rows are told apart by doc_id and text, so rows that share a doc_id or have none are judged by their own texts.
    """
    rows = checkpointed(similar_classes(docs, shingle, share))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("best")
    row = fresh("row", docs)
    stays = rows.groupBy("root").agg(best).select(F.col("best.row").alias("row"))
    seen = rows.groupBy("row").count().join(stays.withColumn("stays", F.lit(True)), "row", "left")
    odd = checkpointed(seen.where("stays is null or count > 1"))  # of classes' other rows and repeated ones; all others stay where they are
    marked = docs.withColumn(row, row_mark())
    again = odd.where("stays").select(F.col("row").alias(row))
    once = thinned(marked, row, again).join(again, row).dropDuplicates([row])  # a semi-join would be put below thinned()
    return without(marked, row, odd.select("row")).unionByName(once).select(*[F.col(c) for c in docs.columns])

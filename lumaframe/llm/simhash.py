"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.components import components
from lumaframe.llm.memo import claim
from lumaframe.llm.shared import checkpointed, small_batches

#: The binary Golay code [23, 12, 7] by its generator polynomial, and XXH64's seed in the contract.
LENGTH, CHECKS, GENERATOR = 23, 11, 0b110001110101
SEED = 42
#: Segments of a 64-bit fingerprint: first bit and width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BLOCK = 4096


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the single bits; for each syndrome the least error, and the five errors of weight 4 (or 0)."""

    def remainder(x: int) -> int:
        for i in range(LENGTH - 1, CHECKS - 1, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - CHECKS)
        return x

    bits = np.array([remainder(1 << i) for i in range(LENGTH)])
    least, four, filled = np.zeros(1 << CHECKS, np.int64), np.zeros((1 << CHECKS, 5), np.int64), np.zeros(1 << CHECKS, np.int64)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            syndrome, error = int(np.bitwise_xor.reduce(bits[list(places)])) if places else 0, sum(1 << i for i in places)
            if weight < 4:
                least[syndrome] = error
            else:
                four[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return bits, least, four


def syndromes(x: np.ndarray) -> np.ndarray:
    bits, _, _ = golay()
    out = np.zeros_like(x)
    for i in range(LENGTH):
        out ^= (x >> i & 1) * bits[i]
    return out


def nearest(x: np.ndarray) -> np.ndarray:
    """Index of the one codeword within 3 bits of each 23-bit word: its upper 12 bits."""
    return (x ^ golay()[1][syndromes(x)]) >> CHECKS


def nearby(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in x, index) for every codeword within 4 bits of a word: one, or six if the nearest is 3 bits away.

    Words at most 2 bits apart share one of these: the codeword nearest to a word between them is within 3 bits of
    it, so within 4 of both.
    """
    _, least, four = golay()
    s = syndromes(x)
    at = np.arange(len(x))
    more = four[s]
    rows, cols = np.nonzero(more)
    return np.concatenate([at, rows]), np.concatenate([x ^ least[s], x[rows] ^ more[rows, cols]]) >> CHECKS


def fingerprint(text: str, shingle: int) -> bytes:
    """64 bits, little-endian: a bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(tokens) - shingle + 1)
    starts, stops = (ends - lengths)[:n].tolist(), ends[min(shingle, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):
        block = hashes[i : i + 255, None].view(np.uint8)
        counts += np.add.reduce(np.unpackbits(block, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def fingerprinted(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    claim("")
    for batch in batches:
        prints = [fingerprint(t.as_py() or "", shingle) for t in batch.column(1)]
        ids = [int.from_bytes(p, "little", signed=True) for p in prints]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, id and fp of every row: the fingerprint as a long and as 8 bytes, little-endian; a null text is an empty one."""
    small_batches(docs.sparkSession)
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small.mapInArrow(partial(fingerprinted, shingle=shingle), "doc_id long, id long, fp binary")


def exact_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of 64-bit fingerprints, such that two at most 2 bits apart share a key.

    Of three segments one has no error, and the next segment has at most two: a key is one segment as it is with
    one of the next one's nearby codewords, for each of the three.
    """
    parts = [(prints[:, 0] >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    places, keys = [], []
    for i in range(3):
        at, index = nearby(parts[(i + 1) % 3])
        places.append(at)
        keys.append(np.int64(i) << 34 | parts[i][at] << 12 | index)
    return np.concatenate(places), np.concatenate(keys)


def words_of(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u8").reshape(len(rows), -1)


def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            places, keys = exact_keys(words_of(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.asarray(part.column(0))[places])], ["key", "id"])


def forest(ids: np.ndarray, prints: np.ndarray, side: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs within radius connect: fewer than there are members.

    side: None to compare all with all, otherwise only members of side 0 with those of side 1.
    """
    every, out = np.arange(len(ids)), []
    left, right = (every, every) if side is None else (every[side == 0], every[side == 1])
    label = every.copy()  # the least place that is known to be connected
    for i in range(0, len(left), 256):
        mine = left[i : i + 256]
        far = np.zeros((len(mine), len(right)), np.uint16)
        for k in range(prints.shape[1]):
            far += np.bitwise_count(prints[mine, k][:, None] ^ prints[right, k][None, :])
        near = far <= radius
        for x, row in zip(mine, near, strict=True):
            labels = label[right[row]]
            if not len(labels) or (labels == label[x]).all():
                continue
            labels = np.unique(np.append(labels, label[x]))
            out += [(int(ids[y]), int(ids[labels[0]])) for y in labels[1:]]
            label[np.isin(label, labels[1:])] = labels[0]
    return out


def bucketed(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket; rows come sorted by (key, a, b), side tells the two blocks of a split bucket apart."""
    held: list[tuple] = []

    def done() -> list[tuple[int, int]]:
        ids = np.array([r[3] for r in held], np.int64)
        return forest(ids, ids.view(np.uint64)[:, None], None if held[0][1] == held[0][2] else np.array([r[4] for r in held]), radius)

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    for batch in batches:
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "id", "side")), strict=True):
            if held and held[0][:3] != row[:3]:
                found += done()
                held = []
            held.append(row)
        yield out(found)
    if held:
        yield out(done())


def links(prints: DataFrame, radius: int) -> DataFrame:
    """a, b: links between ids of fingerprints that share a key and are at most radius bits apart.

    prints: id, fp, distinct and written. Only a forest of a bucket's links is made, never all its pairs. Buckets
    with the same members are compared once. A bucket of over BLOCK members is dealt out by blocks: every two of
    its blocks meet in a bucket of their own, so no task holds more than two blocks and no pair is left out. A bucket
    of two is settled by its ids, which are the fingerprints.
    """
    keys = prints.select("id", "fp").mapInArrow(keyed, "key long, id long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("mark")).where("n > 1")
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("high")))
    sizes = sizes.where((F.col("n") > 2) | (apart <= radius))
    kept = checkpointed(sizes.groupBy("n", "low", "high", "mark").agg(F.min("key").alias("key")))
    sure = kept.where("n = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("mine")).alias("a"), F.greatest(j, F.col("mine")).alias("b"), F.when(j < F.col("mine"), 1).otherwise(0).alias("side")))
    more = keys.join(kept.where("n > 2").select("key", blocks.alias("blocks")), "key").withColumn("mine", mine)
    members = more.withColumn("m", F.explode(meets)).select("key", "m.a", "m.b", "id", "m.side")
    ordered = members.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side", "id")
    return sure.unionByName(ordered.mapInArrow(partial(bucketed, radius=radius), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (binary), component_id of every row: the classes of documents whose 64-bit fingerprints link.

    Fingerprints at most radius bits apart (2 at most) link; each such pair shares a Golay key, so none is lost.
    component_id is the least doc_id of the documents reachable by links, the row's own included (null only where
    all of them are null). Equal fingerprints are one node, whatever their number. A document without words
    has fingerprint zero and links like any other; a null text is an empty one, texts of any length are taken whole; rows with
    equal or null doc_id stay apart; an empty table gives no rows; other columns are ignored.
    """
    if not 0 <= radius <= 2:
        raise ValueError("fingerprints are compared at 2 bits or fewer")
    rows = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(rows.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")))
    found = checkpointed(links(classes, radius).distinct())
    roots = components(found)
    named = checkpointed(classes.select("id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    tops = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that the join can split a large class
    lookup = checkpointed(named.join(tops, "root").select("id", "component_id"))
    return rows.join(lookup, "id").select("doc_id", "fp", "component_id")

"""Join-like operators on descriptors, hashes and boxes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumaframe.errors import require
from lumaframe.functions.distance import iou

#: Bytes of queries that are sent to the tasks at once.
SENT = 32 << 20
#: Ranges of a hash, and hashes of a block, in the search for near pairs.
PARTS, WORDS_MET = 4, 1 << 17


def per(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def nearest(query: DataFrame, train: DataFrame, k: int, metric: str = "l2", but_itself: bool = False) -> DataFrame:
    """q, t, d, rank: the k nearest rows of train for every row of query; both (id, vec). Ties: least t.

    Exact. The queries are a stated set, which is laid against all rows block by block: each block of at most SENT bytes
    goes to the tasks, one pass over train lays it against Arrow batches, and a batch keeps k rows a query before anything is
    shuffled. but_itself: rows with the query's own id aren't its neighbours. Rows without a vector have none.
    """
    require(k > 0, "k must be over 0")
    require(metric in ("l2", "hamming"), "metric must be l2 or hamming")
    kind = "double" if metric == "l2" else "long"
    query, train = (df.where(F.col("vec").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vec").cast(f"array<{kind}>").alias("vec")) for df in (query, train))
    n, width = query.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    parts = max(1, -(-n * (width + 1) * 8 // SENT))
    found = None
    for p in range(parts):
        rows = query.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).collect() if n else []
        ids = np.array([r[0] for r in rows], np.int64)
        vectors = np.array([r[1] for r in rows], np.float64 if metric == "l2" else np.int64).reshape(len(rows), -1)
        block = train.mapInArrow(partial(_nearest_of_batches, ids=ids, vectors=vectors, k=k, but_itself=but_itself), "q long, t long, d double")
        found = block if found is None else found.unionByName(block)
    order = Window.partitionBy("q").orderBy("d", "t")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_of_batches(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray, k: int, but_itself: bool) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of each batch for every query; a task keeps the best k of its batches so far."""
    best_d, best_t = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
    for whole in batches:
        for at in range(0, whole.num_rows if len(ids) else 0, 1024):
            batch = whole.slice(at, 1024)
            t, flat = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten())
            rows = flat.reshape(len(t), -1)
            for i in range(0, len(ids), 64):
                mine = vectors[i : i + 64]
                if vectors.dtype.kind == "f":
                    d = np.zeros((len(mine), len(t)))
                    for c in range(mine.shape[1]):
                        d += (mine[:, c, None] - rows[None, :, c]) ** 2
                    d = np.sqrt(d)
                else:
                    d = np.zeros((len(mine), len(t)))
                    for c in range(mine.shape[1]):
                        d += np.bitwise_count(mine[:, c, None] ^ rows[None, :, c])
                if but_itself:
                    d[ids[i : i + 64, None] == t[None, :]] = np.inf
                d = np.concatenate([best_d[i : i + 64], d], axis=1)
                who = np.concatenate([best_t[i : i + 64], np.broadcast_to(t, (len(mine), len(t)))], axis=1)
                order = np.lexsort((who, d), axis=1)[:, :k]
                best_d[i : i + 64], best_t[i : i + 64] = np.take_along_axis(d, order, 1), np.take_along_axis(who, order, 1)
    some = np.isfinite(best_d)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[some]), pa.array(best_t[some]), pa.array(best_d[some])], ["q", "t", "d"])


def match_bf(query: DataFrame, train: DataFrame, metric: str = "l2", cross_check: bool = False, max_distance: float = 0, but_itself: bool = False) -> DataFrame:
    """q, t, d: the nearest row for each query; with cross_check only where each is the other's nearest.

    max_distance 0 is no limit; otherwise matches at that distance or under stay.
    """
    require(max_distance >= 0, "max_distance must be 0 or more")
    best = nearest(query, train, 1, metric, but_itself).select("q", "t", "d")
    if cross_check:
        back = nearest(train.join(best.select(F.col("t").alias("id")).distinct(), "id", "left_semi"), query, 1, metric, but_itself).select(F.col("q").alias("t"), F.col("t").alias("q"))
        best = best.join(back, ["q", "t"])
    return best.where(F.col("d") <= max_distance) if max_distance else best


def match_ratio(query: DataFrame, train: DataFrame, ratio: float = 0.7, but_itself: bool = False) -> DataFrame:
    """q, t, d where the nearest row is nearer than ratio times the next; a query with one neighbour has no match."""
    require(0 < ratio <= 1, "ratio must be over 0 and at most 1")
    two = nearest(query, train, 2, "l2", but_itself)
    next_d = F.lead("d").over(Window.partitionBy("q").orderBy("rank"))
    return two.withColumn("n", next_d).where((F.col("rank") == 1) & F.col("n").isNotNull() & (F.col("d") < F.lit(ratio) * F.col("n"))).select("q", "t", "d")


def hamming_pairs(df: DataFrame, key: str, word: str, radius: int) -> DataFrame:
    """a, b, d with a < b: all pairs of 64-bit hashes at most radius bits apart. Rows without a hash have none.

    The hashes are dealt out to blocks of at most WORDS_MET on average, and every two blocks meet in a task. There, by the pigeonhole
    principle, two hashes within radius have at most radius // PARTS bits apart in one of PARTS ranges: the rows of one side are
    sorted by a range and looked up by each change of so few bits, if that is less than laying all against all.
    For many rows of one hash give the distinct hashes as rows (key and word the same column): all pairs of equal rows are
    the square of their number.
    """
    require(0 <= radius < 64, "radius must be from 0 to 63")
    rows = df.where(F.col(word).isNotNull()).select(F.col(key).alias("id"), F.col(word).cast("long").alias("h"))
    n = rows.count()
    blocks = max(1, -(-n // WORDS_MET), min(8, n // 2048))
    own, other = F.pmod(F.xxhash64("h", "id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    seats = rows.withColumn("own", own.cast("int")).select("id", "h", "own", other.alias("other"))
    seats = seats.select((F.least("own", "other") * F.lit(blocks).cast("long") + F.greatest("own", "other")).alias("meet"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "h")
    kind = df.schema[key].dataType.simpleString()
    met = seats.repartition(blocks * (blocks + 1) // 2, "meet").sortWithinPartitions("meet", "side").mapInArrow(partial(_hashes_met, radius=radius, blocks=blocks), f"x {kind}, y {kind}, d int")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d").where("a < b")


def _hashes_met(batches: Iterator[pa.RecordBatch], radius: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """The near pairs of each meeting; a task holds the two blocks of one."""
    held: list[pa.RecordBatch] = []

    def pairs() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        held.clear()
        side, h, ids = rows.column("side").to_numpy(), rows.column("h").to_numpy().view(np.uint64), rows.column("id").combine_chunks()
        meet = rows.column("meet")[0].as_py()
        alone = meet // blocks == meet % blocks
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        for x, y in _near(h, left, right, radius):
            if alone:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(np.bitwise_count(h[x] ^ h[y]).astype(np.int32))], ["x", "y", "d"])

    for batch in batches:
        meet = batch.column("meet").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], meet[1:] != meet[:-1]])) if len(meet) else []
        for a, b in zip(starts, [*starts[1:], len(meet)], strict=True):
            if held and held[0].column("meet")[0].as_py() != meet[a]:
                yield from pairs()
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield from pairs()


def _near(h: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of left and right within radius, each once."""
    bits, most = 64 // PARTS, radius // PARTS
    changes = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)] if most < 4 else []
    if not changes or len(changes) * PARTS > len(right):  # all against all
        step = max(1, (1 << 20) // max(1, len(right)))
        for i in range(0, len(left), step):
            x, y = np.nonzero(np.bitwise_count(h[left[i : i + step], None] ^ h[right][None, :]) <= radius)
            yield left[i + x], right[y]
        return
    part = lambda words, p: (words >> np.uint64(bits * p)) & np.uint64((1 << bits) - 1)
    for p in range(PARTS):
        value = part(h[right], p).astype(np.int64)
        order = np.argsort(value, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << bits))])
        mine, there, sought = part(h[left], p).astype(np.int64), right[order], h[right][order]
        for change in changes:
            first = at[mine ^ change]
            ends = np.cumsum(at[(mine ^ change) + 1] - first)
            i = 0
            while i < len(left):  # some rows at once, whatever the size of a value's run
                base = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
                count = np.diff(ends[i:j], prepend=base)
                for lo in range(0, int(count.sum()), 1 << 22):
                    pos = np.arange(lo, min(lo + (1 << 22), int(count.sum())))
                    row = np.searchsorted(np.cumsum(count), pos, "right") if lo or len(count) == 1 else np.repeat(np.arange(len(count)), count)[: len(pos)]
                    spot = first[i:j][row] + pos - (np.cumsum(count) - count)[row]
                    differ = h[left[i:j]][row] ^ sought[spot]
                    good = np.bitwise_count(differ) <= radius
                    for q in range(p):  # in the first range that lets them meet
                        good[good] = np.bitwise_count(part(differ[good], q)) > most
                    if good.any():
                        yield left[i:j][row[good]], there[spot[good]]
                i = j


def nms(boxes: DataFrame, by: list[str], order: list[Column | str], threshold: float) -> DataFrame:
    """Greedy suppression in each group, whatever the class: in the given order, a box stays if no box that stayed
    overlaps it by over the threshold. Coordinates are cut to whole numbers first.

    A fold over the group's boxes in their order, in the JVM; a group is what one image holds.
    """
    require(0 <= threshold <= 1, "threshold must be from 0 to 1")
    whole = [F.col(c).cast("int").alias(c) for c in "xywh"]
    others = [c for c in boxes.columns if c not in ("x", "y", "w", "h")]
    ranked = boxes.select(*others, *whole).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    rest = [c for c in ranked.columns if c not in by and c != "_r"]
    gathered = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_r", *rest))).alias("_b"))

    def step(kept: Column, box: Column) -> Column:
        clash = F.exists(kept, lambda k: iou(*[k[c].cast("double") for c in "xywh"], *[box[c].cast("double") for c in "xywh"]) > threshold)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(box)))

    kept = F.aggregate(F.slice("_b", 2, F.size("_b")), F.slice("_b", 1, 1), step)
    return gathered.select(*by, F.explode(kept).alias("_k")).select(*by, *[f"_k.{c}" for c in rest])


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column used at most once; costs must not be negative.

    Shortest augmenting paths with potentials, O(n^2 m) for n rows and m columns, n <= m (transposed otherwise).
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    require(bool((cost >= 0).all()), "costs must not be negative")
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in hungarian(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        reach, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        base = 0.0
        while True:
            through = base + cost[row] - row_price[row] - col_price
            better = ~done & (through < reach)
            reach[better], came[better] = through[better], col
            open_reach = np.where(done, np.inf, reach)
            col = int(open_reach.argmin())
            base = open_reach[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        closed = done & (reach < base)
        row_price[start] += base
        for c in np.flatnonzero(closed):
            row_price[row_of[c]] += base - reach[c]
            col_price[c] -= base - reach[c]
        while col >= 0:
            previous = came[col]
            row_of[col] = start if previous < 0 else row_of[previous]
            col = previous
    return sorted((int(row_of[c]), int(c)) for c in range(m) if row_of[c] >= 0)

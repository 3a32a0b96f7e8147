"""Language-model scoring by an Elias-Fano trie of words, pairs and runs of three words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.elias_fano import TOGETHER, EliasFano, Runs, Several, gathered, load, parts_of, remove, save
from lumaframe.llm.memo import CLEAR, Memo, claim, coded
from lumaframe.llm.shared import checkpointed, shared_dir, small_batches
from lumaframe.llm.shingle_sets import scattered

SEED = 7
END = 1  # the hash of the end of a text; no word is given it
WORDS_HELD = 1_500_000
PAIRS_HELD = 3_000_000
PAIRS_PER_SHARD = 3_000_000
#: log10 probabilities are kept in steps of 1 / 4096, downwards, as 16 bits.
STEP = 4096
BUCKETS = 64
MOST = (1 << 31) - 1
DEALT = "level int, shard long, blob binary"
#: Shards to a file of a manifest, and mapped files that a worker keeps at once.
GROUP, MOST_MAPPED = 1024, 4096
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def hashes_of(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.maximum(np.array([digest(w, SEED) for w in words], np.uint64), np.uint64(END + 1))


Counted = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, lower keys (of three words: the last), counts


def pressed(keys: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys as differences, lower keys and counts, compressed."""
    import zstandard

    planes = lambda x, width: x.view(np.uint8).reshape(-1, width).T.tobytes()  # noqa: E731  bytes of like weight together
    differences = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + planes(differences, 8) + planes(lower.astype("<u4"), 4) + planes(counts.astype("<u4"), 4))


def opened(blob: bytes) -> Counted:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = lambda at, width: np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T).view(f"<u{width}").ravel()
    return np.cumsum(planes(8, 8), dtype=np.uint64), planes(8 + 8 * n, 4), planes(8 + 12 * n, 4).astype(np.int64)


def summed(keys: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> Counted:
    if not len(keys):
        return keys, lower, counts
    order = np.lexsort((lower, keys)) if lower.any() else np.argsort(keys, kind="stable")
    keys, lower, counts = keys[order], lower[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (lower[1:] != lower[:-1])]))
    return keys[first], lower[first], np.add.reduceat(counts, first)


def dealt(found: Counted, shards: np.ndarray, level: int) -> pa.RecordBatch:
    """Sorted keys in blobs, one for each shard they are in."""
    order = np.argsort(shards, kind="stable")
    which, first = np.unique(shards[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    blobs = [pressed(*(x[order[a:b]] for x in found)) for a, b in zip(first.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(which), level), pa.int32()), pa.array(which, pa.int64()), pa.array(blobs, pa.binary())], ["level", "shard", "blob"])


def word_counts(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    parts, ends, held = [], 0, 0

    def out() -> pa.RecordBatch:
        keys, counts = (np.concatenate(x) for x in zip(*parts, (np.array([END], np.uint64), np.array([ends])), strict=True))
        found = summed(keys, np.zeros(len(keys), np.uint32), counts)
        return dealt(found, (found[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found[0]), np.int64), 1)

    for batch in batches:
        for n, codes, words, _ in coded(batch.column(0), "lower"):
            counts = np.bincount(codes, minlength=len(words))
            some = np.flatnonzero(counts)
            parts.append((hashes_of([words[i] for i in some.tolist()]), counts[some]))
            ends += n
            held += len(some)
            if held >= WORDS_HELD:
                yield out()
                parts, ends, held = [], 0, 0
    if ends:
        yield out()


def by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, Counted]]:
    """(level, shard, summed keys) of each shard in turn; rows come sorted by both. Blobs are merged as they pile up."""
    at, parts, size, least = None, [], 0, 1 << 22

    def merged() -> Counted:
        return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    for batch in batches:
        for level, shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (level, shard) != at and parts:
                yield *at, merged()
                parts, size = [], 0
            at = level, shard
            parts.append(opened(blob.as_py()))
            size += len(parts[-1][0])
            if size > least:
                parts = [merged()]
                size = len(parts[0][0])
                least = max(1 << 22, 2 * size)
    if parts:
        yield *at, merged()


def slot(hashes: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """The depth bits that follow the first bits."""
    return (hashes >> np.uint64(64 - bits - depth)).astype(np.int64) & ((1 << depth) - 1) if depth else np.zeros(len(hashes), np.int64)


def word_level(batches: Iterable[pa.RecordBatch], home: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Level 1: a shard's word hashes, and the running sums of their counts, both rising; and where each run of
    about eight hashes with like upper bits begins."""
    for _, shard, (keys, _, counts) in by_shard(batches):
        name, depth = f"{home}/words-{shard}-{uuid.uuid4().hex}", max(0, min(len(keys).bit_length() - 3, 32 - bits))
        runs = np.searchsorted(slot(keys, bits, depth), np.arange((1 << depth) + 1)).astype(np.int32)
        save(name, EliasFano.build(keys, narrowed=True).arrays("hash") | EliasFano.build(np.cumsum(counts)).arrays("sum") | {"runs": runs})
        yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n": len(keys), "total": int(counts.sum())}])


class Files:
    """The files of a level's shards by a manifest in the shared folder, GROUP shards to a file of it; mapped when they are needed."""

    def __init__(self, home: str, level: str, open_: Callable):
        self.home, self.level, self.open = home, level, open_
        self.names: dict[int, dict[int, str]] = {}
        self.held: dict[int, object] = {}

    def __call__(self, shard: int):
        """What open_ makes of the shard's arrays; None if there is no such shard."""
        if shard not in self.held:
            group = shard // GROUP
            if group not in self.names:
                try:
                    listing = load(f"{self.home}/{self.level}-manifest-{group}")
                    ends = np.cumsum(listing["length"])
                    text = bytes(listing["names"])
                    self.names[group] = {int(s): text[e - n : e].decode() for s, e, n in zip(listing["shard"], ends, listing["length"], strict=True)}
                except FileNotFoundError:
                    self.names[group] = {}
            if len(self.held) >= MOST_MAPPED:
                self.held.clear()
            name = self.names[group].get(shard)
            self.held[shard] = self.open(load(name)) if name else None
        return self.held[shard]


def listed(batches: Iterable[pa.RecordBatch], home: str) -> Iterator[pa.RecordBatch]:
    """Writes the manifest files of a level: rows (level, shard, name) come sorted by group."""
    held: list[tuple[str, int, str]] = []

    def done() -> int:
        names = [n.encode() for _, _, n in held]
        arrays = {"shard": np.array([s for _, s, _ in held], np.int64), "length": np.array([len(n) for n in names], np.int64), "names": np.frombuffer(b"".join(names), np.uint8)}
        save(f"{home}/{held[0][0]}-manifest-{held[0][1] // GROUP}", arrays)
        return len(held)

    n = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("level", "shard", "name")), strict=True):
            if held and (held[0][0], held[0][1] // GROUP) != (row[0], row[1] // GROUP):
                n += done()
                held = []
            held.append(row)
    if held:
        n += done()
    yield pa.RecordBatch.from_pydict({"n": [n]})


def write_manifest(rows: DataFrame, home: str) -> int:
    """rows: level, shard, name. The number of files; nothing of them comes to the driver."""
    rows = rows.withColumn("part", F.floor(F.col("shard") / GROUP))
    return rows.repartition("level", "part").sortWithinPartitions("level", "part", "shard").mapInArrow(partial(listed, home=home), "n long").agg(F.sum("n")).first()[0] or 0


class Words:
    """Level 1 of the trie, over its shards: word hashes to ids, which are their ranks, and ids to exact counts."""

    def __init__(self, home: str):
        table = load(f"{home}/words")
        self.bits = int(table["bits"][0])
        self.first, self.shards = np.concatenate([[0], np.cumsum(table["n"])]), np.array(table["shard"])
        self.size, self.total = int(self.first[-1]), int(table["total"].sum())
        self.places = {int(s): k for k, s in enumerate(self.shards)}
        self.file = Files(home, "words", lambda a: (EliasFano.of(a, "hash"), EliasFano.of(a, "sum"), a["runs"]))
        self.memo = Memo(self.look_up)

    def level(self, k: int) -> tuple[EliasFano, EliasFano, np.ndarray]:
        return self.file(int(self.shards[k]))

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        shards = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for s in np.unique(shards).tolist():
            if (k := self.places.get(s)) is None:
                continue
            mine = np.flatnonzero(shards == s)
            level, _, runs = self.level(k)
            which = slot(hashes[mine], self.bits, (len(runs) - 1).bit_length() - 1)
            at = level.find(hashes[mine], runs[which].astype(np.int64), runs[which + 1].astype(np.int64))
            hit = at >= 0
            out[mine[hit]] = self.first[k] + at[hit]
        return out

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts in training; 0 for the id -1."""
        out = np.zeros(len(ids), np.int64)
        which = np.searchsorted(self.first, ids, "right") - 1
        for k in np.unique(which[ids >= 0]).tolist():
            mine = np.flatnonzero((which == k) & (ids >= 0))
            at, sums = ids[mine] - self.first[k], self.level(k)[1]
            out[mine] = (sums[at] - np.where(at > 0, sums[np.maximum(at - 1, 0)], 0)).astype(np.int64)
        return out

    def look_up(self, words: list[bytes]) -> list[int]:
        """Id + 1 and count of each word, in one whole number: counts above, ids in the lower 32 bits; 0 if unknown."""
        if not words:
            return []
        ids = self.ids_of(hashes_of(words))
        return (np.minimum(self.counts_of(ids), MOST) << 32 | ids + 1).tolist()

    def stop(self) -> int:
        """What look_up would give for the end of a text."""
        end = self.ids_of(np.array([END], np.uint64))
        return int((np.minimum(self.counts_of(end), MOST) << 32 | end + 1)[0])

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some texts at a time: what look_up gives for all their words in a row, and where each text begins and the last ends."""
        for _, codes, words, first in coded(column, "lower"):
            yield np.array(self.memo(words), np.int64)[codes] if len(codes) else np.zeros(0, np.int64), first

    def base(self, counts: np.ndarray) -> np.ndarray:
        """The base's log10 probabilities, from counts."""
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.size + 1)))


SEEN: dict[str, object] = {}
CLEAR.append(SEEN.clear)


def kept(key: str, make: Callable):
    """What a worker keeps of one model: its mapped levels and remembered words."""
    claim(f"model {key.removesuffix('/pairs').removesuffix('/triples')}")
    if key not in SEEN:
        SEEN[key] = make()
    return SEEN[key]


def shards2(words: Words, context: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each context of one word: ids are ranks of hashes, so shards hold like numbers of words."""
    return context * shards // words.size


def shards3(words: Words, one: np.ndarray, two: np.ndarray, count: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each context of two words. A word that is frequent (count) has its contexts dealt out to several shards by the
    word before it, so no word's contexts are one shard's."""
    several = np.minimum(shards, count * shards // max(words.total, 1) + 1)
    return (one * shards // words.size + (scattered(two.astype(np.uint64) + np.uint64(1)) % several.astype(np.uint64)).astype(np.int64)) % shards


def contexts_of(found: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each, and the one before that, as look_up gives words; before a text stands its end, twice."""
    one = np.concatenate([[stop], found[:-1]])
    two = np.concatenate([[stop], one[:-1]])
    two[one == stop] = stop
    return one, two


def id_of(found: np.ndarray) -> np.ndarray:
    return (found & 0xFFFFFFFF) - 1


def ranked(columns: list[np.ndarray], below: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of numbers less than below, rising, and how often each is there. Where a row fits into 64 bits, it is sorted as one number."""
    width = max(1, (below - 1).bit_length())
    if width * len(columns) > 64:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
        return [c[first] for c in columns], np.diff(np.append(first, len(order)))
    packed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        packed = packed << np.uint64(width) | c.astype(np.uint64)
    rows, counts = np.unique(packed, return_counts=True)
    return [(rows >> np.uint64(width * k) & np.uint64((1 << width) - 1)).astype(np.int64) for k in reversed(range(len(columns)))], counts


def gram_counts(batches: Iterable[pa.RecordBatch], key: str, shards: int, order: int) -> Iterator[pa.RecordBatch]:
    """Pairs (level 2) and, for order 3, runs of three words (level 3), counted for some tokens at a time."""
    words = kept(key, lambda: Words(key))
    stop = words.stop()
    parts, held = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        found = np.concatenate(parts)
        there, first, rank = np.unique(id_of(found), return_index=True, return_inverse=True)
        (one, two), mass = contexts_of(rank, int(np.searchsorted(there, id_of(np.array(stop))))), found[first] >> 32
        (context, following), counts = ranked([one, rank], len(there))
        keys = there[context].astype(np.uint64) << np.uint64(32) | there[following].astype(np.uint64)
        yield dealt((keys, np.zeros(len(keys), np.uint32), counts), shards2(words, there[context], shards), 2)
        if order > 2:
            (one, two, following), counts = ranked([one, two, rank], len(there))
            keys = there[one].astype(np.uint64) << np.uint64(32) | there[two].astype(np.uint64)
            yield dealt((keys, there[following].astype(np.uint32), counts), shards3(words, there[one], there[two], mass[one], shards), 3)

    for batch in batches:
        for found, first in words.texts(batch.column(0)):
            parts.append(np.insert(found, first[1:], stop))  # with an end after each text
            held += len(parts[-1])
            if held >= PAIRS_HELD:
                yield from out()
                parts, held = [], 0
    if parts:
        yield from out()


def bucket(counts: np.ndarray) -> np.ndarray:
    """Contexts of about equal count: each of 1 to 4 alone, then two buckets for each doubling."""
    return np.minimum(np.where(counts < 4, counts, np.floor(2 * np.log2(np.maximum(counts, 1)))), BUCKETS - 1).astype(np.int64)


def gram_level(batches: Iterable[pa.RecordBatch], home: str, least: int) -> Iterator[pa.RecordBatch]:
    """A shard's grams and counts, and how often a gram was alone, by what its context's count is without it.

    Grams of three words that occur less than ``least`` times are counted in their contexts and not kept.
    """
    for level, shard, (keys, lower, counts) in by_shard(batches):
        contexts, following = (keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)) if level == 2 else (keys, lower)
        which, first = np.unique(contexts, return_index=True)
        total, alone = np.add.reduceat(counts, first), np.add.reduceat((counts == 1).astype(np.int64), first)
        b, more = bucket(total - 1), total > 1
        stats = {"alone": np.bincount(b[more], alone[more], BUCKETS).astype(np.int64).tolist(), "all": np.bincount(b[more], total[more], BUCKETS).astype(np.int64).tolist()}
        lengths = np.diff(np.append(first, len(keys)))
        if level == 3 and least > 1:
            stay = counts >= least
            owner = np.repeat(np.arange(len(which)), lengths)[stay]
            following, counts = following[stay], counts[stay]
            lengths = np.bincount(owner, minlength=len(which))
            which, total, lengths = which[lengths > 0], total[lengths > 0], lengths[lengths > 0]
        name = f"{home}/raw{level}-{shard}-{uuid.uuid4().hex}"
        save(name, {"context": which, "total": total, "first": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), "next": following.astype(np.uint32), "count": counts.astype(np.uint32)})
        yield pa.RecordBatch.from_pylist([{"level": level, "shard": shard, "name": name, **stats}])


def distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, rising, and the place of each number among them; not sorted again where they rise already."""
    new = numbers[1:] != numbers[:-1]
    if (numbers[1:] < numbers[:-1]).any():
        return np.unique(numbers, return_inverse=True)
    return numbers[np.flatnonzero(np.concatenate([[True], new]))] if len(numbers) else numbers, np.concatenate([[0], np.cumsum(new)])[: len(numbers)]


def each_of(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and where it stands, in one pass over all."""
    order = np.argsort(shards.astype(np.uint16) if len(shards) and shards.max() < 1 << 16 else shards, kind="stable")  # 16 bits: a radix sort
    ordered = shards[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=False):
        yield int(ordered[a]), order[a:b]


def asked_together(file: Callable, shards: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Shards with few questions in groups: what is held of each, which of these each question is for (rising), and where the questions stand."""
    levels, places, size = [], [], 0

    def group() -> tuple[list, np.ndarray, np.ndarray]:
        return levels, np.repeat(np.arange(len(levels)), [len(p) for p in places]), np.concatenate(places)

    for s, at in each_of(shards):
        if (level := file(s)) is None:
            continue
        if levels and size + len(at) > TOGETHER:
            yield group()
            levels, places, size = [], [], 0
        levels.append(level)
        places.append(at)
        size += len(at)
    if levels:
        yield group()


class Pairs:
    """Level 2: rising pointers from the ids of contexts to their successors, these in rising runs, and quantised log10 probabilities."""

    def __init__(self, home: str, words: Words, shards: int):
        self.words, self.shards = words, shards
        self.file = Files(home, "grams2", lambda a: (int(a["low"][0]), EliasFano.of(a, "pointer"), EliasFano.of(a, "next"), a["code"], a["escape"]))

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair: its rank among the context's successors (-1: none), its code, and log10 of the context's escape (0: no such context)."""
        rank, code, escape = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.zeros(len(context))
        known = np.flatnonzero(context >= 0)
        for levels, which, at in asked_together(self.file, shards2(self.words, context[known], self.shards)):
            lows, pointers, following, codes, escapes = (list(x) for x in zip(*levels, strict=True))
            mine, local = known[at], context[known[at]] - np.array(lows)[which]
            some = np.flatnonzero((local >= 0) & (local < np.array([len(e) for e in escapes])[which]))
            mine, local, which = mine[some], local[some], which[some]
            alone, back = distinct(which << 32 | local)
            runs, alone = alone >> 32, alone & 0xFFFFFFFF
            begin, end = (x.view(np.int64) for x in Several(pointers, runs).two_at(alone))
            escape[mine] = gathered(escapes, parts_of(runs), alone)[back]
            start, begin, end = Runs(Several(following, runs)).starts(begin)[back], begin[back], end[back]
            end[word[mine] < 0] = 0
            place = Runs(Several(following, which)).find(np.maximum(word[mine], 0), begin, end, start)
            hit = np.flatnonzero(place >= 0)
            rank[mine[hit]], code[mine[hit]] = place[hit] - begin[hit], gathered(codes, parts_of(which[hit]), place[hit])
        return rank, code, escape


class Contexts:
    """Contexts of two words as one rising sequence, in which those with one last word are spread over as much more room as there are more
    of them, so that about as many share high parts everywhere. ``ones``: the last words; ``room``: the running sums of their factors."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.size, self.ones, self.room, self.sequence = int(arrays["size"][0]), arrays["ones"], arrays["room"], EliasFano.of(arrays, "context")

    @staticmethod
    def build(context: np.ndarray, size: int) -> dict[str, np.ndarray]:
        """context: rising, the last word above, the one before it in the lower 32 bits; both are less than size."""
        ones, back, n = np.unique(context >> np.uint64(32), return_inverse=True, return_counts=True)
        factor = np.uint64(1) << np.floor(np.log2(n)).astype(np.uint64)
        room = np.concatenate([[np.uint64(0)], np.cumsum(factor)]).astype(np.uint64)
        values = room[back] * np.uint64(size) + (context & np.uint64(0xFFFFFFFF)) * factor[back]
        return {"size": np.array([size]), "ones": ones.astype(np.uint32), "room": room.astype(np.uint32)} | EliasFano.build(values, narrowed=True).arrays("context")

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each context, -1 if it isn't there."""
        return contexts_at([self], np.zeros(len(one), np.int64), one, two)


def contexts_at(levels: list[Contexts], which: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The place of each context in the level that is named for it (rising), -1 if it isn't there."""
    out, at, there = np.full(len(one), -1, np.int64), np.zeros(len(one), np.int64), np.zeros(len(one), bool)
    words = one.astype(np.uint32)
    for k, a, b in parts_of(which):
        ones = levels[k].ones
        if len(ones):
            at[a:b] = ones.searchsorted(words[a:b])
            there[a:b] = ones[np.minimum(at[a:b], len(ones) - 1)] == words[a:b]
    hit = np.flatnonzero(there)
    at, which, parts, rooms = at[hit], which[hit], parts_of(which[hit]), [level.room for level in levels]
    first, after = gathered(rooms, parts, at).astype(np.int64), gathered(rooms, parts, at + 1).astype(np.int64)
    out[hit] = Several([level.sequence for level in levels], which).find((first * levels[0].size + two[hit] * (after - first)).view(np.uint64))
    return out


class Triples:
    """Level 3: contexts of two words; a successor is its rank among those of the context's last word, so that it is a small number."""

    def __init__(self, home: str, words: Words, shards: int, least: int):
        self.words, self.shards, self.least = words, shards, least
        self.file = Files(home, "grams3", lambda a: (Contexts(a), EliasFano.of(a, "pointer"), EliasFano.of(a, "next"), a["code"], a["escape"]))

    def find(self, one: np.ndarray, two: np.ndarray, rank: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each run of words (two, one, the one of this rank after one): its code (-1: none) and log10 of the context's escape. count: of one."""
        code, escape = np.full(len(one), -1.0), np.zeros(len(one))
        known = np.flatnonzero((one >= 0) & (two >= 0) & (count >= self.least))  # a rarer word has no kept grams
        for levels, which, here in asked_together(self.file, shards3(self.words, one[known], two[known], count[known], self.shards)):
            contexts, pointers, following, codes, escapes = (list(x) for x in zip(*levels, strict=True))
            mine = known[here]
            at = contexts_at(contexts, which, one[mine], two[mine])
            some = np.flatnonzero(at >= 0)
            mine, at, which = mine[some], at[some], which[some]
            escape[mine] = gathered(escapes, parts_of(which), at)
            some = np.flatnonzero(rank[mine] >= 0)
            mine, at, which = mine[some], at[some], which[some]
            begin, end = (x.view(np.int64) for x in Several(pointers, which).two_at(at))
            place = Runs(Several(following, which)).find(rank[mine], begin, end)
            hit = np.flatnonzero(place >= 0)
            code[mine[hit]] = gathered(codes, parts_of(which[hit]), place[hit])
        return code, escape


def trie_level(batches: Iterable[pa.RecordBatch], home: str, level: int, shards: int, escape: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard of level 2 or 3 with quantised smoothed probabilities.

    p(w | u) = (1 - e) c(u w) / c(u) + s p(w | shorter u), e the escape of u's bucket, s what the kept grams leave: a
    distribution. The shorter context of one word is none: the base. Steps are rounded down, so what is kept never sums to over 1.
    """
    words = kept(home, lambda: Words(home))
    pairs = kept(f"{home}/pairs", lambda: Pairs(home, words, shards)) if level == 3 else None
    for batch in batches:
        for shard, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = load(name)
            first, following, counts, total = np.array(raw["first"]), np.array(raw["next"]), np.array(raw["count"]).astype(np.float64), np.array(raw["total"]).astype(np.float64)
            context, lengths = np.array(raw["context"]).astype(np.uint64), np.diff(first)
            e = escape[bucket(total.astype(np.int64))]
            kept_mass = np.add.reduceat(counts, first[:-1]) / total if len(counts) else np.zeros(0)
            left = 1 - (1 - e) * kept_mass
            if level == 2:
                distinct, back = np.unique(following, return_inverse=True)
                lower = 10.0 ** words.base(words.counts_of(distinct.astype(np.int64)))[back]
            else:
                last = np.repeat((context >> np.uint64(32)).astype(np.int64), lengths)
                both, back = np.unique(last.astype(np.uint64) << np.uint64(32) | following.astype(np.uint64), return_inverse=True)
                rank, code, _ = pairs.find((both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64))
                lower, following = 10.0 ** (-code / STEP)[back], rank[back]
            p = np.repeat((1 - e) / total, lengths) * counts + np.repeat(left, lengths) * lower
            codes = np.minimum(np.ceil(-np.log10(p) * STEP), 65535).astype(np.uint16)
            out = f"{home}/grams{level}-{shard}-{uuid.uuid4().hex}"
            escapes = np.log10(left).astype(np.float32)
            if level == 2:  # a place for every id from the least to the greatest
                low = int(context[0])
                at, sizes = (context - np.uint64(low)).astype(np.int64), np.zeros(int(context[-1]) - low + 2, np.int64)
                sizes[at + 1] = lengths
                spread = np.zeros(len(sizes) - 1, np.float32)
                spread[at] = escapes
                arrays = {"low": np.array([low]), "escape": spread} | EliasFano.build(np.cumsum(sizes)).arrays("pointer")
            else:
                arrays = {"escape": escapes} | Contexts.build(context, words.size) | EliasFano.build(first).arrays("pointer")
            save(out, arrays | Runs.build(following, first).arrays("next") | {"code": codes})
            yield pa.RecordBatch.from_pylist([{"level": f"grams{level}", "shard": shard, "name": out}])


def scored(batches: Iterable[pa.RecordBatch], key: str, shards: int, order: int, least: int) -> Iterator[pa.RecordBatch]:
    words = kept(key, lambda: Words(key))
    pairs, triples = kept(f"{key}/pairs", lambda: Pairs(key, words, shards)), kept(f"{key}/triples", lambda: Triples(key, words, shards, least))
    stop = words.stop()
    for batch in batches:
        done = 0
        for found, first in words.texts(batch.column(1)):
            part = batch.slice(done, len(first) - 1)
            done += len(first) - 1
            lengths = np.diff(first) + 1
            both = np.insert(found, first[1:], stop)
            ids, counts = id_of(both), both >> 32
            many = counts == MOST
            counts[many] = words.counts_of(ids[many])
            first = np.cumsum(lengths) - lengths
            base = words.base(counts) if words.size else np.zeros(len(ids))
            score = log_probabilities(both, base, stop, pairs, triples if order > 2 else None) if words.size else base
            known = np.add.reduceat((counts > 0).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def log_probabilities(found: np.ndarray, base: np.ndarray, stop: int, pairs: Pairs, triples: Triples | None) -> np.ndarray:
    """log10 p of each token after the two before it; each different pair and run of three is sought once.

    What isn't found at a level has the shorter context's probability, times the longer one's escape.
    """
    before, earlier = contexts_of(found, stop)
    one, ids = id_of(before), id_of(found)
    pair, first, back = np.unique((one + 1) << 32 | (ids + 1), return_index=True, return_inverse=True)
    rank, code, escape = pairs.find(one[first], ids[first])
    shorter = np.where(rank >= 0, -code / STEP, base[first] + escape)
    if triples is None:
        return shorter[back]
    gram, again = np.unique(back.astype(np.int64) << 32 | (earlier & 0xFFFFFFFF), return_inverse=True)
    which = gram >> 32
    code, escape = triples.find(one[first[which]], id_of(gram), rank[which], (before >> 32)[first[which]])
    return np.where(code >= 0, -code / STEP, shorter[which] + escape)[again]


class Model:
    """A trained model: its folder of files in the shared folder, and what is needed to use them."""

    def __init__(self, home: str, shards: int, order: int, least: int, train_tokens: int):
        self.home, self.shards, self.order, self.least, self.train_tokens = home, shards, order, least, train_tokens

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score of every row's whole text; a null text is an empty one."""
        small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return small.mapInArrow(partial(scored, key=self.home, shards=self.shards, order=self.order, least=self.least), SCORES)


def train(docs: DataFrame, order: int = 3, least: int = 2) -> Model:
    """A model of the texts of docs (null: empty), in files of the shared folder.

    Words, pairs and runs of three words are counted in each task, sent to shards as sorted, compressed runs, and merged there,
    each shard by itself; a shard writes its part of a level, whose name goes into a manifest beside it. Shards grow in
    number with the input; only sums come to the driver, and a row for each of the words' shards, of which there are as many as
    shuffle partitions. Files carry a random name, and those of a task that was run again are not referred to. Escapes
    are estimated by leaving out each gram once: how often it is then unseen, for contexts of like count. Runs of three
    are kept from ``least`` occurrences on. Equal hashes (64 bits) would make two words one; over 2 ** 32 - 2 different words
    are refused.
    """
    if order not in (2, 3) or least < 1:
        raise ValueError("order is 2 or 3, least 1 or more")
    spark = docs.sparkSession
    small_batches(spark)
    home = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    texts = docs.select(F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (parts - 1).bit_length()

    def sharded(rows: DataFrame, shards: int) -> DataFrame:
        return rows.repartition(min(shards, 4 * parts), "level", "shard").sortWithinPartitions("level", "shard")

    counted = sharded(texts.mapInArrow(partial(word_counts, bits=bits), DEALT), 1 << bits)
    files = sorted(tuple(r) for r in counted.mapInArrow(partial(word_level, home=home, bits=bits), "shard long, name string, n long, total long").collect())
    columns = [np.array([f[k] for f in files], np.int64) for k in (0, 2, 3)]
    save(f"{home}/words", {"bits": np.array([bits]), "shard": columns[0], "n": columns[1], "total": columns[2]})
    tokens, size = int(columns[2].sum()), int(columns[1].sum())
    if not tokens:
        return Model(home, 1, order, least, 0)
    if size > (1 << 32) - 2:
        raise ValueError("too many different words")
    write_manifest(spark.createDataFrame([("words", f[0], f[1]) for f in files], "level string, shard long, name string"), home)
    shards = max(parts, -(-tokens // PAIRS_PER_SHARD))
    raw = sharded(texts.mapInArrow(partial(gram_counts, key=home, shards=shards, order=order), DEALT), shards)
    found = checkpointed(raw.mapInArrow(partial(gram_level, home=home, least=least), "level long, shard long, name string, alone array<long>, all array<long>"))
    for level in range(2, order + 1):
        rows = found.where(F.col("level") == level)
        sums = rows.select(F.posexplode(F.arrays_zip("alone", "all")).alias("at", "v")).groupBy("at").agg(F.sum("v.alone"), F.sum("v.all")).collect()
        alone, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for at, a, n in sums:
            alone[at], total[at] = a, n
        escape = np.clip((alone + 0.9) / (total + 1.0), 0.001, 0.999)
        names = rows.select("shard", "name").repartition(min(shards, 4 * parts), "shard")
        made = checkpointed(names.mapInArrow(partial(trie_level, home=home, level=level, shards=shards, escape=escape), "level string, shard long, name string"))
        write_manifest(made, home)
        rows.select("name").foreachPartition(remove_all)
    return Model(home, shards, order, least, tokens)


def remove_all(rows: Iterable) -> None:
    for r in rows:
        remove(r[0])


def held_out() -> Column:
    """Whether the row takes no part in learning: crc32 of doc_id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from those not held out.

    With nothing to learn from every probability of the base is 0.5 / 0.5. Rows are independent: repeated rows and
    doc_ids stay as they are. Other columns of docs are ignored.
    """
    model = train(docs.select("doc_id", "text").where(~held_out()))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")

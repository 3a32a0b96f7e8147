"""Hierarchical packing of documents into training sequences of several lengths."""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.memo import CLEAR, Memo, claim, coded
from lumaframe.llm.shared import small_batches

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
REMEMBER = 400_000
BUFFER_TOKENS = 1 << 20
MARK = "\ue000"
#: Words that are encoded in one call; the library holds some hundred bytes for each token meanwhile.
AT_ONCE = 4000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])


@lru_cache(maxsize=4)
def encoder(path: str, remember: int):
    """Texts to their ids as little-endian unsigned 32-bit bytes, word by word.

    Blanks and line feeds end every pre-token of this tokenizer's kind, its normaliser never works across them, and none
    of its special tokens holds one, so the ids of a text are those of its blank-separated parts in a row. A special
    token's name in a text is that token.
    """
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def ids_of(text: str) -> bytes:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    mark = ids_of(MARK)

    def make(words: list[str]) -> list[bytes]:
        """Some words in one call, with a word between them whose ids no word here has."""
        out: list[bytes] = []
        for i in range(0, len(words), AT_ONCE):
            some = words[i : i + AT_ONCE]
            found = [] if any(MARK in w for w in some) else ids_of(f" {MARK} ".join(some)).split(mark)
            out += found if len(found) == len(some) else [ids_of(w) for w in some]
        return out

    memo = Memo(make, remember)

    def encode(column: pa.Array) -> Iterator[bytes]:
        for n, codes, words, first in coded(column, "blank"):
            ids = pa.array(memo(words), pa.large_binary()).take(pa.array(codes))
            _, ends, data = ids.buffers()
            at = np.frombuffer(ends, np.int64)[first] if len(codes) else np.zeros(n + 1, np.int64)
            for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                yield data[a:b].to_pybytes()

    return encode


CLEAR.append(encoder.cache_clear)


class Piece:
    """A run of a document's ids."""

    __slots__ = ("doc", "start", "ids", "total", "length")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total, self.length = doc, start, ids, total, len(ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class Packer:
    """Packs the documents of one partition, holding about BUFFER_TOKENS ids at a time.

    A document longer than the top tier gives full windows; what is left of it, like a shorter document, goes to
    the lowest tier that holds it. The pieces of a tier open windows of that length, longest tier first, and gaps
    are filled by the longest shorter pieces that fit, the last by the head of a piece that is cut. So every
    sequence is exactly as long as its tier. Pieces of a window that can't be filled wait for more; at the end of
    the partition they are cut into sequences of powers of two, so there is no padding at all.
    """

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first: int):
        self.tiers, self.top, self.step_tokens = tiers, tiers[-1], step_tokens
        self.pool: list[tuple[int, int, Piece]] = []  # by length
        self.held, self.age, self.sequence, self.group = 0, 0, first, first
        self.waiting: dict[int, list[list[Piece]]] = {}

    def put(self, piece: Piece) -> None:
        self.age += 1
        insort(self.pool, (piece.length, -self.age, piece))

    def add(self, doc, ids: bytes) -> None:
        whole = Piece(doc, 0, ids, len(ids) // 4)
        while whole.length > self.top:
            window, whole = whole.cut(self.top)
            self.close([window], self.top)
        self.put(whole)
        self.held += whole.length

    def fill(self, size: int) -> list[Piece] | None:
        """A window of exactly this size from the pool, opened by its longest piece that fits; None if too few ids are left."""
        at = bisect_right(self.pool, (size + 1,)) - 1
        window, gap = [], size
        while gap and self.pool:
            if at >= 0:
                piece = self.pool.pop(at)[2]
            else:
                piece, rest = self.pool.pop()[2].cut(gap)
                self.put(rest)
            window.append(piece)
            gap -= piece.length
            at = bisect_right(self.pool, (gap + 1,)) - 1
        if gap:
            for p in window:
                self.put(p)
            return None
        return window

    def close(self, window: list[Piece], tier: int) -> None:
        self.waiting.setdefault(tier, []).append(window)

    def pack(self) -> None:
        below = [0, *self.tiers[:-1]]
        for tier, floor in zip(reversed(self.tiers), reversed(below), strict=True):
            while self.pool and self.pool[-1][0] > floor:
                if (window := self.fill(tier)) is None:
                    break
                self.close(window, tier)
        self.held = sum(x[0] for x in self.pool)

    def finish(self) -> None:
        self.pack()
        while total := sum(x[0] for x in self.pool):
            size = min(self.top, 1 << (total.bit_length() - 1))
            self.close(self.fill(size), size)

    def rows(self, last: bool) -> Iterator[tuple]:
        """The sequences closed so far in step groups of about step_tokens ids each, of one tier.

        Attention costs as much as the sum of the squares of a sequence's pieces: sequences are dealt out by falling
        cost, to and fro, so that the groups of a batch cost about the same. Fewer sequences than a group takes wait.
        """
        for tier, windows in list(self.waiting.items()):
            size = max(1, self.step_tokens // tier)
            n = math.ceil(len(windows) / size) if last else len(windows) // size
            take, self.waiting[tier] = (windows, []) if last else (windows[: n * size], windows[n * size :])
            take.sort(key=lambda w: -sum(p.length**2 for p in w))
            for k, window in enumerate(take):
                turn, place = divmod(k, n)
                group, offset = self.group + (place if turn % 2 == 0 else n - 1 - place), 0
                for p in window:
                    yield p.doc, p.start, p.length, p.ids, p.total, self.sequence, offset, tier, group
                    offset += p.length
                self.sequence += 1
            self.group += n


def packed(batches: Iterable[pa.RecordBatch], path: str, end: int, tiers: tuple[int, ...], step_tokens: int, remember: int) -> Iterator[pa.RecordBatch]:
    claim(f"packing {path}")
    encode, stop = encoder(path, remember), end.to_bytes(4, "little")
    packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 40)

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in packer.rows(last):
            rows.append(row)
            size += len(row[3])
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
            packer.add(doc, ids + stop)
            if packer.held > BUFFER_TOKENS:
                packer.pack()
                yield from out(False)
    packer.finish()
    yield from out(True)


def pack(docs: DataFrame, tokenizer: str, end: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, remember: int = REMEMBER) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its text's ids by the tokenizer file at the path ``tokenizer`` (null: none) and the id ``end``;
    ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers. Each id is in exactly one piece. Every
    partition of docs is packed by itself in one pass, without a shuffle, so a lost task is simply run again, and
    no order of rows, repeated row, repeated or null doc_id matters. sequence_id and step_group are unique but not
    gapless: the partition's number is in their upper bits. An empty table gives no rows. Columns of docs other
    than doc_id and text are ignored. The tiers must be rising powers of two. A worker remembers the ids of at most twice
    ``remember`` words.
    """
    if list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    small_batches(docs.sparkSession)
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small.mapInArrow(partial(packed, path=tokenizer, end=end, tiers=tuple(tiers), step_tokens=step_tokens, remember=remember), SCHEMA)

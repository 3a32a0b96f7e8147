"""Documents' sets of shingles, and their exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.llm.memo import claim, coded

SEED = 42


def scattered(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers, in place."""
    with np.errstate(over="ignore"):
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of each text's different shingles, rising; a text of fewer words has one, without words none.

    Words stand between ASCII white space; A-Z are lowered.
    """
    import xxhash

    factor = scattered(np.arange(1, shingle + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for count, codes, words, first in coded(texts, "lower"):
        of = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words] or [0], np.uint64)[codes]
        whole = np.zeros(max(0, len(of) - shingle + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(shingle):
                whole += of[k : k + len(whole)] * factor[k]
        whole = scattered(whole)
        for i in range(count):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= shingle:
                yield np.unique(whole[a : b - shingle + 1])
            elif a == b:
                yield whole[:0].copy()
            else:
                with np.errstate(over="ignore"):
                    yield scattered((of[a:b] * factor[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))


def compared(batches: Iterable[pa.RecordBatch], shingle: int, share: float) -> Iterator[pa.RecordBatch]:
    """a, b: pairs whose sets are similar enough, as many as connect the classes that such pairs here connect.

    Rows are lists of a row's partners (meet, a, root, bs, roots), the roots being their classes; a meeting's texts (meet, a, text) stand
    before its lists. Pairs of classes that links found here have connected aren't compared any more.
    """
    claim("")
    meet, sets, above = None, {}, {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            has = batch.filter(batch.column("text").is_valid())
            found, good = iter(list(shingle_sets(has.column("text"), shingle))), []
            for m, a, root, bs, roots in zip(*(batch.column(c).to_pylist() for c in ("meet", "a", "root", "bs", "roots")), strict=True):
                if m != meet:
                    meet, sets = m, {}
                if bs is None:
                    sets[a] = next(found)
                    continue
                s = sets[a]
                for b, other in zip(bs, roots, strict=True):
                    if (p := top(root)) == (q := top(other)):
                        continue
                    t = sets[b]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if both >= share * (len(s) + len(t) - both) - 1e-9:
                        good.append((a, b))
                        above[max(p, q)] = min(p, q)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in good], pa.int64()), pa.array([p[1] for p in good], pa.int64())], ["a", "b"])


def row_mark() -> Column:
    """A hash of doc_id and text: what tells a row from all but its exact copies."""
    doc_id = F.col("doc_id").cast("long")
    return F.xxhash64(doc_id.isNull(), doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")))

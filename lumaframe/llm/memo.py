"""Words of whole batches as numbers, and a bounded memory of per-word results inside a Python worker."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOGETHER = 2000


def coded(column: pa.Array, how: str) -> Iterator[tuple[int, np.ndarray, list, np.ndarray]]:
    """Some texts at a time: (number of texts, codes, words, first): text i has words[c] for c in codes[first[i] : first[i + 1]].

    how: ``ascii`` or ``unicode`` (words between white space; ``ascii`` gives bytes), ``lower`` (as ascii, with A-Z
    lowered), ``blank`` (all that stands between blanks or line feeds, empty strings too). A null text is an empty one.
    Splitting and numbering run in Arrow; Python sees each different word of the batch once.
    """
    for at in range(0, len(column), TOGETHER):
        texts = pc.fill_null(column.slice(at, TOGETHER).cast(pa.string()), "")
        if how == "blank":
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        elif how == "unicode":
            split = pc.utf8_split_whitespace(texts)
        else:
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if how == "lower" else texts)
        first, numbered = np.asarray(split.offsets, np.int64), split.values.dictionary_encode()
        codes, words = np.asarray(numbered.indices), numbered.dictionary
        empty = pc.index(words, "").as_py() if how != "blank" else -1
        if empty >= 0:  # at the ends of a text; the word keeps its number, which nothing has any more
            full = codes != empty
            first, codes = np.concatenate([[0], np.cumsum(full)])[first], codes[full]
        if how in ("ascii", "lower"):
            words = words.cast(pa.binary())
        yield len(texts), codes, words.to_pylist(), first


class Memo:
    """words -> values, made by ``make(list of words) -> list of values`` for words not seen lately.

    Two generations: when the young one holds ``limit`` words it becomes the old one, and words found there move
    back. Words over ``longest`` characters are made afresh each time. So memory is bounded for any input, and
    what is remembered never changes a result.
    """

    def __init__(self, make, limit: int = 250_000, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, words: list) -> list:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing, long = [], []
        for w in set(words).difference(young):
            if (v := old.get(w)) is None:
                missing.append(w)
            else:
                young[w] = v
        if missing:
            young.update(zip(missing, self.make(missing), strict=True))
            long = [w for w in missing if len(w) > self.longest]
        values = list(map(young.__getitem__, words))
        for w in long:
            del young[w]
        return values


#: How to drop what a worker keeps between tasks, and the operator that it keeps something for.
CLEAR: list = []
CLAIMED: list[str] = [""]


#: glibc's mallopt(): blocks of a megabyte or more are mapped by themselves, free memory over as much goes back, one arena.
KEPT_FREE = ((-3, 1 << 20), (-1, 1 << 20), (-8, 1))


@lru_cache(maxsize=1)
def give_back_early() -> None:
    """Has the C library, and Arrow through it, return what is freed; otherwise a worker keeps the most that it ever held."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        library = ctypes.CDLL(None)
        for what, value in KEPT_FREE:
            library.mallopt(what, value)


def claim(operator: str) -> None:
    """A worker serves many operators in turn and keeps things for one: those of the one before are dropped here, and the
    memory is given back."""
    give_back_early()
    if CLAIMED[0] != operator:
        CLAIMED[0] = operator
        for f in CLEAR:
            f()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

"""Elias-Fano sequences and files of named arrays that are mapped into memory."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

#: Set bits of each byte value, and the place of its k-th set bit, at 8 * value + k.
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
EACH, TOPS, FIVES, THREES, NIBBLES = (np.uint64(int(x * 8, 16)) for x in ("01", "80", "55", "33", "0f"))
PLACE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64).ravel()


#: A marked sequence keeps one value in so many as it is.
EVERY = 16
#: Places that are looked up together.
TOGETHER = 1 << 14


def place_in(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place of each word's set bit with so many set ones before it."""
    # set bits up to each byte of the word, as its bytes; how many of these are at most left; the rest from a table
    s = word - (word >> np.uint64(1) & FIVES)
    s = (s & THREES) + (s >> np.uint64(2) & THREES)
    s = ((s + (s >> np.uint64(4))) & NIBBLES) * EACH
    shift = np.bitwise_count(((left * EACH) | TOPS) - s & TOPS).astype(np.uint64) << np.uint64(3)
    left = left - ((s << np.uint64(8)) >> shift & np.uint64(255))
    return shift.view(np.int64) + PLACE[((word >> shift & np.uint64(255)) << np.uint64(3) | left).view(np.int64)]


class EliasFano:
    """A rising sequence of n unsigned integers in about 2 + log2(universe / n) bits each.

    The low bits of the values are packed side by side; the high parts are written in unary, as one bit a value
    among the bits of all high parts. Both live in plain arrays, so a sequence can be used straight from a file.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray, marks: np.ndarray | None = None, zeros: np.ndarray | None = None):
        self.n, self.low_bits, self.low, self.high, self.before, self.marks, self.zeros = n, low_bits, low, high, before, marks, zeros
        self.words, self.unset = high.view(np.uint64), 64 * len(before) - n

    @classmethod
    def build(cls, values: np.ndarray, marked: bool = False, narrowed: bool = False) -> EliasFano:
        """marked: every EVERY-th value is also kept as it is, for searches over the whole sequence. narrowed: so are the numbers of unset
        bits before each 64 of the high parts, for searches in wide ranges."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = values & np.uint64((1 << low_bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift + np.uint64(low_bits) > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        bits = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((top >> low_bits) + n) // 64 * 8 + 8, np.uint8)
        np.bitwise_or.at(high, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
        before = np.concatenate([[0], np.cumsum(ONES[high], dtype=np.int64)])[:-1:8].astype(np.int64)
        return cls(n, low_bits, low, high, before, values[::EVERY].copy() if marked else None, 64 * np.arange(len(before)) - before if narrowed else None)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        arrays = {f"{name}.n": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.before": self.before}
        return arrays | {f"{name}.{k}": v for k, v in (("marks", self.marks), ("zeros", self.zeros)) if v is not None}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = arrays[f"{name}.n"].tolist()
        return cls(n, low_bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.before"], arrays.get(f"{name}.marks"), arrays.get(f"{name}.zeros"))

    def part(self, some: np.ndarray | slice) -> EliasFano:
        """What is to be asked about some of the places or values only."""
        return self

    def read(self, name: str, at: np.ndarray) -> np.ndarray:
        return getattr(self, name)[at]

    def block(self, name: str, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(getattr(self, name), numbers, "right") - 1

    def mask(self, values: np.ndarray) -> np.ndarray:
        return values & (np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1)

    def lows(self, at: np.ndarray) -> np.ndarray:
        """The low bits of the values at these places (int64), which need no search."""
        bit = at * self.low_bits
        word, shift = bit >> 6, (bit & 63).view(np.uint64)
        return self.mask(self.read("low", word) >> shift | self.read("low", word + 1) << np.uint64(1) << (np.uint64(63) - shift))

    def bit_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The word of the high parts where the value at each place stands, its number, and the bit's place in it."""
        block = self.block("before", at)
        word = self.read("words", block)
        return word, block, place_in(word, (at - self.read("before", block)).view(np.uint64))

    def value(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The value at each place, from its bit's place in all the high parts."""
        return (bit - at).view(np.uint64) << np.uint64(self.low_bits) | self.lows(at)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at these places (each in [0, n)), some at a time, so that what is in hand stays in the processor's cache."""
        at = np.asarray(at, np.int64)
        if len(at) > TOGETHER:
            return np.concatenate([self.part(slice(i, i + TOGETHER))[at[i : i + TOGETHER]] for i in range(0, len(at), TOGETHER)])
        _, block, place = self.bit_of(at)
        return self.value(at, block * 64 + place)

    def two_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at these places and at the next ones (each in [0, n - 1)); the next bit is mostly in the same word."""
        at = np.asarray(at, np.int64)
        if len(at) > TOGETHER:
            both = [self.part(slice(i, i + TOGETHER)).two_at(at[i : i + TOGETHER]) for i in range(0, len(at), TOGETHER)]
            return np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
        word, block, place = self.bit_of(at)
        after = word & (~np.uint64(1) << place.view(np.uint64))
        bit = block * 64 + np.bitwise_count((after & (~after + np.uint64(1))) - np.uint64(1))
        following = self.value(at + 1, bit)
        later = np.flatnonzero(after == 0)
        if len(later):
            following[later] = self.part(later)[at[later] + 1]
        return self.value(at, block * 64 + place), following

    def first_not_below(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """For each value the place of the first element that is not less, which lies in [low, high]; n if there is none."""
        if low is None and high is None and self.marks is not None:
            after = np.searchsorted(self.marks, values)
            low, high = np.maximum(0, (after - 1) * EVERY + 1), np.minimum(self.n, after * EVERY)
        low = np.zeros(len(values), np.int64) if low is None else low.astype(np.int64)
        high = np.full(len(values), self.n, np.int64) if high is None else high.astype(np.int64)
        if len(values) > TOGETHER:
            return np.concatenate([self.first_not_below(values[i : i + TOGETHER], low[i : i + TOGETHER], high[i : i + TOGETHER]) for i in range(0, len(values), TOGETHER)])
        read, wanted = self.__getitem__, values
        if self.zeros is not None:  # where only elements with the value's high part are left, their low bits tell
            low, high = self.narrow(values, low, high)
            read, wanted = self.lows, self.mask(values)
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = read(middle) < wanted[active]
            low[active] = np.where(less, middle + 1, low[active])
            high[active] = np.where(less, high[active], middle)
            active = active[low[active] < high[active]]
        return low

    def find(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """The place of each value in [low, high), -1 if it isn't there. The sequence is narrowed and none of its values occurs twice."""
        if len(values) > TOGETHER:
            cut = lambda x, i: None if x is None else x[i : i + TOGETHER]
            return np.concatenate([self.part(slice(i, i + TOGETHER)).find(values[i : i + TOGETHER], cut(low, i), cut(high, i)) for i in range(0, len(values), TOGETHER)])
        out = np.full(len(values), -1, np.int64)
        low = np.zeros(len(values), np.int64) if low is None else low
        low, high = self.narrow(values, low, np.full(len(values), self.n, np.int64) if high is None else high)
        active = np.flatnonzero(low < high)
        low, high, wanted, asked = low[active], high[active], self.mask(values)[active], self.part(active)
        while len(active):
            middle = (low + high) >> 1
            found = asked.lows(middle)
            hit = found == wanted
            out[active[hit]] = middle[hit]
            less = found < wanted
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            on = np.flatnonzero((low < high) & ~hit)
            active, low, high, wanted, asked = active[on], low[on], high[on], wanted[on], asked.part(on)
        return out

    def narrow(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each range where elements with the value's high part lie, which is where the value would stand: the set bits after
        the unset one that ends the high part before."""
        part = values >> np.uint64(self.low_bits)
        over = part >= np.uint64(self.unset)  # above all elements
        part = np.where(over, np.uint64(0), part).view(np.int64)
        before = np.maximum(part - 1, 0)
        block = self.block("zeros", before)
        word = self.read("words", block)
        place = place_in(~word, (before - self.read("zeros", block)).view(np.uint64))
        after = word >> place.view(np.uint64) >> np.uint64(1)
        ones = np.bitwise_count(after & ~(after + np.uint64(1))).astype(np.int64)
        first = block * 64 + place - before
        last = first + ones
        none = part == 0  # no unset bit before
        first[none] = 0
        on = np.flatnonzero(none | (place + 1 + ones >= 64))  # in the next word too: up to the unset bit that ends this high part
        if len(on):
            asked, ends = self.part(on), part[on]
            block = asked.block("zeros", ends)
            last[on] = block * 64 + place_in(~asked.read("words", block), (ends - asked.read("zeros", block)).view(np.uint64)) - ends
        if over.any():
            first, last = np.where(over, self.n, first), np.where(over, self.n, last)
        return np.minimum(np.maximum(first, low), high), np.minimum(np.maximum(last, low), high)


def gathered(arrays: list[np.ndarray], which: list[tuple[int, int, int]], at: np.ndarray) -> np.ndarray:
    """The items at these places, from the array that is named for each part of them: (array, where its part begins, where it ends)."""
    if len(which) == 1:
        return arrays[which[0][0]][at]
    out = np.empty(len(at), arrays[0].dtype)
    for k, a, b in which:
        out[a:b] = arrays[k][at[a:b]]
    return out


def parts_of(which: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, begin, end) of each part of equal numbers, which rise."""
    if not len(which):
        return [(0, 0, 0)]
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    return list(zip(which[first].tolist(), first.tolist(), [*first[1:].tolist(), len(which)], strict=True))


class Several(EliasFano):
    """Sequences that are asked together, each about a part of the places or values: which sequence, for each of them (rising).

    Only what is read is gathered from one after the other; all else is done once, so that a few questions to each of many cost little.
    """

    def __init__(self, sequences: list[EliasFano], which: np.ndarray):
        self.sequences, self.which, self.parts = sequences, which, parts_of(which)
        self.n, self.low_bits, self.unset = (np.array([getattr(s, k) for s in sequences], np.int64)[which] for k in ("n", "low_bits", "unset"))

    def part(self, some: np.ndarray | slice) -> Several:
        out = Several.__new__(Several)
        out.sequences, out.which, out.n, out.low_bits, out.unset = self.sequences, self.which[some], self.n[some], self.low_bits[some], self.unset[some]
        out.parts = parts_of(out.which)
        return out

    def read(self, name: str, at: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.sequences[self.parts[0][0]].read(name, at)
        out = np.empty(len(at), getattr(self.sequences[0], name).dtype)
        for k, a, b in self.parts:
            out[a:b] = getattr(self.sequences[k], name)[at[a:b]]
        return out

    def block(self, name: str, numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(numbers), np.int64)
        for k, a, b in self.parts:
            out[a:b] = getattr(self.sequences[k], name).searchsorted(numbers[a:b], "right")
        return out - 1


class Runs:
    """Rising runs of numbers, one for each context, in one sequence: each run goes on from where the one before it ends.

    A number is sought within its context's run only, by the place where the run begins and the number that ends the run before.
    """

    def __init__(self, sequence: EliasFano):
        self.sequence = sequence

    @staticmethod
    def build(values: np.ndarray, first: np.ndarray) -> EliasFano:
        """first: where each run begins, and the number of all values; no run is empty."""
        values = values.astype(np.uint64)
        if not len(values):
            return EliasFano.build(values, narrowed=True)
        tops = values[first[1:] - 1] + np.uint64(1)
        start = np.concatenate([[np.uint64(0)], np.cumsum(tops)[:-1].astype(np.uint64)])
        return EliasFano.build(values + np.repeat(start, np.diff(first)), narrowed=True)

    def starts(self, begin: np.ndarray) -> np.ndarray:
        """What is added to the numbers of the run that begins at each place."""
        return np.where(begin > 0, self.sequence[np.maximum(begin - 1, 0)] + np.uint64(1), np.uint64(0)) if len(begin) else np.zeros(0, np.uint64)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The place of each value in its run [begin, end), -1 if it isn't there; empty runs hold nothing. start: starts(begin), where known."""
        out = np.full(len(values), -1, np.int64)
        some = np.flatnonzero(end > begin)
        if not len(some):
            return out
        start = self.starts(begin[some]) if start is None else start[some]
        out[some] = self.sequence.part(some).find(values[some].astype(np.uint64) + start, begin[some], end[some])
        return out


def filesystem(uri: str):
    """The file system of a folder's URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the length of a JSON header, the header, then the arrays, each at a multiple of 64 bytes."""
    header, at, parts = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        header[name] = [a.dtype.str, len(a), at]
        parts.append(a.tobytes() + bytes(-a.nbytes % 64))
        at += len(parts[-1])
    head = json.dumps(header).encode()
    head += b" " * (-(len(head) + 8) % 64)
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for p in parts:
            out.write(p)


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; a file that isn't local is first copied to one without a name."""
    from pyarrow import fs

    store, path = filesystem(uri)
    if isinstance(store, fs.LocalFileSystem):
        memory = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as source:
            while block := source.read(1 << 24):
                copy.write(block)
            copy.flush()
            memory = np.memmap(copy, np.uint8, "r").view(np.ndarray)
    size = int.from_bytes(memory[:8].tobytes(), "little")
    out = {}
    for name, (dtype, n, at) in json.loads(memory[8 : 8 + size].tobytes()).items():
        first = 8 + size + at
        out[name] = memory[first : first + n * np.dtype(dtype).itemsize].view(dtype)
    return out


def remove(uri: str) -> None:
    store, path = filesystem(uri)
    store.delete_file(path)

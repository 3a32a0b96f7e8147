"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.memo import CLEAR, Memo, claim, coded
from lumaframe.llm.shared import small_batches

DOCS_PER_LANG = 160
WORDS_PER_DOC = 120
HIDDEN = 12
LONGEST = 32
#: Words that are labelled at once.
AT_ONCE = 8192
EPOCHS = 3
BATCH = 256
RATE = 0.01
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"


class Network:
    """Labels every byte of a sequence: two gated recurrent layers, one from each end, and a softmax over both.

    A sequence is a word with a space at each end (a word of over LONGEST bytes: its parts of that length), so
    that the state of the network depends on the word alone and words may be remembered.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden, self.p = hidden, {"out": rng.normal(0, 0.1, (2 * hidden, classes)), "bias": np.zeros(classes)}
        for d in "fb":
            self.p |= {f"in_{d}": rng.normal(0, 0.3, (256, 3 * hidden)), f"rec_{d}": rng.normal(0, 0.3, (hidden, 3 * hidden)), f"add_{d}": np.zeros(3 * hidden)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def layer(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (n, length, hidden) along x (n, length); keep gathers what the way back needs."""
        n, length = x.shape
        k = self.hidden
        given, rec, add = self.p[f"in_{d}"], self.p[f"rec_{d}"], self.p[f"add_{d}"]
        h, out = np.zeros((n, k), np.float32), np.empty((n, length, k), np.float32)
        for t in range(length):
            a, b = given[x[:, t]] + add, h @ rec
            gates = 1 / (1 + np.exp(-(a[:, : 2 * k] + b[:, : 2 * k])))
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
            if keep is not None:
                keep.append((h, z, r, new, b[:, 2 * k :]))
            h = new + z * (h - new)
            out[:, t] = h
        return out

    def log_probabilities(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each class at each position, and the states they come from."""
        ahead = self.layer(x, "f", keep and keep[0])
        behind = self.layer(x[:, ::-1], "b", keep and keep[1])[:, ::-1]
        states = np.concatenate([ahead, behind], axis=2)
        y = states @ self.p["out"] + self.p["bias"]
        y -= y.max(axis=2, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=2, keepdims=True)), states

    def gradients(self, x: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        keep: tuple[list, list] = ([], [])
        logs, states = self.log_probabilities(x, keep)
        n, length, _ = logs.shape
        k = self.hidden
        dy = np.exp(logs)
        dy[np.arange(n)[:, None], np.arange(length)[None, :], labels[:, None]] -= 1
        dy /= n * length
        grads = {"out": np.einsum("nth,ntc->hc", states, dy), "bias": dy.sum((0, 1))}
        dstates = dy @ self.p["out"].T
        for d, part, kept in (("f", dstates[:, :, :k], keep[0]), ("b", dstates[:, ::-1, k:], keep[1])):
            rec, seen = self.p[f"rec_{d}"], x if d == "f" else x[:, ::-1]
            g_in, g_rec, g_add = np.zeros_like(self.p[f"in_{d}"]), np.zeros_like(rec), np.zeros(3 * k, np.float32)
            dh = np.zeros((n, k), np.float32)
            for t in range(length - 1, -1, -1):
                h, z, r, new, b = kept[t]
                dh = dh + part[:, t]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * b * r * (1 - r)
                da = np.concatenate([dz, dr, dnew], axis=1)
                db = np.concatenate([dz, dr, dnew * r], axis=1)
                np.add.at(g_in, seen[:, t], da)
                g_rec += h.T @ db
                g_add += da.sum(0)
                dh = dh * z + db @ rec.T
            grads |= {f"in_{d}": g_in, f"rec_{d}": g_rec, f"add_{d}": g_add}
        return grads

    def fit(self, sequences: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Network:
        """Adam over batches of sequences of one length, in a fixed random order."""
        rng = np.random.default_rng(seed)
        groups = defaultdict(list)
        for s, y in zip(sequences, labels, strict=True):
            groups[len(s)].append((s, y))
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            batches = []
            for length in sorted(groups):
                rows = groups[length]
                order = rng.permutation(len(rows))
                batches += [[rows[i] for i in order[j : j + BATCH]] for j in range(0, len(rows), BATCH)]
            for i in rng.permutation(len(batches)):
                x = np.frombuffer(b"".join(s for s, _ in batches[i]), np.uint8).reshape(len(batches[i]), -1)
                step += 1
                for k, g in self.gradients(x, np.array([y for _, y in batches[i]])).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def words(self, words: list[bytes]) -> list[bytes]:
        """For each word the sum over its positions of the classes' log probabilities, and the positions, as float32 bytes."""
        out: list[bytes] = []
        for first in range(0, len(words), AT_ONCE):
            some = words[first : first + AT_ONCE]
            groups = defaultdict(list)
            for i, w in enumerate(some):
                for s in sequences(w):
                    groups[len(s)].append((i, s))
            sums = np.zeros((len(some), len(self.p["bias"]) + 1), np.float32)
            for length, rows in groups.items():
                for j in range(0, len(rows), 1024):
                    part = rows[j : j + 1024]
                    x = np.frombuffer(b"".join(s for _, s in part), np.uint8).reshape(-1, length)
                    logs, _ = self.log_probabilities(x)
                    at = np.array([i for i, _ in part])
                    np.add.at(sums[:, :-1], at, logs.sum(1))
                    np.add.at(sums[:, -1], at, length)
            out += [row.tobytes() for row in sums]
        return out


def sequences(word: bytes) -> list[bytes]:
    """The word's parts of at most LONGEST bytes, cut between code points, with a blank at each end."""
    if len(word) <= LONGEST:
        return [b" " + word + b" "]
    out, i = [], 0
    while i < len(word):
        j = min(len(word), i + LONGEST)
        while i + LONGEST - 3 <= j < len(word) and word[j] & 0xC0 == 0x80:
            j -= 1
        out.append(b" " + word[i:j] + b" ")
        i = j
    return out


MODELS: dict[bytes, Memo] = {}
CLEAR.append(MODELS.clear)


def labelled(batches: Iterable[pa.RecordBatch], network: Network, langs: list[str], text: int) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    """Parts of the batches with the language and score of their rows; text: the number of the text's column."""
    mark = network.p["out"].tobytes()
    claim(f"language {hash(mark)}")
    if mark not in MODELS:
        MODELS[mark] = Memo(network.words, 120_000)
    memo, width = MODELS[mark], len(langs) + 1
    for batch in batches:
        done = 0
        for n, codes, words, first in coded(batch.column(text), "ascii"):
            part = batch.slice(done, n)
            done += n
            names, scores = [UNKNOWN] * n, [0.0] * n
            fit = [bool(langs) and bool(t) and any(map(str.isalpha, t)) for t in part.column(text).to_pylist()]
            some = np.flatnonzero(np.diff(first))
            if len(some) and any(fit):
                sums = np.frombuffer(b"".join(memo(words)), np.float32).reshape(-1, width)
                total = np.add.reduceat(sums[codes].astype(np.float64), first[some])
                mean = total[:, :-1] / total[:, -1:]
                chances = np.exp(mean - mean.max(1, keepdims=True))
                best = chances.argmax(1)
                for i, k, s in zip(some.tolist(), best.tolist(), (chances.max(1) / chances.sum(1)).tolist(), strict=True):
                    if fit[i]:
                        names[i], scores[i] = langs[k], s
            yield part, names, scores


def predicted(batches: Iterable[pa.RecordBatch], network: Network, langs: list[str]) -> Iterator[pa.RecordBatch]:
    for part, names, scores in labelled(batches, network, langs, 1):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def accepted(batches: Iterable[pa.RecordBatch], network: Network, langs: list[str], text: int, least: float) -> Iterator[pa.RecordBatch]:
    for part, names, scores in labelled(batches, network, langs, text):
        yield part.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))


def sampled(batches: Iterable[pa.RecordBatch], words_per_doc: int) -> Iterator[pa.RecordBatch]:
    """Evenly chosen words of each text."""
    for batch in batches:
        texts = [t.as_py().encode("utf-8", "surrogatepass").split() for t in batch.column(2)]
        words = [b" ".join(t[:: max(1, len(t) // words_per_doc)]) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], ["doc_id", "lang", "words"])


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words_per_doc: int = WORDS_PER_DOC) -> tuple[Network, list[str]]:
    """A network and its languages, from the given labelled rows (doc_id, text, lang; no null lang).

    Learns from at most docs_per_lang documents a language, those with the least hash of doc_id, and from at most
    twice words_per_doc words of each, taken evenly from the whole text. These are the bounds of what comes to the
    driver, whatever rows share a doc_id. The ids are chosen before any text is read.
    """
    ids = docs.where("doc_id is not null and lang is not null").select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = [r[0] for r in ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs_per_lang).select("doc_id").collect()]
    if not chosen:
        return Network(1), []
    rows = docs.where(F.col("doc_id").isin(chosen) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("lang"), F.col("text"))
    repeated = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))  # rows that share a doc_id count too
    rows = rows.withColumn("_n", F.row_number().over(repeated)).where(F.col("_n") <= docs_per_lang).drop("_n")
    found = rows.mapInArrow(partial(sampled, words_per_doc=words_per_doc), "doc_id long, lang string, words binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["words"])))
    langs = sorted({r["lang"] for r in found})
    rows = [(s, langs.index(r["lang"])) for r in found for w in bytes(r["words"]).split() for s in sequences(w)]
    if not rows:
        return Network(1), []
    return Network(len(langs)).fit([s for s, _ in rows], [y for _, y in rows]), langs


def identify(docs: DataFrame, network: Network, langs: list[str]) -> DataFrame:
    """doc_id, lang_pred, score of every row from its whole text alone.

    Every position of every word is labelled; a document's score for a language is the geometric mean of the
    positions' probabilities, scaled to sum to 1 over the languages. ``und`` with score 0 if the text is null or
    has no letter, or if no language was learned. Rows are independent; each worker remembers a bounded number
    of words. Other columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small.mapInArrow(partial(predicted, network=network, langs=langs), SCHEMA)


def keep_identified(docs: DataFrame, network: Network, langs: list[str], least: float) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with at least the given score."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(partial(accepted, network=network, langs=langs, text=docs.columns.index("text"), least=least), docs.schema)


def held_out() -> Column:
    """Whether the row takes no part in learning: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the labelled rows that are not held out and predicts all rows."""
    network, langs = train(docs.select("doc_id", "text", "lang").where(~held_out()))
    return identify(docs, network, langs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Token counts of a unigram tokenizer, without making the tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.memo import CLEAR, Memo, claim, coded
from lumaframe.llm.shared import small_batches

UNKNOWN_PENALTY = 10.0
#: Pieces of a vocabulary that is given as a table, at most.
MOST_PIECES = 1_000_000
SPACE = "▁"
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64()), ("score", pa.float64())])


def vocabulary(path: str | tuple) -> list[tuple[str, float]]:
    """The pieces and log probabilities given, or those of the file at a path: a unigram model's own, where the file is the JSON of
    a ``tokenizers`` model of that kind, otherwise those of a piece model by Zipf's law over its ranks."""
    if not isinstance(path, str):
        return list(path)
    if path.endswith(".json"):
        import json

        model = json.load(open(path, encoding="utf-8"))["model"]
        if model["type"] != "Unigram":
            raise ValueError("not a unigram model")
        return [(p, float(s)) for p, s in model["vocab"]]
    return ranked_pieces(path)


def ranked_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces in the order of their ids, with log probabilities by Zipf's law over that order.

    The public model file ranks its pieces but has no unigram probabilities; the piece of rank r (from 1, after
    the special pieces) gets log(1 / r), scaled to sum to 1. Special and byte pieces get the least of these.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = [model.is_unknown(i) or model.is_control(i) or model.is_byte(i) for i in range(len(model))]
    total = math.log(sum(1 / r for r in range(1, special.count(False) + 1)))
    least, rank, out = -math.log(special.count(False)) - total, 0, []
    for i, odd in enumerate(special):
        rank += not odd
        out.append((model.id_to_piece(i), least if odd else -math.log(rank) - total))
    return out


class Counter:
    """Best score and number of pieces of a word by dynamic programming over its code points.

    An Aho-Corasick automaton lists the pieces that end at each place, longest first. The tie rule is that of the
    tokenizers: of equal scores the piece that starts first wins. A code point which no piece of its own covers
    may stand as unknown, at UNKNOWN_PENALTY below the least score; it counts as its UTF-8 bytes if the vocabulary
    has all byte pieces, otherwise a run of unknown code points counts as one.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        have = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in have for b in range(256))

    def word(self, text: str) -> tuple[int, int, float]:
        """Pieces, unknown code points, score."""
        n, at = len(text), 0
        score, count, odd, run = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        single, unknown = self.single, self.unknown

        def lone(e: int) -> None:
            """The code point before e as unknown."""
            if text[e - 1] not in single and (s := score[e - 1] + unknown) > score[e]:
                score[e], odd[e], run[e] = s, odd[e - 1] + 1, True
                count[e] = count[e - 1] + (len(text[e - 1].encode("utf-8", "surrogatepass")) if self.bytes else not run[e - 1])

        for end, (length, s) in self.automaton.iter(text):
            e = end + 1
            while at < end:
                at += 1
                lone(at)
            if (s := score[e - length] + s) > score[e]:
                score[e], count[e], odd[e], run[e] = s, count[e - length] + 1, odd[e - length], False
        while at < n:
            at += 1
            lone(at)
        return count[n], odd[n], score[n]


@lru_cache(maxsize=4)
def counter(path: str | tuple) -> Memo:
    word = Counter(vocabulary(path)).word
    return Memo(lambda words: [word(SPACE + w) for w in words])


CLEAR.append(counter.cache_clear)


def counted(batches: Iterable[pa.RecordBatch], path: str | tuple) -> Iterator[pa.RecordBatch]:
    claim(f"counts {path if isinstance(path, str) else hash(path)}")
    memo = counter(path)
    for batch in batches:
        done = 0
        for n, codes, words, first in coded(batch.column(1), "unicode"):
            ids = batch.column(0).slice(done, n)
            done += n
            values = np.array(memo(words), np.float64).reshape(-1, 3)
            sums = np.zeros((n, 3))
            some = np.flatnonzero(np.diff(first))
            if len(some):
                sums[some] = np.add.reduceat(values[codes], first[some])
            columns = [ids, pa.array(np.diff(first)), *[pa.array(sums[:, k].astype(np.int64)) for k in (0, 1)], pa.array(sums[:, 2])]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def count_tokens(docs: DataFrame, model: str | DataFrame) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown, score of each row, by a vocabulary: a model file's (its path; see vocabulary),
    or a table of piece and score (log probability), of MOST_PIECES rows at most, which each task gets; ids rise with the
    score's fall.

    Words are separated by white space; each is counted with a leading space mark. A null or blank text has no
    words and no tokens; texts of any length are taken whole, an empty table gives no rows. Rows with equal or null doc_id stay
    apart. One pass over the texts, without a shuffle; each Python worker remembers a bounded number of words. Other
    columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    if isinstance(model, DataFrame):
        rows = model.select(F.col("piece").cast("string"), F.col("score").cast("double")).limit(MOST_PIECES + 1).collect()
        if not 0 < len(rows) <= MOST_PIECES:
            raise ValueError(f"a vocabulary has 1 to {MOST_PIECES} pieces")
        model = tuple(sorted((tuple(r) for r in rows), key=lambda r: (-r[1], r[0])))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small.mapInArrow(partial(counted, path=model), SCHEMA)

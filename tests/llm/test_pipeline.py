"""run() against its stages in plain Python, on a small corpus with every kind of row."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumaframe.llm import queries
from tests.llm.test_near_copies import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, mark string, root int, id int, key int, _row int, _mark int"
#: Words of three made languages, which share no letters.
LETTERS = {"xa": "abcdefgh", "xb": "ijklmnop", "xc": "äöüßéèñç"}


def prose(rng, lang, n):
    letters = LETTERS[lang]
    return [("".join(letters[int(k)] for k in rng.integers(0, 8, int(rng.integers(2, 9))))) for _ in range(n)]


def corpus():
    """Rows, and benchmark items of 5 to 60 tokens."""
    rng, rows, items = np.random.default_rng(11), [], []
    for i in range(90):
        lang = list(LETTERS)[i % 3]
        rows.append((i, " ".join(prose(rng, lang, int(rng.integers(40, 90)))), lang))
    for n in (5, 8, 10, 11, 12, 30, 60):
        items.append((n, " ".join(prose(rng, "xa", n))))
    at = 100
    for i in range(0, 30, 3):  # near copies around the limit, exact ones, and one more of each
        w = rows[i][1].split()
        for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[int(k)] = "xchanged"
        rows += [(at, " ".join(w), "xa"), (at + 1, rows[i][1], None)]
        at += 2
    for n, text in items:  # whole items, items with allowed and with too many other words
        w = text.split()
        allowed = min(n, 12) - -(-min(n, 12) * 8 // 10)
        for k in range(0, allowed + 2):
            v = list(w)
            places = [0, *(int(x) for x in np.linspace(1, min(n, 12) - 1, max(1, k)))] if n < 12 else list(range(k))
            for p in places[:k]:
                v[p] = "zzz"
            rows.append((at, " ".join([*prose(rng, "xa", 25), *v, *prose(rng, "xa", 25)]), "xa"))
            at += 1
    shared = rows[40][1]
    rows += [(None, " ".join(prose(rng, "xb", 50)), "xb"), (None, shared, "xb"), (7, " ".join(prose(rng, "xc", 50)), "xc"), (7, " ".join(prose(rng, "xc", 50)), "xc"), (7, rows[7][1], "xb")]
    rows += [(500, None, "xa"), (501, "", "xa"), (502, "123 456 !!!", "xa"), (503, " \n", None), (504, "z" * 3, None), (505, " ".join(prose(rng, "xb", 30_000)), "xb")]
    return rows, items


def overlapping(text, items):
    """Whether some place of an item on the text has a window of 12 tokens (all of a shorter item) that agrees in 8 of 10."""
    words = lambda t: ["".join(c for c in w if c.isalnum()) for w in t.lower().split()]
    doc = words(text)
    for _, item in items:
        w = words(item)
        for shift in range(-len(w) + 1, len(doc)):
            agree = [0 <= shift + k < len(doc) and doc[shift + k] == x for k, x in enumerate(w)]
            size = min(12, len(w))
            if any(sum(agree[k : k + size]) >= 0.8 * size for k in range(len(w) - size + 1)):
                return True
    return False


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    data = [(i, t, lang, "s", 1, 2, "m", 3, 4, 5, 6, 7) for i, t, lang in rows]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_run_against_plain_stages(spark, folder):
    rows, items = corpus()
    spoken = [(i, t) for i, t, _ in rows if t and any(map(str.isalpha, t))]
    kept = [r for r in spoken if r != (504, "zzz")]  # a made word of no language may go or stay
    names = {k: r for k, r in enumerate(dict.fromkeys(kept))}
    order = sorted(names, key=lambda k: (names[k][0] is None, names[k][0] or 0, names[k][1]))
    classes = brute_components([(n, names[k][1]) for n, k in enumerate(order)])
    alone = [names[order[n]] for n in classes if classes[n] == n]
    want = Counter(r for r in alone if not overlapping(r[1], items))
    assert len(spoken) > len(kept) > len(alone) > len(want) > 80

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        docs = after.cache()
    got = Counter((r["doc_id"], r["text"]) for r in docs.collect() if r["text"] != "zzz")
    assert got == want

    out = corpus_pipeline.run(spark, folder).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    ids = {}
    for i, t in (got + Counter([(504, "zzz")] if any(r["doc_id"] == 504 for r in out) else [])).elements():
        ids.setdefault(i, []).append([*tokenizer.encode(t, add_special_tokens=False).ids, 2])
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        assert sum(r["length"] for r in found) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            for r in found:
                part = np.array(ids[i][0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
                assert zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[i][0])
    for s in {r["sequence_id"] for r in out}:
        spans = sorted((r["offset"], r["length"]) for r in out if r["sequence_id"] == s)
        assert [a for a, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist()
        total = sum(n for _, n in spans)
        assert total <= 4096 and total & (total - 1) == 0


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

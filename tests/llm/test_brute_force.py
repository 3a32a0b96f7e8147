"""Multiset fingerprints and language labels against plain versions that share no code with the operators' rows."""

import hashlib
import math
import struct
import zlib

import numpy as np
import xxhash

from lumaframe.llm import language_id, multiset_hash

SCHEMA = "doc_id long, text string, lang string, block int, own int, pos int, sha string, unit int, n_units int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "s", 4, 5) for r in rows], SCHEMA)


def chained(*values):
    """Spark's xxhash64 of strings and whole numbers, nulls left out."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<i", v) if isinstance(v, int) else v.encode(), h)
    return h


def plain_print(text):
    """(n, identity lanes, word-pair lanes)."""
    ident, lanes, n = [0] * 8, [0] * 64, 0
    for p in text.split("\n"):
        for k in range(8):
            ident[k] = (ident[k] + (chained(p, k) & 0xFFFFFFFF)) % (1 << 32)
        w = p.split(" ")
        for a, b in zip(w, [*w[1:], None], strict=True):
            u = chained(a, b)
            n += 1
            for bit in range(64):
                lanes[bit] += u >> bit & 1
    return n, ident, lanes


def as_text(f):
    return f"{f[0]:016x}" + "".join(f"{x % (1 << 32):08x}" for x in f[1] + f[2])


def likeness(f, g):
    if f == g:
        return 1.0
    x, y = (np.array([2 * c - h[0] for c in h[2]], float) for h in (f, g))
    size = math.sqrt(float(x @ x) * float(y @ y))
    return 0.0 if size == 0 else max(0.0, min(1.0, float(x @ y) / size))


def test_multiset_fingerprints(spark):
    rng = np.random.default_rng(0)
    prose = lambda n: " ".join(f"w{int(k)}" for k in rng.integers(0, 40, n))
    rows = [(i, "\n".join(prose(int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 6))))) for i in range(20)]
    rows += [(30, None), (31, ""), (32, "é ü\n\n  x"), (33, rows[3][1]), (34, prose(20_000)), (35, "one")]
    got = {r["doc_id"]: r for r in multiset_hash.edited_fingerprints(documents(spark, [(i, t, "l") for i, t in rows])).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        mine, theirs, following = plain_print(text), plain_print(edited), plain_print(after)
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == as_text(mine) and r["edited_fingerprint"] == as_text(theirs)
        assert abs(r["near_edited"] - likeness(mine, theirs)) < 1e-9 and abs(r["near_next"] - likeness(mine, following)) < 1e-9


def test_rows_without_or_with_one_doc_id_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "BLOCK", 4)
    rows = [(i, f"text {i}\nx {i * i}") for i in range(30)] + [(None, f"none {i} a b c d e f") for i in range(20)] + [(7, f"seven {i}") for i in range(20)] + [(7, "seven 1")] * 9
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in multiset_hash.edited_fingerprints(documents(spark, [(*r, "l") for r in rows])).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), np.uint64(chained(r[1])).astype(np.int64)))
    want = [(i, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()) for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_labels_of_whole_texts(spark):
    """The same network, a byte at a time and a text at a time."""
    rng = np.random.default_rng(1)
    network, langs = language_id.Network(3), ["xa", "xb", "xc"]
    rows = [(i, " ".join("".join(chr(97 + int(k)) for k in rng.integers(0, 26, int(rng.integers(1, 12)))) for _ in range(int(rng.integers(1, 30)))), None) for i in range(12)]
    rows += [(20, "é" * 40 + " ß", None), (21, None, None), (22, "12 !", None), (None, "abc", None), (3, "again", None)]
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language_id.identify(documents(spark, rows), network, langs).collect())
    p = {k: v.astype(float) for k, v in network.p.items()}

    def states(seq, d):
        k, h, out = network.hidden, np.zeros(network.hidden), []
        for b in seq:
            a, r_ = p[f"in_{d}"][b] + p[f"add_{d}"], h @ p[f"rec_{d}"]
            z, r = (1 / (1 + np.exp(-(a[j : j + k] + r_[j : j + k]))) for j in (0, k))
            h = (1 - z) * np.tanh(a[2 * k :] + r * r_[2 * k :]) + z * h
            out.append(h)
        return out

    want = []
    for i, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            want.append((str(i), "und", 0.0))
            continue
        logs = []
        for word in text.encode().split():
            for seq in language_id.sequences(word):
                for f, b in zip(states(seq, "f"), states(seq[::-1], "b")[::-1], strict=True):
                    y = np.concatenate([f, b]) @ p["out"] + p["bias"]
                    logs.append(y - np.log(np.exp(y).sum()))
        chances = np.exp(np.mean(logs, axis=0))
        want.append((str(i), langs[int(chances.argmax())], float(chances.max() / chances.sum())))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in language_id.languages(docs).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert len(rows) > 40 and all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) >= 0.95

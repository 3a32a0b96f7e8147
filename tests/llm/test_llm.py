"""The corpus operators against brute force on small tables, with nulls, ties, repeats, empty tables and long texts."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lumaframe.llm import decontamination, elias_fano, html_text, language_id, licenses, lm_scoring, multiset_hash, packing, sharding, simhash, token_counts
from lumaframe.llm.components import components

TOKENIZER, PIECES = "/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, size int"


def documents(spark, texts, langs=None):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, (langs or {}).get(i), "s", None, 0.5, 9, 1) for i, t in texts], SCHEMA)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{int(k)}" for k in rng.zipf(1.3, n) % vocabulary)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    out = [(i, words(rng, int(rng.integers(1, 80))) + "\n" + words(rng, 20)) for i in range(60)]
    out += [(60, None), (61, ""), (62, " \n\t "), (63, "one"), (64, "x" * 5000), (65, words(rng, 9000)), (66, out[3][1]), (67, out[3][1]), (68, "Ünïcode  é x, end."), (69, "12 34 !!")]
    return out


def test_feistel_shards(spark, texts):
    docs = documents(spark, texts + texts[:5] + [(None, "a"), (None, None)])
    got = sharding.shard_documents(docs, 4).toPandas()
    assert len(got) == len(texts) + 7 and got["shard"].value_counts().max() - got["shard"].value_counts().min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = {i: len((t or "").encode()) + 1 for i, t in texts}
    assert all(sizes[int(r.doc_id)] == r.size for r in got.itertuples() if r.doc_id == r.doc_id)
    again = sharding.shard_documents(docs.repartition(7), 4).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist() or got[key].sort_values(["shard", "slot"])["text_crc32"].tolist() == again[key].sort_values(["shard", "slot"])["text_crc32"].tolist()
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 290, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = spark.range(n).select(sharding.permuted("id", n, 5)).collect()
    assert sorted(r[0] for r in got) == list(range(n))


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_simhash(spark, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts}
    assert {i: int.from_bytes(r["fp"], "little") for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints, 2)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    nulls = simhash.near_duplicates(documents(spark, [(None, "a b c"), (None, "a b c"), (5, "a b c")])).collect()
    assert [r["component_id"] for r in nulls] == [5, 5, 5]


def test_golay_keys_find_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    prints = [int(x) for x in base] + [int(x) ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64)) for x in base for _ in range(8)]
    prints = list(dict.fromkeys(prints))
    rows = [(int(np.uint64(p).astype(np.int64)), p.to_bytes(8, "little")) for p in prints]
    found = simhash.links(spark.createDataFrame(rows, "id long, fp binary"), 2)
    roots = {r["id"]: r["root"] for r in components(found).collect()}
    ours = defaultdict(set)
    for i, _ in rows:
        ours[roots.get(i, i)].add(i)
    theirs = defaultdict(set)
    for k, v in brute_components(dict(enumerate(prints)), 2).items():
        theirs[v].add(rows[k][0])
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    prints = [(1 << 40) + (1 << k) for k in range(22)] + [1 << 40]
    rows = [(p, p.to_bytes(8, "little")) for p in prints]
    found = simhash.links(spark.createDataFrame(rows, "id long, fp binary"), 2)
    assert {r["root"] for r in components(found).collect()} == {min(prints)}


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_multiset_hash(spark, texts):
    got = {r["doc_id"]: r for r in multiset_hash.edited_fingerprints(documents(spark, texts)).collect()}
    order = sorted(texts, reverse=True, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_next"] <= 1
    assert got[66]["fingerprint"] == got[67]["fingerprint"] == got[3]["fingerprint"] != got[4]["fingerprint"]
    assert got[66]["near_next"] < 1 and got[67]["near_next"] == 1
    lone = multiset_hash.edited_fingerprints(documents(spark, [(None, "abc\nabc")])).first()
    assert lone["edited_sha256"] == hashlib.sha256(b"abc\nab" + b"ab").hexdigest() or lone["near_next"] == 1
    assert multiset_hash.edited_fingerprints(documents(spark, [])).count() == 0


def test_multiset_hash_is_homomorphic(spark):
    from pyspark.sql import functions as F

    a, b = "one two three\nfour five", "six seven\none two three"
    df = spark.createDataFrame([(0, a), (1, b), (2, f"{a}\n{b}"), (3, "six seven\nfour five\none two three\none two three")], "k int, t string")
    got = multiset_hash.fingerprints(df, ["k"], "t").select("k", multiset_hash.written(F.col("n_units"), F.col("ident"), F.col("lanes")).alias("f"))
    f = {r["k"]: r["f"] for r in got.collect()}
    assert f[2] == f[3]
    both = spark.createDataFrame([(f[0], f[1], f[2])], "a string, b string, c string").select(multiset_hash.combined(F.col("a"), F.col("b")).alias("sum"), multiset_hash.combined(F.col("c"), F.col("b"), -1).alias("less")).first()
    assert both["sum"] == f[2] and both["less"] == f[0]


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(documents(spark, texts), TOKENIZER).toPandas()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts}
    for i, g in got.sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == ids[i] and (g.doc_tokens == len(ids[i])).all()
        assert g.start.tolist() == (g.length.cumsum() - g.length).tolist()
    assert got.doc_id.nunique() == len(texts)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        n = int(g.length.sum())
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and n <= 4096 and n & (n - 1) == 0
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents(spark, []), TOKENIZER, tiers=(512, 1000))


def test_language(spark):
    rng = np.random.default_rng(0)
    sounds = {"aa": ["ka", "ko", "ta"], "bb": ["sch", "ung", "ein"]}
    rows = [(i, " ".join("".join(rng.choice(sounds["ab"[i % 2] * 2], 3)) for _ in range(30))) for i in range(120)]
    langs = {i: "ab"[i % 2] * 2 for i, _ in rows}
    extra = [(200, None), (201, ""), (202, "12 !!"), (203, "kakata"), (204, "schungein" * 900)]
    got = {r["doc_id"]: r for r in language_id.languages(documents(spark, rows + extra, langs)).collect()}
    held = [i for i in langs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i]["held_out"] and got[i]["lang_pred"] == langs[i] for i in held)
    assert [got[i]["lang_pred"] for i in range(200, 205)] == ["und", "und", "und", "aa", "bb"] and got[200]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.languages(documents(spark, rows)).collect()} == {"und"}
    assert language_id.languages(documents(spark, [])).count() == 0


def test_gradients():
    net = language_id.Network(3, hidden=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(0, 256, (5, 6)), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.mean(net.log_probabilities(x)[0][np.arange(5)[:, None], np.arange(6)[None, :], y[:, None]])
    grads = net.gradients(x, y)
    for k in ("out", "rec_f", "in_b", "add_b", "bias"):
        i = tuple(np.argwhere(np.abs(grads[k]) == np.abs(grads[k]).max())[0])
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        down = loss()
        net.p[k][i] = old
        assert (up - down) / 2e-3 == pytest.approx(grads[k][i], rel=2e-2), k


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    items = {i: [f"b{int(k)}" for k in rng.integers(0, 400, 30)] for i in range(8)}
    items[8] = ["only", "four", "short", "words"]
    fill = lambda n: [f"f{int(k)}" for k in rng.integers(0, 900, n)]
    rows, dirty = [], set()
    for k in range(60):
        w = fill(60)
        if k % 3 == 0:
            part = list(items[k % 8][5:20])
            for j in rng.choice(len(part), 2, replace=False) if k % 2 else []:
                part[j] = "other"
            w[20:20] = part
            best = max(sum(a == b for a, b in zip(part[s : s + 12], items[k % 8][5 + s : 17 + s], strict=True)) for s in range(4))
            if best >= 10:
                dirty.add((k, k % 8))
        rows.append((k, " ".join(w).title() if k % 2 else ", ".join(w)))
    rows += [(100, None), (101, ""), (102, "so only four short words here"), (103, "only four short")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(documents(spark, rows), bench).collect()}
    assert got == dirty | {(102, 8)}
    left = decontamination.decontaminated(documents(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in got} and left.columns[:2] == ["doc_id", "text"]
    assert decontamination.overlaps(documents(spark, rows), bench.limit(0)).count() == 0


def test_masks_cover_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(decontamination.WINDOW), 2):
        assert any(not any(s + o in bad for o in m) for m in decontamination.MASKS for s in range(decontamination.WINDOW - m[-1]))


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer, models

    vocabulary = token_counts.vocabulary(PIECES)
    exact = Tokenizer(models.Unigram(vocabulary, 0, True))
    got = {r["doc_id"]: r for r in token_counts.count_tokens(documents(spark, texts), PIECES).collect()}
    for i, t in texts:
        w = (t or "").split()
        assert got[i]["n_words"] == len(w)
        assert got[i]["n_tokens"] == sum(len(e.ids) for e in exact.encode_batch([token_counts.SPACE + x for x in w])), i
    assert token_counts.count_tokens(documents(spark, []), PIECES).count() == 0


def test_count_ties_follow_the_tokenizer():
    from tokenizers import Tokenizer, models

    rng = np.random.default_rng(0)
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "bab", "abab", "c"]
    vocabulary = [(p, -float(len(p)) if p != "<unk>" else -20.0) for p in pieces]
    exact, ours = Tokenizer(models.Unigram(vocabulary, 0, False)), token_counts.Counter(vocabulary)
    for _ in range(300):
        text = "".join(rng.choice(list("abcd"), int(rng.integers(1, 12))))
        assert ours.word(text)[0] == len(exact.encode(text).ids), text


def test_html():
    text = html_text.main_text
    assert text("") == "" and text("<p>hi") == "hi" and text("<nav><a href=x>y</a></nav>") == ""
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><header>H</header><nav><ul><li><a href='/a>b'>x</a></ul></nav><div class='cookie-notice'>We use</div><article><header><h1>T&amp;t</h1></header><p>a <b>b</b>c<br>d\n e</p><form>f</form><div class='ad'>buy</div><p>last &lt;one&gt;</p><section id='comments'><p>first!</p></section></article><aside>s</aside><footer>f</footer>"
    assert text(page) == "T&t\na bc d e\nlast <one>"
    long = "word " * 60
    assert text(f"<div class=menu>m</div><div id=content><h1>Head</h1><p>{long}<p>short<div class=comments><p>{long}</div></div>") == f"Head\n{long.strip()}\nshort"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 3), (1, "u", "<p>a</p>", 3), (2, None, None, 4), (None, "v", "", 5)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a"), (1, "u", "a"), (2, None, ""), (None, "v", "")], key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_licenses(spark):
    whole = "Copyright (c) 2020 Someone\n\n" + licenses.TEXTS["MIT"].upper().replace("LICENSE", "LICENCE").replace(",", " ,")
    rows = [(1, whole), (2, "text\nreleased under the MIT licence\nmore"), (3, None), (4, ""), (5, "Released under the MIT License, mostly."), (6, "Licensed under the Apache License, v 2.0."), (2, "x\nReleased under the MIT License!")]
    got = sorted((r["doc_id"], r["scope"], r["license_id"], r["n"]) for r in licenses.license_scan(documents(spark, rows)).collect())
    assert got == [(1, "document", "MIT", 1), (2, "line", "MIT", 2), (6, "document", "Apache-2.0", 1)]
    assert licenses.license_scan(documents(spark, [])).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for values in ([0], [5, 5, 5], rng.integers(0, 1 << 63, 1000), rng.integers(0, 300, 5000), np.arange(100), [0, (1 << 64) - 1]):
        values = np.sort(np.array(values, np.uint64))
        ef = elias_fano.EliasFano.build(values)
        assert (ef[np.arange(len(values))] == values).all()
        probes = np.concatenate([values[:50], values[:50] + np.uint64(1)])
        assert (ef.first_not_below(probes) == np.searchsorted(values, probes)).all()


def escapes(grams, context):
    """The escape of each context: how often grams were seen once, by what their context's count is without them."""
    alone, seen = Counter(), Counter()
    for g, n in grams.items():
        if context[g[:-1]] > 1:
            k = int(lm_scoring.bucket(np.array([context[g[:-1]] - 1]))[0])
            alone[k] += n == 1
            seen[k] += n
    return lambda u: min(0.999, max(0.001, (alone[k := int(lm_scoring.bucket(np.array([context[u]]))[0])] + 0.9) / (seen[k] + 1)))


@pytest.mark.parametrize(("order", "least"), [(3, 2), (3, 1), (2, 1)])
def test_lm_scores(spark, texts, order, least, monkeypatch):
    """Against a brute-force model in dictionaries. Small tables are held, so that counts are merged from many runs."""
    monkeypatch.setattr(lm_scoring, "PAIRS_PER_SHARD", 700)
    model = lm_scoring.train(documents(spark, texts).where(~lm_scoring.held_out()), order, least)
    got = {r["doc_id"]: r for r in model.score(documents(spark, texts)).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts}
    train = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    counts, pairs, triples, context = Counter(), Counter(), Counter(), Counter()
    for i in train:
        counts.update(tokens[i])
        for a, b, c in zip([None, None, *tokens[i]], [None, *tokens[i]], tokens[i], strict=False):
            pairs[b, c] += 1
            triples[b, a, c] += 1
            context[b,] += 1
            context[b, a] += 1
    total, size = sum(counts.values()), len(counts)
    base = lambda w: math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1)))
    two, three = escapes(pairs, context), escapes(triples, context)
    kept = Counter()
    for g, n in triples.items():
        kept[g[:-1]] += n if n >= least else 0

    def after_one(b, c):
        if pairs[b, c]:
            return math.log10((1 - two((b,))) * pairs[b, c] / context[b,] + two((b,)) * 10 ** base(c))
        return base(c) + (math.log10(two((b,))) if context[b,] else 0)

    def after_two(a, b, c):
        e, shorter = three((b, a)), after_one(b, c)
        left = 1 - (1 - e) * kept[b, a] / context[b, a] if kept[b, a] else 1
        if triples[b, a, c] >= least:
            return math.log10((1 - e) * triples[b, a, c] / context[b, a] + left * 10**shorter)
        return shorter + math.log10(left)

    assert model.train_tokens == total
    for i, w in tokens.items():
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(counts[x] > 0 for x in w)
        assert got[i]["base_score"] == pytest.approx(sum(map(base, w)), rel=1e-9)
        score = sum(after_two(a, b, c) if order == 3 else after_one(b, c) for a, b, c in zip([None, None, *w], [None, *w], w, strict=False))
        assert got[i]["score"] == pytest.approx(score, abs=2 * len(w) / lm_scoring.STEP + 1e-4 * len(w))


def test_lm_rows(spark):
    rows = documents(spark, [(1, "a b"), (1, "a b"), (None, "a"), (None, None), (3, "")])
    got = lm_scoring.scores(rows).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 3]
    assert lm_scoring.scores(documents(spark, [])).count() == 0


def test_runs_in_one_sequence():
    rng = np.random.default_rng(8)
    runs = [np.unique(rng.integers(0, 50, int(rng.integers(1, 30)))) for _ in range(200)]
    first = np.cumsum([0] + [len(r) for r in runs])
    held = elias_fano.Runs(elias_fano.Runs.build(np.concatenate(runs), first))
    for k in range(0, 200, 7):
        at = held.find(np.arange(50), np.full(50, first[k]), np.full(50, first[k + 1]))
        assert [int(v) for v in np.flatnonzero(at >= 0)] == runs[k].tolist()
        assert (at[runs[k]] == first[k] + np.arange(len(runs[k]))).all()


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns and docs.count() > 0, name
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) == kept["decontamination"]
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()


def test_searches_in_wide_ranges_are_narrowed():
    """By the high parts: the same places as by halving whole ranges, and fewer values looked at."""
    from lumaframe.llm.elias_fano import EliasFano

    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 5), (5, 3), (1000, 300), (5000, 10**9), (70_000, 2**40), (3000, 2**63)):
        v = np.sort(rng.integers(0, top + 1, n, dtype=np.uint64))
        kept = EliasFano.build(v, narrowed=True)
        kept = EliasFano.of(kept.arrays("x"), "x")
        asked = np.concatenate([v, v + np.uint64(1), rng.integers(0, top + 2, 3000, dtype=np.uint64), np.array([0, top + 1000, 2**64 - 1], np.uint64)])
        low = rng.integers(0, n + 1, len(asked))
        high = np.maximum(low, rng.integers(0, n + 1, len(asked)))
        assert (kept.first_not_below(asked, low, high) == np.clip(np.searchsorted(v, asked), low, high)).all(), (n, top)
        low, high = kept.narrow(asked, np.zeros(len(asked), np.int64), np.full(len(asked), n))
        assert n < 5000 or np.median(high - low) < 8


def test_values_are_found_by_their_low_bits(monkeypatch):
    """After the high parts have narrowed a search, no whole value is read for it: not of sequences, runs or contexts, even or skewed."""
    from lumaframe.llm.elias_fano import EliasFano, Runs
    from lumaframe.llm.lm_scoring import Contexts

    rng = np.random.default_rng(2)
    for n, top in ((0, 0), (1, 0), (1, 5), (200, 300), (5000, 10**9), (70_000, 2**40), (3000, 2**63)):
        v = np.unique(np.concatenate([rng.integers(0, top + 1, n, dtype=np.uint64), np.arange(n // 3, dtype=np.uint64)]))
        kept = EliasFano.of(EliasFano.build(v, narrowed=True).arrays("x"), "x")
        both = kept.two_at(np.arange(max(0, len(v) - 1)))
        assert (both[0] == v[:-1]).all() and (both[1] == v[1:]).all()
        asked = np.concatenate([v, v + np.uint64(1), rng.integers(0, top + 2, 3000, dtype=np.uint64), np.array([0, top + 1000, 2**64 - 1], np.uint64)])
        place = np.searchsorted(v, asked)
        there = np.append(v, np.uint64(0))[place] == asked
        there &= place < len(v)
        low = rng.integers(0, len(v) + 1, len(asked))
        high = np.maximum(low, rng.integers(0, len(v) + 1, len(asked)))
        with monkeypatch.context() as m:
            m.delattr(EliasFano, "__getitem__")
            assert (kept.find(asked) == np.where(there, place, -1)).all(), (n, top)
            assert (kept.find(asked, low, high) == np.where(there & (place >= low) & (place < high), place, -1)).all(), (n, top)
    first = np.cumsum([0, 1, 4000, 2, 1, 700])
    runs = [np.sort(rng.choice(top, n, replace=False)) for n, top in zip(np.diff(first), (1, 10**6, 10**9, 50, 701), strict=True)]
    held = Runs(Runs.build(np.concatenate(runs), first))
    for k, run in enumerate(runs):
        asked = np.concatenate([run, run + 1, rng.integers(0, 10**9, 500)])
        place = np.minimum(np.searchsorted(run, asked), len(run) - 1)
        assert (held.find(asked, np.full(len(asked), first[k]), np.full(len(asked), first[k + 1])) == np.where(run[place] == asked, first[k] + place, -1)).all()
    size = 100_000
    one = np.concatenate([np.full(50_000, 7), rng.integers(0, size, 20_000), np.full(3, size - 1)])
    context = np.unique(one.astype(np.uint64) << np.uint64(32) | rng.integers(0, size, len(one), dtype=np.uint64))
    contexts = Contexts(Contexts.build(context, size))
    asked = np.concatenate([context, context + np.uint64(1), rng.integers(0, size, 5000, dtype=np.uint64) << np.uint64(32)])
    place = np.minimum(np.searchsorted(context, asked), len(context) - 1)
    one, two = ((x).astype(np.int64) for x in (asked >> np.uint64(32), asked & np.uint64(0xFFFFFFFF)))
    some = two < size
    assert (contexts.find(one, two) == np.where(context[place] == asked, place, -1))[some].all()
    values = contexts.sequence[np.arange(len(context))]
    low, high = contexts.sequence.narrow(values, np.zeros(len(values), np.int64), np.full(len(values), len(values)))
    assert (high - low).mean() < 6


def test_rows_are_counted_as_one_number_or_by_columns():
    rng = np.random.default_rng(3)
    for below in (1, 2, 9, 1 << 21, (1 << 21) + 1, 1 << 40):
        columns = [np.append(rng.integers(0, min(below, 9), 2000), below - 1) for _ in range(3)]
        rows, counts = lm_scoring.ranked(columns, below)
        want = sorted(Counter(zip(*(c.tolist() for c in columns), strict=True)).items())
        assert list(zip(*(c.tolist() for c in rows), strict=True)) == [k for k, _ in want] and counts.tolist() == [n for _, n in want]


def test_many_sequences_are_asked_together(monkeypatch):
    """Few questions to each of many sequences: the same answers as one by one, and the arithmetic is done once, not once a sequence."""
    rng = np.random.default_rng(4)
    values = [np.unique(rng.integers(0, int(top), int(n), dtype=np.uint64)) for n, top in zip(rng.integers(1, 400, 300), 2.0 ** rng.integers(0, 60, 300), strict=True)]
    held = [elias_fano.EliasFano.build(v, narrowed=True) for v in values]
    which = np.sort(rng.integers(0, 300, 3000))
    at = np.array([rng.integers(0, held[k].n) for k in which])
    asked = np.array([values[k][i] for k, i in zip(which, at, strict=True)]) + rng.integers(0, 2, 3000).astype(np.uint64)
    want = [int(np.searchsorted(values[k], x)) if x in values[k] else -1 for k, x in zip(which, asked, strict=True)]
    calls, place_in = [], elias_fano.place_in
    monkeypatch.setattr(elias_fano, "place_in", lambda *a: calls.append(1) or place_in(*a))
    several = elias_fano.Several(held, which)
    assert several.find(asked).tolist() == want
    assert several[at].tolist() == [int(values[k][i]) for k, i in zip(which, at, strict=True)]
    some = np.flatnonzero(at < several.n - 1)
    assert [x.tolist() for x in several.part(some).two_at(at[some])] == [[int(values[which[j]][at[j] + d]) for j in some] for d in (0, 1)]
    assert len(calls) < 10
    monkeypatch.setattr(elias_fano, "TOGETHER", 100)
    assert several.find(asked).tolist() == want

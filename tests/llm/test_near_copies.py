"""The pipeline's near-duplicates against all pairs by brute force."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lumaframe.llm import decontamination, near_copies
from lumaframe.llm.shingle_sets import compared


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_sets(rows):
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}


def brute_components(rows, share=0.8):
    sets = brute_sets(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 100 >= round(share * 100) * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in sets}


def around(rng, pairs, least=40, most=160):
    """Texts and their edited copies, at similarities around 0.8."""
    out = []
    for k in range(pairs):
        w = [f"w{int(x)}" for x in rng.integers(0, 5000, int(rng.integers(least, most)))]
        out.append((2 * k, " ".join(w)))
        edits = max(1, round(len(w) * float(rng.uniform(0.01, 0.035))))
        for at in rng.integers(0, len(w), edits):
            w[int(at)] = "Changed"
        out.append((2 * k + 1, "\n".join(w)))
    return out


def test_pairs_around_the_limit_are_complete(spark):
    rows = around(np.random.default_rng(0), 200)
    want = brute_components(rows)
    assert 40 < sum(want[i] != i for i in want) < 160
    left = {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, documents(spark, rows), "").collect()}
    assert left == {i for i in want if want[i] == i}


def test_classes_with_groups_and_short_texts(spark):
    rng = np.random.default_rng(1)
    rows = around(rng, 20)
    base = [f"g{k}" for k in range(80)]
    for k in range(60):  # one large group whose members need not be near to its least
        w = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 4))):
            w[int(at)] = f"x{int(rng.integers(9))}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, ""), (201, None), (202, " \n"), (203, "one two"), (204, "ONE  two"), (205, "two one"), (206, "one"), (207, "a b c d e"), (208, "a b c d e a b c d e a b c d e")]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.similar_classes(documents(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert near_copies.similar_classes(documents(spark, [])).count() == 0


def test_crowded_keys_find_the_same(spark, monkeypatch):
    """With every key's rows laid out in small blocks, and classes that aren't laid against themselves."""
    rng = np.random.default_rng(2)
    rows = around(rng, 60)
    base = [f"g{k}" for k in range(120)]
    for k in range(150):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[int(at)] = f"x{int(rng.integers(10**6))}"
        rows.append((1000 + k, " ".join(w)))
    want = brute_components(rows)
    for name, value in (("DENSE", 3), ("BLOCK", 7), ("LARGE", 5)):
        monkeypatch.setattr(near_copies, name, value)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.similar_classes(documents(spark, rows)).collect()}
    assert got == want


def test_recall_of_candidates_by_similarity():
    """Keys alone, at the sizes of larger tables too: pairs just at the limit are missed once in 1000 times by design."""
    rng = np.random.default_rng(5)
    c = 2 * 0.8 / 1.8
    x, z = rng.normal(size=(2, 3000, 64 * near_copies.WORDS))
    a, b = (np.rint(1e4 * m).astype(np.int64) for m in (x, c * x + np.sqrt(1 - c * c) * z))
    for rows in (1000, 250_000, 15_000_000):
        how = near_copies.keys_for(rows, 0.8)
        p, q = near_copies.keys_of(a, how)[0], near_copies.keys_of(b, how)[0]
        assert ((p == q) & (p >= 0)).any(axis=1).mean() > 0.5
        found = [len(np.intersect1d(s[s >= 0], t[t >= 0])) > 0 for s, t in zip(p, q, strict=True)]
        assert np.mean(found) > 0.99, rows


def test_counts_of_bits():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 4, 5, 100, 40_000):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        want = np.unpackbits(np.ascontiguousarray(near_copies.wide(h).T).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").sum(axis=0)
        assert (near_copies.counts(h) == want).all()


def test_a_repeated_line_links_no_documents(spark):
    rng = np.random.default_rng(3)
    line = " ".join(f"l{k}" for k in range(10))
    rows = [(k, " ".join(f"w{int(x)}" for x in rng.integers(0, 50000, 100 * (1 + k % 2))) + f"\n{line}" * 20) for k in range(20)]
    rows += [(100 + k, f"own{k} words{k} here{k} " + "same " * 400) for k in range(4)]
    want = brute_components(rows)
    assert all(want[i] == i for i in range(20))
    left = {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, documents(spark, rows), "").collect()}
    assert left == {i for i in want if want[i] == i}


def test_rows_are_judged_by_their_own_text(spark):
    """Rows that share a doc_id, or have none, and differ in their texts."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (1, b), (2, a), (5, c), (5, a), (None, c), (None, d), (None, d), (7, None)]
    left = corpus_pipeline.dedup_stage(spark, documents(spark, rows), "").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, a), (1, b), (5, c), (None, d), (7, None)], key=str)
    bench = spark.createDataFrame([(0, a)], "item_id long, text string")
    clean = decontamination.decontaminated(documents(spark, rows), bench).collect()
    assert sorted(map(tuple, clean), key=str) == sorted([r for r in rows if r[1] != a], key=str)


def test_keys_dont_grow_with_moderate_tables():
    """What is shuffled stays in proportion to the rows; larger tables need some keys more."""
    assert near_copies.keys_for(50_000, 0.8).number == near_copies.keys_for(4_000_000, 0.8).number
    assert near_copies.keys_for(15_000_000, 0.8).number < 2 * near_copies.keys_for(50_000, 0.8).number


def test_texts_of_many_pairs_are_handed_out_once_a_meeting(spark):
    """Not once a pair: 60 texts in 1770 pairs."""
    whole = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a long, b long")
    rows = near_copies.handed(whole, pairs, 8).collect()
    given = {(r["meet"], r["a"]) for r in rows if r["b"] is None}
    assert len(rows) == 1770 + len(given) and len(given) <= 60 * 8
    assert all((r["meet"], c) in given for r in rows if r["b"] is not None for c in (r["a"], r["b"]))


def test_pairs_come_from_the_least_key_they_share():
    """Every near pair of a key once over all keys, with plain bits too."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=64 * near_copies.WORDS)
    margins = np.rint(1e4 * (base + 0.3 * rng.normal(size=(90, len(base))))).astype(np.int64)
    how = near_copies.Keys(12, 2, 0)
    keys, _, near = near_copies.keys_of(margins, how)
    prints = np.packbits(margins > 0, axis=1, bitorder="little").view("<u8")
    ids = np.arange(90)
    found = []
    for key in np.unique(keys[keys >= 0]).tolist():
        rows = np.flatnonzero((keys == key).any(axis=1))
        g = near_copies.Group(key, np.zeros(len(rows), np.int64), ids[rows], ids[rows], np.full(len(rows), 1000), prints[rows], near[rows])
        found += [tuple(sorted(p)) for a, b in near_copies.crossing(g, 0.8, how) for p in zip(a.tolist(), b.tolist(), strict=True)]
    away = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    meet = [(a, b) for a in range(90) for b in range(a + 1, 90) if away[a, b] <= near_copies.most_apart(np.array(1000), 0.8) and set(keys[a][keys[a] >= 0]) & set(keys[b][keys[b] >= 0])]
    assert len(meet) > 1000 and sorted(found) == meet


def test_lists_hold_a_keys_pairs_in_few_rows():
    """80 rows of one class and 10 others near to all of it: as many lists as others and their own pairs need, not 800 rows."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=64 * near_copies.WORDS)
    margins = np.rint(1e4 * (base + 0.1 * rng.normal(size=(90, len(base))))).astype(np.int64)
    how = near_copies.Keys(1, 0, 0)
    _, _, near = near_copies.keys_of(margins, how)
    prints = np.packbits(margins > 0, axis=1, bitorder="little").view("<u8")
    ids = rng.permutation(90)
    roots = np.where(np.arange(90) < 80, 1000, ids)
    g = near_copies.Group(0, np.zeros(90, np.int64), ids, roots, np.full(90, 1000), prints, near)
    pairs = [(a, b) for x, y in near_copies.crossing(g, 0.8, how) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    rows = [r for batch in near_copies.lists(g, near_copies.crossing(g, 0.8, how)) for r in batch.to_pylist()]
    assert len(pairs) == 845 and len(rows) <= 10
    root = dict(zip(ids.tolist(), roots.tolist(), strict=True))
    assert sorted(tuple(sorted((r["a"], b))) for r in rows for b in r["bs"]) == sorted(tuple(sorted(p)) for p in pairs)
    assert all(r["root"] == root[r["a"]] and r["roots"] == [root[b] for b in r["bs"]] for r in rows)


def test_small_tables_of_seats_move_no_texts(spark):
    """The texts stay where they are until they are dealt out to meetings: seats are broadcast, whatever the texts' size."""
    whole = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a long, b long")
        plan = near_copies.handed(whole, pairs, 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pairs_of_connected_classes_arent_compared():
    texts = [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(59)), " ".join(f"v{k}" for k in range(60))]
    schema = pa.schema([("meet", pa.int64()), ("a", pa.int64()), ("root", pa.int64()), ("bs", pa.list_(pa.int64())), ("roots", pa.list_(pa.int64())), ("text", pa.string())])
    rows = [{"meet": 0, "a": k, "text": texts[k % 3]} for k in range(6)]
    rows += [{"meet": 0, "a": 0, "root": 7, "bs": [1, 3, 2], "roots": [8, 8, 2]}, {"meet": 0, "a": 4, "root": 8, "bs": [3, 5], "roots": [7, 2]}, {"meet": 0, "a": 2, "root": 2, "bs": [5, 0], "roots": [9, 7]}]
    out = [tuple(r.values()) for b in compared([pa.RecordBatch.from_pylist(rows, schema)], 5, 0.8) for r in b.to_pylist()]
    assert out == [(0, 1), (2, 5)]

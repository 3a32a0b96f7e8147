"""Near pairs of hashes."""

import numpy as np

from lumaframe.operators import matching


def test_near_hashes_by_blocks_and_ranges(spark, monkeypatch):
    """Against all pairs by brute force; few rows are shuffled, where ranges of 5 or 6 bits laid about a sixth of all pairs."""
    rng = np.random.default_rng(11)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    for k in range(1, 3000, 3):  # near ones, on both sides of the limit
        flips = np.bitwise_xor.reduce(np.left_shift(np.uint64(1), rng.choice(64, int(rng.integers(1, 14)), replace=False).astype(np.uint64)))
        h[k] = np.int64(np.uint64(h[k - 1].astype(np.uint64) ^ flips).astype(np.int64))
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(h)] + [(5000, None)], "k long, h long")
    far = np.bitwise_count(h.view(np.uint64)[:, None] ^ h.view(np.uint64)[None, :])
    for radius, met in ((10, 1 << 17), (10, 700), (0, 700), (30, 1 << 17)):
        monkeypatch.setattr(matching, "WORDS_MET", met)
        a, b = np.nonzero(np.triu(far <= radius, 1))
        want = sorted(zip(a.tolist(), b.tolist(), far[a, b].tolist(), strict=True))
        found = matching.hamming_pairs(df, "k", "h", radius)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        if radius < 30:
            assert sorted(map(tuple, found.collect())) == want
        else:
            assert found.count() == len(want)

"""Shingles whose cells of the sketch are full: results stay whole, and only large buckets are salted."""

import random
from collections import Counter

import numpy as np
from test_texts import brute_components

from lexisim.llm import ngram_jaccard


def test_full_sketch_salts_large_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT", 5)
    monkeypatch.setattr(ngram_jaccard, "CELLS", 4)  # every cell is hot
    seen = []
    salted = ngram_jaccard._salted
    monkeypatch.setattr(ngram_jaccard, "_salted", lambda dealt: seen.append(salted(dealt)) or seen[-1])
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(400)}" for _ in range(30)] for _ in range(12)]
    rows = []
    for k in range(120):
        own = list(bases[0] if k % 3 == 0 else rng.choice(bases))
        own[rng.randrange(len(own))] = f"e{rng.randrange(30)}"
        rows.append((k, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join(table, 3, 80).collect())
    assert got == brute_components(table.collect(), 3, 80)
    size, said = Counter(), {}
    dealt = spark.createDataFrame([(1, 9)] * 12 + [(2, 9)] * 5 + [(3, 1)] * 2, "token long, salts int")
    for r in salted(dealt).collect():
        size[r["token"]] += 1
        said[r["token"]] = r["salts"]
    assert seen and size == {1: 12, 2: 5, 3: 2} and said == {1: 3, 2: 1, 3: 1}


def test_histograms_bound_the_common_part():
    rng = np.random.default_rng(4)
    for size in (3, 700, 5000, 20_000):
        one = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for shared in (0, size // 2, size):
            two = np.concatenate([one[:shared], rng.integers(0, 1 << 63, size + size // 8 - shared, dtype=np.uint64)])
            x, y = (ngram_jaccard.histograms(z, np.array([0, 0, len(z)]))[1] for z in (one, two))
            most = int(ngram_jaccard.common_at_most([x], [y])[0])
            assert shared <= most <= size
            assert shared or size < 100 or most < 0.85 * size  # unlike sets are told apart at every size
    assert ngram_jaccard.common_at_most([], []).tolist() == []
    hot = np.zeros(70_000, np.uint64)
    assert ngram_jaccard.common_at_most(*[ngram_jaccard.histograms(hot, np.array([0, len(hot)]))] * 2)[0] == 1 << 62

"""Kernels over whole batches of strings: no object for a string, against plain definitions; and rounding by whole numbers."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexisim.functions import kernels
from lexisim.functions.scorers import JaroWinkler, LCSuf, Levenshtein, NGram
from lexisim.functions.text import six_places


def shared(x, y):
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return k


def grams(s, n, before, after):
    s = " " * before + s + " " * after
    return {s[k : k + n] for k in range(len(s) - n + 1)}


def some_pairs():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé東\U0001d400 ") for _ in range(rng.randrange(0, 9)))
    return [(word(), word()) for _ in range(500)] + [("ab" * 90, "ab" * 80 + "c"), ("a" * 40, ""), ("", "")]


def run(scorer_kernel, pairs):
    x, y = (pa.array([p[k] for p in pairs]) for k in (0, 1))
    return kernels.over_strings(x, y, scorer_kernel).to_pylist()


def test_prefix_suffix_and_grams():
    pairs = some_pairs()
    share = lambda s, x, y: 1.0 if not x and not y else s / max(len(x), len(y))
    assert run(kernels.prefix_share, pairs) == [share(shared(x, y), x, y) for x, y in pairs]
    assert run(kernels.suffix_share, pairs) == [share(shared(x[::-1], y[::-1]), x, y) for x, y in pairs]
    for n, before, after in ((1, 0, 0), (2, 1, 1), (2, 0, 1), (3, 2, 0), (3, 2, 2), (9, 0, 0), (25, 3, 1)):
        got = run(kernels.gram_share(n, before, after, lambda c, m, k: c * 1e6 + m * 1e3 + k), pairs)
        sets = [(grams(x, n, before, after), grams(y, n, before, after)) for x, y in pairs]
        assert got == [len(a & b) * 1e6 + len(a) * 1e3 + len(b) for a, b in sets], (n, before, after)


def test_narrow_and_wide_jaro_agree(monkeypatch):
    pairs = some_pairs()
    narrow = run(kernels.jaro, pairs)
    monkeypatch.setattr(kernels, "NARROW", 0)
    assert run(kernels.jaro, pairs) == narrow


def test_slices_nulls_and_no_rows():
    x, y = pa.array(["é", "abc", None, "x"])[1:], pa.array(["a", "abd", "a", None])[1:]
    assert kernels.over_strings(x, y, kernels.prefix_share).to_pylist() == [2 / 3, None, None]
    assert kernels.over_strings(pa.array([], pa.string()), pa.array([], pa.string()), kernels.jaro).to_pylist() == []


@pytest.mark.parametrize("scorer", [JaroWinkler(), LCSuf(True), NGram(3, 2, 0, metric="jaccard"), Levenshtein()], ids=lambda s: s.name)
def test_no_step_for_each_letter_in_the_plan(spark, scorer):
    """Pairs grow with the texts, so neither loops over letters in expressions nor an edit distance worked out again for each limit."""
    df = spark.createDataFrame([("a", "b")], "x string, y string").select(scorer.similarity(F.col("x"), F.col("y")).alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("levenshtein(") <= 1


def test_six_places(spark):
    rng = random.Random(3)
    values = [p / q for q in range(1, 60) for p in range(q + 1)] + [rng.random() for _ in range(3000)] + [k / 1024 for k in range(1025)]
    values += [float(Fraction(k * 1000 + 500 + d, 10**9)) for k in range(0, 999999, 1777) for d in (-1, 0, 1)] + [float(Fraction(2 * k + 1, 2 * 10**9)) for k in range(0, 10**9, 3333337)]
    values += [np.nextafter(0.5, 1).item(), -0.25, 1.5, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~six_places(F.col("v")).eqNullSafe(F.round(F.round("v", 9), 6))).count() == 0

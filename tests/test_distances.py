"""Recorded distances of three name pairs, and the edit distances against plain tables of edit costs."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import distances as d
from tallyfield.functions.distances import _osa, _osa_words, _table_distance, distance_columns

# The recorded results.
GOLDENS = [
    (
        "City University of New York (CUNY)",
        "City University of New York System (CUNY)",
        dict(osa=7, lv=7, dl=7, hamming=float("inf"), lcs=7, qgram=7, cosine=0.0239277650896533,
             jaccard=0.0952380952380952, jw=0.0569105691056911, soundex=0),
    ),
    (
        "University of Minnesota Morris Digital Well",
        "University of Minnesota-Morris",
        dict(osa=14, lv=14, dl=14, hamming=float("inf"), lcs=15, qgram=15, cosine=0.0928803653877152,
             jaccard=0.263157894736842, jw=0.119638242894057, soundex=0),
    ),
    (
        "The College at Brockport: State University of New York",
        "State University of New York College at Brockport",
        dict(osa=45, lv=45, dl=45, hamming=float("inf"), lcs=47, qgram=5, cosine=0.0104493311023486,
             jaccard=0.111111111111111, jw=0.180524061476443, soundex=1),
    ),
]


def test_recorded_distances(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(GOLDENS)], "i int, a string, b string")
    got = {r["i"]: r for r in df.select("i", *distance_columns(F.col("a"), F.col("b"))).collect()}
    for i, (_, _, want) in enumerate(GOLDENS):
        for metric, value in want.items():
            assert got[i][metric] == pytest.approx(value, abs=1e-12), (i, metric)


def _table(a, b, substitute, swap):
    d = {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if not i or not j:
            d[i, j] = i + j
            continue
        equal = a[i - 1] == b[j - 1]
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (0 if equal else 1 if substitute else 2))
        if swap and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distances_against_tables(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    pairs = list(zip(words[:200], words[200:], strict=True)) + [("ca", "abc"), ("", ""), ("", "ab"), ("ab", "ba")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", *[c for c in distance_columns(F.col("a"), F.col("b"))]).collect()
    for r in got:
        a, b = pairs[r["i"]]
        assert r["osa"] == _table(a, b, True, True)
        assert r["lv"] == _table(a, b, True, False)
        assert r["lcs"] == _table(a, b, False, False)
        assert r["dl"] <= r["osa"] <= r["lv"] <= r["lcs"]
    swapped = next(r for r in got if pairs[r["i"]] == ("ca", "abc"))
    assert (swapped["osa"], swapped["dl"]) == (3, 2)


def test_missing_sides(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), (None, None)], "a string, b string")
    for r in df.select(*distance_columns(F.col("a"), F.col("b"))).collect():
        assert all(v is None for v in r)


def test_batched_distances_equal_plain_loops(spark):
    """Unlike texts of many lengths, empty ones among them."""
    draw = random.Random(1)
    texts = ["".join(draw.choice("abcé ") for _ in range(draw.choice([0, 1, 2, 5, 9, 30]))) for _ in range(400)]
    pairs = list(zip(texts, texts[1:] + texts[:1], strict=True))

    def damerau(a, b):
        last, cost = {}, {}
        far = len(a) + len(b)
        for i in range(-1, len(a) + 1):
            for j in range(-1, len(b) + 1):
                cost[i, j] = far if min(i, j) < 0 else max(i, j) if min(i, j) == 0 else None
        for i in range(1, len(a) + 1):
            seen = 0
            for j in range(1, len(b) + 1):
                r, c = last.get(b[j - 1], 0), seen
                if a[i - 1] == b[j - 1]:
                    seen = j
                cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i, j - 1] + 1, cost[i - 1, j] + 1, cost[r - 1, c - 1] + i - r + j - c - 1)
            last[a[i - 1]] = i
        return cost[len(a), len(b)]

    def jaro(a, b):
        if not a and not b:
            return 0.0
        reach, free, kept = max(max(len(a), len(b)) // 2 - 1, 0), list(b), []
        for i, ch in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if free[j] == ch:
                    free[j] = None
                    kept.append(ch)
                    break
        m, other = len(kept), [ch for ch, f in zip(b, free, strict=True) if f is None]
        return 1.0 if not m else 1 - (m / len(a) + m / len(b) + (m - sum(p != q for p, q in zip(kept, other, strict=True)) // 2) / m) / 3

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("a", "b", d.damerau("a", "b").alias("dl"), d.jaro("a", "b").alias("jw")).collect()
    assert all(r["dl"] == damerau(r["a"], r["b"]) for r in got)
    assert all(abs(r["jw"] - jaro(r["a"], r["b"])) < 1e-12 for r in got)


def test_osa_by_words_equals_the_table():
    rng = np.random.default_rng(23)
    texts = lambda n, most: ["".join(rng.choice(list("abcé\U0001f600"), rng.integers(0, most))) for _ in range(n)]
    a = [*texts(300, 9), *texts(200, 65), "x" * 64, "x" * 65, "", ""]
    b = [*texts(300, 9), *texts(200, 90), "x" * 70, "y" * 65, "", "ab"]
    b[300:400] = [t[1::-1] + t[2:30] + t[31:] for t in a[300:400]]
    want = [int(_table_distance([x], [y], True, True)[0]) for x, y in zip(a, b, strict=True)]
    short = [i for i, t in enumerate(a) if len(t) <= 64]
    assert _osa_words([a[i] for i in short], [b[i] for i in short]).tolist() == [want[i] for i in short]
    assert _osa(pd.Series([*a, None]), pd.Series([*b, "a"])).tolist() == [*want, pd.NA]

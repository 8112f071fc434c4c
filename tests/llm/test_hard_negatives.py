"""Hard negatives: bounds against products, results against all pairs, odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfield.llm.hard_negatives import Found, Pairs, Side, cuts, hard_negatives, part_positives, summaries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, relabelled=7, positives=5, negatives=3, low=50, high=95):
    """All pairs in whole numbers; rows are (id, components, label) with unique ids."""
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if relabelled and i % relabelled == 0 else label
        kept.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, va, la in kept:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, v, label in kept if i != a and len(v) == len(va))
        for p, i, _ in [s for s in scored if s[2] == la][:positives]:
            window = [(n, s) for s, n, label in scored if label != la and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(a, i, k + 1, n, -p, -s) for k, (n, s) in enumerate(window)]
    return sorted(out)


def vectors(n, dim, spread, seed):
    """Clustered rows: ids, components and labels, some labels off their cluster."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    cluster = draw.integers(0, 6, n)
    x = centres[cluster] + spread * draw.normal(size=(n, dim))
    label = np.where(draw.random(n) < 0.2, draw.integers(0, 10, n), cluster)
    return [(i, [round(float(c), 3) for c in x[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.2), (64, 3.0), (5, 0.1), (1, 0.5), (33, 0.0)])
def test_results_equal_all_pairs(spark, dim, spread):
    rows = vectors(260, dim, spread, dim)
    df = spark.createDataFrame(rows, SCHEMA)
    for sizes in ({}, {"part_rows": 40, "group_anchors": 3}):
        got = sorted(tuple(r) for r in hard_negatives(df, anchor=F.col("id") % 50 == 0, relabelled=7, **sizes).collect())
        assert got == brute(rows)


def test_other_limits(spark):
    rows = vectors(120, 16, 0.5, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives(df, anchor=F.col("id") % 10 == 0, positives=2, negatives=7, low_percent=10, high_percent=99)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, None, 2, 7, 10, 99)


def side(v, ids=None, labels=None):
    ids = np.arange(len(v)) if ids is None else ids
    both = np.concatenate(summaries(v), axis=1).astype("<f4")
    table = pa.table({"row": ids, "id": ids, "label": np.zeros(len(v), np.int64) if labels is None else labels, "vector": [x.astype("<f8").tobytes() for x in v], "summary": [x.tobytes() for x in both]})
    return Side(table, v.shape[1])


@pytest.mark.parametrize("dim", [1, 2, 7, 16, 64, 100])
def test_bounds_hold_the_product_and_narrow(dim):
    draw = np.random.default_rng(dim)
    smooth = np.floor(256 * (draw.normal(size=(40, 1)) + 0.1 * draw.normal(size=(40, dim))))
    a, b = side(smooth[:20]), side(smooth[20:])
    exact, widths = a.vectors @ b.vectors.T, []

    def check(i, low, high):
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
        return np.zeros_like(low, bool)

    Pairs(a, 0, 20, b, np.ones((20, 20), bool)).refine(check)
    assert len(widths) == (len(cuts(dim)) - 1).bit_length() and all(x >= y - 1e-6 for x, y in zip(widths, widths[1:], strict=False))


def test_levels_leave_few_pairs_to_score():
    draw = np.random.default_rng(9)
    steps = np.repeat(draw.normal(size=(400, 8)), 8, axis=1)
    a = side(np.floor(256 * steps), labels=np.zeros(400, np.int64))
    found = Found(20, 5, np.full(20, -np.inf))
    scored = 0
    for _ in range(2):
        pairs = Pairs(a, 0, 20, a, np.ones((20, 400), bool))
        pairs.refine(lambda i, low, high: high < found.least[i])
        i, j, score = pairs.scores()
        scored = len(i)
        found.add(i, score, a.id[j], a.row[j])
    assert scored <= 20 * 12  # the second time nearly only the best are left


def test_whole_numbers_beyond_floats():
    v = np.array([[3e8, 1.0, 5.0], [2e8, 7.0, 1.0], [-4e8, 2.0, 2.0]])
    a = side(v)
    i, j, score = Pairs(a, 0, 3, a, np.ones((3, 3), bool)).scores()
    assert [int(s) for s in score] == [sum(int(x) * int(y) for x, y in zip(v[p], v[q], strict=True)) for p, q in zip(i, j, strict=True)]
    huge = side(np.array([[1e200], [-1e200]]))
    assert set(Pairs(huge, 0, 2, huge, np.ones((2, 2), bool)).scores()[2].tolist()) == {(1 << 63) - 1, -(1 << 63)}


def test_odd_rows_and_ties(spark):
    rows = [
        (0, [1.0, 0.0], 1),
        (None, [1.0, 0.0], 1),
        (1, None, 1),
        (2, [1.0, None], 1),
        (3, [1.0, float("nan")], 1),
        (4, [1.0, float("inf")], 1),
        (5, [1.0, 0.0], None),
        (8, [1.0, 0.0, 0.0], 1),
        (9, [], 3),
        (50, [], 3),
        (100, [], 4),
        *[(10 + k, [1.0, 0.0], 2) for k in (3, 1, 2)],
        *[(30 + k, [0.9, 0.0], 5) for k in range(9)],
        (61, [0.0, 1.0], 2),
        (64, [-1.0, 0.0], 2),
    ]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", id int, row string").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives(df, anchor=F.col("id") % 50 == 0, relabelled=7).collect())
    assert got == brute(rows)
    assert {(a, p, n) for a, p, _, n, _, _ in got} >= {(50, 9, 100)}
    assert hard_negatives(df.where("vec_id > 1000")).collect() == []
    assert hard_negatives(df, anchor=F.lit(False)).collect() == []


def test_rows_with_equal_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0], 1), (50, [1.0], 1), (3, [0.8], 2), (4, [0.7], 2)]
    got = sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA), anchor=F.col("id") % 50 == 0).collect())
    one = [(50, 50, 1, 3, 65536, 256 * 204), (50, 50, 2, 4, 65536, 256 * 179)]
    assert got == sorted(one * 2)


def test_one_label_with_all_rows_stays_bounded():
    v = np.ones((5000, 8))
    table = {"row": np.arange(5000), "id": np.arange(5000), "label": np.zeros(5000, np.int64), "length": np.full(5000, 8, np.int32)}
    both = np.concatenate(summaries(v), axis=1).astype("<f4")
    table = pa.table({**table, "vector": [x.astype("<i2").tobytes() for x in v], "summary": [x.tobytes() for x in both]})
    out = part_positives(table.slice(0, 10), table, 5)
    assert len(out["row"]) == 50 and out["id"].max() <= 5

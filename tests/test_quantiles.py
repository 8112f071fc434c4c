"""Exact quantiles, profiles and densities against numpy."""

import numpy as np
import pytest

from tallyfield.operators.quantiles import PROFILE_POINTS, exact_quantiles, profile_table, six_numbers
from tallyfield.operators.reshape import box_statistics, histogram, log_density


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    # One group holds most rows, another is constant, one is missing, one is a single value.
    hot = [("hot", float(v)) for v in np.round(rng.lognormal(3, 2, 3000), 1)]
    return hot + [("flat", 4.0)] * 50 + [(None, float(i)) for i in range(7)] + [("one", 2.5), ("gone", None), ("hot", None)]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_quantiles_by_group(spark, values, ranges):
    df = spark.createDataFrame(values, "g string, v double")
    points = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)
    got = {r["g"]: r for r in exact_quantiles(df, "v", points, [f"p{i}" for i in range(6)], ["g"], ranges).collect()}
    assert set(got) == {"hot", "flat", None, "one"}
    for g, r in got.items():
        want = np.quantile([v for k, v in values if k == g and v is not None], points)
        assert [r[f"p{i}"] for i in range(6)] == pytest.approx(list(want))


def test_profile(spark, values):
    df = spark.createDataFrame(values, "g string, v double")
    got = {r["column"]: r for r in profile_table(df, ranges=5).collect()}
    v = np.array([x for _, x in values if x is not None])
    n = len(v)
    r = got["v"]
    assert (r["n"], r["missing"], r["distinct"]) == (n, 2, len(set(v)))
    shares = np.unique(v, return_counts=True)[1] / n
    assert r["info"] == pytest.approx((1 - (shares**3).sum()) / (1 - 1 / n**2))
    assert r["mean"] == pytest.approx(v.mean())
    pairwise = np.abs(v[:, None] - v[None, :]).sum() / (n * (n - 1))
    assert r["gmd"] == pytest.approx(pairwise)
    for p in PROFILE_POINTS:
        assert r[f"p{round(p * 100):02d}"] == pytest.approx(np.quantile(v, p))
    edges = np.unique(v)
    assert [r[f"lowest_{i}"] for i in range(1, 6)] == list(edges[:5])
    assert [r[f"highest_{i}"] for i in range(1, 6)] == list(edges[::-1][:5])
    assert (got["g"]["n"], got["g"]["missing"], got["g"]["distinct"], got["g"]["mean"]) == (3053, 7, 4, None)


def test_six_numbers_of_a_flag(spark):
    df = spark.createDataFrame([(1,)] * 97 + [(0,)] * 3 + [(None,)], "decision int")
    r = six_numbers(df, ["decision"]).first()
    assert (r["min"], r["q1"], r["max"], r["missing"]) == (0.0, 1.0, 1.0, 1) and r["mean"] == pytest.approx(0.97)


def test_histogram_counts_every_value(spark, values):
    df = spark.createDataFrame(values, "g string, v double")
    got = histogram(df, ["v"], 30).collect()
    v = np.array([x for _, x in values if x is not None])
    want, edges = np.histogram(v, 30)
    counts = {r["bin"]: r["count"] for r in got}
    assert sum(counts.values()) == len(v)
    assert [counts.get(i + 1, 0) for i in range(30)] == list(want)
    assert min(r["lower"] for r in got) == pytest.approx(edges[0])


def test_box_statistics(spark, values):
    df = spark.createDataFrame(values, "g string, v double")
    r = {r["g"]: r for r in box_statistics(df, ["g"], "v").collect()}["hot"]
    v = np.array([x for g, x in values if g == "hot" and x is not None])
    q1, q3 = np.quantile(v, [0.25, 0.75])
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    assert (r["whisker_low"], r["whisker_high"], r["outliers"], r["n"]) == (inside.min(), inside.max(), len(v) - len(inside), len(v))


def test_density_equals_the_kernel_sum(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.lognormal(4, 1, 500), 2)
    got = log_density(spark.createDataFrame([("a", float(x)) for x in v], "g string, v double"), "g", "v", 128).collect()
    logs = np.log10(v)
    sd, iqr = logs.std(ddof=1), np.subtract(*np.quantile(logs, [0.75, 0.25])) / 1.34
    h = 0.9 * min(sd, iqr) * len(v) ** -0.2
    for r in got:
        want = np.exp(-0.5 * ((r["x"] - logs) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want, rel=1e-9, abs=1e-12)

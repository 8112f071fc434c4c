"""Composite jobs and models on small made tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators.fits import _curves, _two_sided_p, gompertz_fit_many, gompertz_fits
from tallyfield.operators.impact import impact_summary, regression_impact, sampled_impact
from tallyfield.plans import ranking, repository


def months(n, start=2000):
    return [(start + i // 12, i % 12 + 1) for i in range(n)]


def test_panel_equals_row_by_row_filling(spark):
    """The counted panel holds the same rows as laying out, joining and filling every single row."""
    rng = np.random.default_rng(1)
    subs = [(f"U {i % 5}", int(2011 + rng.integers(0, 4)), int(rng.integers(0, 2))) for i in range(60)]
    subs += [("West", 2012, 1)] * 40 + [("U-0", 2011, 1)]
    ranks = [(f"U {i}", y, float(y - 2000 + i), None if (y + i) % 3 == 0 else float(10 * i + y - 2010)) for i in range(4) for y in range(2011, 2015) if (i, y) != (1, 2011)]
    subscriptions = spark.createDataFrame(subs, "parent_account string, year int, decision int")
    rankings = spark.createDataFrame(ranks, "university_name string, year int, world_rank double, total_score double")
    got = {}
    for r in ranking.score_panel(subscriptions, rankings, 2011, 2014).collect():
        got[r["name"], r["year"], r["world_rank"], r["total_score"], r["decision"]] = r["n_rows"]
    want = {}
    key = lambda s: "".join(c for c in s if c.isalnum())
    parents = sorted({p for p, _, _ in subs})
    lines = {}
    for p in parents:
        for y in range(2011, 2015):
            for d in [d for q, z, d in subs if key(q) == key(p) and z == y] or [None]:
                for _, _, w, s in [r for r in ranks if key(r[0]) == key(p) and r[1] == y] or [(None, None, None, None)]:
                    lines.setdefault(key(p), []).append([y, w, s, d or 0])
    for name, rows in lines.items():
        rows.sort(key=lambda r: r[0])
        if all(r[1] is None for r in rows):
            continue
        for c in (1, 2):
            for order in (rows, rows[::-1]):
                last = None
                for r in order:
                    last = r[c] if r[c] is not None else last
                    r[c] = last
        for y, w, s, d in rows:
            want[name, y, w, s, d] = want.get((name, y, w, s, d), 0) + 1
    assert got == want


def test_score_change_needs_both_states(spark):
    panel = spark.createDataFrame(
        [("a", 2011, 0, 10.0, 1), ("a", 2012, 1, 13.0, 3), ("a", 2013, 1, 17.0, 1), ("b", 2011, 1, 5.0, 1), ("c", 2011, 0, None, 1), ("c", 2012, 1, 4.0, 1), ("a", 2019, 1, 99.0, 1)],
        "name string, year int, decision int, total_score double, n_rows long",
    )
    got = ranking.score_changes(panel, 2019).collect()
    assert [(r["name"], r["diff_after"], r["increase"]) for r in got] == [("a", 4.0, 1)]


def test_segment_ratios_from_recorded_aggregates(spark):
    downloads = spark.createDataFrame([("high", 178614.0), ("low", 5406.0), ("medium", 93924.0)], "repo_group string, downloads double")
    content = spark.createDataFrame([("high", 47999.0), ("low", 620.0), ("medium", 5447.0)], "repo_group string, content double")
    got = {r["repo_group"]: r for r in repository.segment_ratios(downloads, content).collect()}
    assert got["high"]["ratio"] == pytest.approx(3.721203, abs=1e-6)
    assert got["low"]["ratio"] == pytest.approx(8.719355, abs=1e-6)
    assert got["medium"]["content_to_low"] == pytest.approx(8.785484, abs=1e-6)
    assert got["medium"]["downloads_to_low"] == pytest.approx(17.37403, abs=1e-5)
    assert got["high"]["ratio_to_low"] == pytest.approx(0.426775, abs=1e-6)


def test_segment_calendar_equals_site_calendar(spark):
    sites = spark.createDataFrame([(1,), (2,), (3,), (4,)], "site_key long")
    uploads = spark.createDataFrame(
        [(1, dt.date(2001, 1, 2), 5), (3, dt.date(2001, 1, 4), 2), (3, dt.date(2000, 12, 1), 9), (4, dt.date(2001, 1, 1), 7), (9, dt.date(2001, 1, 1), 7)],
        "site_key long, date date, uploads long",
    )
    segments = spark.createDataFrame([(1, "low"), (3, "low"), (3, "high"), (4, "high")], "site_key long, repo_group string")
    args = ("2001-01-01", "2001-01-05")
    short = repository.daily_segment_content(sites, uploads, segments, *args)
    dense = repository.full_daily_panel(sites, uploads, *args).where("site_key <> 2").join(segments, "site_key")
    want = dense.groupBy("repo_group", "date").agg(F.avg("ttl_uploads").alias("average"), F.count("*").alias("counts"))
    pick = lambda df: sorted(tuple(r) for r in df.select("repo_group", "date", "average", "counts").collect())
    assert pick(short) == pick(want) and len(pick(short)) == 10


def test_site_labels_and_ratio(spark):
    panel = spark.createDataFrame([(s, 2001, m, d, 0, c) for s, m, d, c in [(1, 1, 10, 5), (1, 2, None, 5), (2, 2, 4, 0), (3, 2, 6, None), (4, 2, 1, 1)]], "site_key long, years int, months int, downloads long, ttl_uploads long, cum_uploads long")
    segments = spark.createDataFrame([(1, "low"), (2, "low"), (2, "medium"), (3, "medium")], "site_key long, repo_group string")
    labels = {r[0]: r[1] for r in repository.site_labels(panel, segments).collect()}
    assert labels == {1: "low", 2: "high", 3: "medium", 4: "low"}
    directory = spark.createDataFrame([(1, "one")], "site_key long, institution_name string")
    got = [(r["site_key"], r["ttl_downloads"], r["ratio"]) for r in repository.usage_ratio(panel, directory, 2001, 2).collect()]
    assert got == [(1, 10, 2.0), (4, 1, 1.0), (2, 4, None), (3, 6, None)]
    assert {r[0] for r in repository.sites_without_uploads(panel).collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        repository.site_segments(panel, "other")


def test_gompertz_recovers_known_curves(spark):
    x = np.linspace(0, 4000, 80)
    data = []
    for site, (height, b2, b3) in {1: (500.0, 3.0, 0.999), 2: (80.0, 6.0, 0.998)}.items():
        noise = np.random.default_rng(site).normal(0, height * 0.01, len(x))
        data += [(site, float(v), float(height * math.exp(-b2 * b3**v) + e)) for v, e in zip(x, noise, strict=True)]
    data += [(3, float(v), 7.0) for v in x] + [(4, float(v), float(v)) for v in x[:3]] + [(5, float(v), 1.0) for v in x]
    panel = spark.createDataFrame(data, "site_key long, cum_uploads double, downloads double")
    got = gompertz_fits(panel, excluded=[5]).collect()
    fit = {(r["site_key"], r["term"]): r for r in got}
    for site, want in {1: (500.0, 3.0, 0.999), 2: (80.0, 6.0, 0.998)}.items():
        for term, value in zip(("Asym", "b2", "b3"), want, strict=True):
            r = fit[site, term]
            assert r["estimate"] == pytest.approx(value, rel=0.05) and abs(r["estimate"] - value) < 5 * r["std_error"]
            assert r["p_value"] < 1e-6 and r["statistic"] == pytest.approx(r["estimate"] / r["std_error"])
    failed = {r["site_key"]: r["message"] for r in got if r["status"] == "failed"}
    assert failed == {3: "constant response", 4: "too few distinct points"}


def test_fits_that_advance_together_equal_fits_alone():
    rng = np.random.default_rng(3)
    series = []
    for k in range(40):
        x = np.sort(rng.uniform(0, 3000, rng.integers(3, 60)))
        curve = 50 * np.exp(-rng.uniform(1, 8) * np.exp(-rng.uniform(1, 6) * x / 3000))
        series.append((x, curve + rng.normal(0, [0.5, 20, 0][k % 3], len(x))))
    series += [(np.arange(9.0), np.ones(9)), (np.arange(30.0), np.arange(30.0) ** 2), (np.arange(30.0), -np.arange(30.0))]
    together = gompertz_fit_many(series, 500)
    for pair, found in zip(series, together, strict=True):
        (alone,) = gompertz_fit_many([pair], 500)
        if isinstance(found, str):
            assert found == alone
        else:
            for a, b in zip(found, alone, strict=True):
                assert np.allclose(a, b, rtol=1e-6)
    kinds = {f for f in together if isinstance(f, str)}
    assert {"too few distinct points", "constant response"} <= kinds and sum(not isinstance(f, str) for f in together) >= 25
    assert gompertz_fit_many([]) == []


def test_products_of_many_sites_equal_those_of_one():
    """The sums do not depend on how many sites advance together, as the last bit decides whether a step lowers the loss."""
    rng = np.random.default_rng(5)
    u, v, theta = rng.uniform(0, 3, (9, 61)), rng.normal(5, 1, (9, 61)), rng.uniform(0.5, 4, (9, 3))
    there = np.arange(61) < np.array([61, 40, 61, 8, 61, 61, 33, 61, 61])[:, None]
    u, v = u * there, v * there
    together = _curves(theta, u, v, there)
    for k in range(9):
        alone = _curves(theta[k : k + 1], u[k : k + 1], v[k : k + 1], there[k : k + 1])
        assert all(np.array_equal(a[k], b[0]) for a, b in zip(together, alone, strict=True))
        decay = np.exp(-theta[k, 2] * u[k])
        curve = np.exp(-theta[k, 1] * decay)
        fitted, m = theta[k, 0] * curve, there[k]
        slope = np.column_stack([curve, -fitted * decay, fitted * theta[k, 1] * u[k] * decay])[m]
        assert np.allclose(together[2][k], slope.T @ slope) and np.allclose(together[1][k], slope.T @ (v[k] - fitted)[m])
        assert together[0][k] == pytest.approx(((v[k] - fitted)[m] ** 2).sum())


def test_the_panel_is_computed_once_and_sites_meet_in_large_groups(spark):
    """Counting the sites does not compute the panel a second time, and the few long fits share their steps with many sites."""
    x = np.arange(1.0, 13.0)
    data = [(s, float(v), float(80 * math.exp(-3 * math.exp(-v / (3 + s % 4))) + (s * 7 + v * 5) % 3)) for s in range(200) for v in x]
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    panel = spark.createDataFrame(data, "site_key long, cum_uploads double, downloads double")
    got = gompertz_fits(panel.mapInArrow(told, panel.schema), rounds=200)
    wide = got.withColumn("task", F.spark_partition_id()).collect()
    assert seen.value == len(data) and len({r["task"] for r in wide}) == 1
    assert {r["site_key"] for r in wide} == set(range(200)) and {r["n"] for r in wide} == {12}


def test_running_parameters_are_told_and_keys_stay_whole(spark):
    x = np.arange(1.0, 40.0)
    big = (1 << 53) + 1
    data = [(big, float(v), float(np.exp(v / 3))) for v in x] + [(None, float(v), float(9 - v)) for v in x] + [(7, float(v), None) for v in x]
    got = gompertz_fits(spark.createDataFrame(data, "site_key long, cum_uploads double, downloads double"), rounds=300).collect()
    assert {r["site_key"] for r in got} == {big, None, 7}
    messages = {r["site_key"]: r["message"] for r in got if r["status"] == "failed"}
    assert messages[7] == "too few distinct points"
    # an exponential has no ceiling: the height runs off, and the site says so
    assert messages[big] in ("singular gradient", "no step lowers the loss", "not settled after 300 steps")


def test_tail_of_student_t():
    # Tables of Student's t, two-sided 5 % points.
    for df, t in {1: 12.7062047, 2: 4.30265273, 5: 2.57058184, 30: 2.04227246, 200: 1.97189622}.items():
        assert _two_sided_p(t, df) == pytest.approx(0.05, rel=1e-6) == _two_sided_p(-t, df)
    assert _two_sided_p(0.0, 9) == pytest.approx(1.0) and _two_sided_p(math.inf, 9) == 0.0 and 0 < _two_sided_p(60.0, 77) < 1e-60


def _step_series(step, seed=0):
    rng = np.random.default_rng(seed)
    dates = [dt.date(y, m, 1) for y, m in months(80)]
    control = rng.normal(100, 10, 80)
    test = 20 + 1.5 * control + rng.normal(0, 2, 80) + np.where(np.arange(80) >= 50, step, 0)
    return [(d, float(t), float(c)) for d, t, c in zip(dates, test, control, strict=True)]


def test_impact_finds_a_step(spark):
    data = [(pair, *row) for pair, step in (("step", 15.0), ("none", 0.0)) for row in _step_series(step)]
    data += [("flat", d, 1.0, c) for d, _, c in _step_series(0.0)]
    series = spark.createDataFrame(data, "pair string, date date, test double, control double")
    pre, post = "2004-02-01", "2004-03-01"
    points = regression_impact(series, pre, post)
    summary = {r["pair"]: r for r in impact_summary(points).collect()}
    assert summary["step"]["average_effect"] == pytest.approx(15, abs=1.0) and summary["step"]["cumulative_low"] > 0
    assert summary["none"]["average_effect"] == pytest.approx(0, abs=1.0)
    running = 0.0
    for r in sorted(points.where("pair = 'step'").collect(), key=lambda r: r["date"]):
        running += r["effect"]
        assert r["cumulative_effect"] == pytest.approx(running)
    first, again = ({r["pair"]: r for r in sampled_impact(series, pre, post).collect()} for _ in range(2))
    assert first == again
    assert first["step"]["average_low"] < 15 < first["step"]["average_high"] and first["step"]["tail_probability"] < 0.01
    assert first["none"]["average_low"] < 0 < first["none"]["average_high"] and first["none"]["tail_probability"] > 0.05
    assert first["flat"]["status"] != "ok" and first["flat"]["cumulative_effect"] is None


def test_impact_with_a_period_per_pair(spark):
    rows = [(pair, *row, dt.date(1990, 1, 1), *edges) for pair, edges in (("early", (dt.date(2002, 12, 1), dt.date(2003, 1, 1), dt.date(2003, 6, 1))), ("late", (dt.date(2004, 2, 1), dt.date(2004, 3, 1), dt.date(2010, 1, 1)))) for row in _step_series(15.0)]
    series = spark.createDataFrame(rows, "pair string, date date, test double, control double, pre_start date, pre_end date, post_start date, post_end date")
    got = {r["pair"]: r for r in impact_summary(regression_impact(series)).collect()}
    assert (got["early"]["n_pre"], got["early"]["n_post"]) == (36, 6) and (got["late"]["n_pre"], got["late"]["n_post"]) == (50, 30)
    points = _step_series(15.0)
    for pair, n, m in (("early", 36, 6), ("late", 50, 30)):
        slope, intercept = np.polyfit([c for _, _, c in points[:n]], [t for _, t, _ in points[:n]], 1)
        want = np.mean([t - intercept - slope * c for _, t, c in points[n : n + m]])
        assert got[pair]["average_effect"] == pytest.approx(want)
    sampled = {r["pair"]: r for r in sampled_impact(series, draws=200).collect()}
    assert (sampled["early"]["n_pre"], sampled["late"]["n_post"]) == (36, 30)
    one = regression_impact(series.where("pair = 'late'").drop("pre_start", "pre_end", "post_start", "post_end"), "2004-02-01", "2004-03-01").orderBy("date").first()
    pre = [(t, c) for d, t, c in _step_series(15.0) if d <= dt.date(2004, 2, 1)]
    y, x = (np.array(v) for v in zip(*pre, strict=True))
    slope, intercept = np.polyfit(x, y, 1)
    s = np.sqrt(((y - intercept - slope * x) ** 2).sum() / (len(x) - 2))
    wide = 1.959963984540054 * s * np.sqrt(1 + 1 / len(x) + (one["control"] - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert one["effect_high"] - one["effect"] == pytest.approx(wide)
    assert one["cumulative_high"] - one["cumulative_effect"] == pytest.approx(wide)

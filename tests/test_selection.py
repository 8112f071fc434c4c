"""Order statistics found by counting, against numpy."""

import numpy as np
import pytest

from tallyfield.operators import selection
from tallyfield.operators.selection import edge_values, selected_boxes, selected_quantiles

POINTS = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)
NAMES = [f"p{i}" for i in range(6)]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(17)
    # A group with most rows, a third of them one value; values over 600 decades; a constant group; ties of few values.
    hot = [("hot", float(v), int(v) % 3) for v in np.round(rng.lognormal(3, 2, 2000), 1)] + [("hot", 20.0, 1)] * 1000
    wide = [("wide", float(s * 10.0**e), None) for s, e in zip(rng.choice([-1, 1], 700), rng.uniform(-300, 300, 700), strict=True)]
    tied = [("tied", 1.0, 0)] * 500 + [("tied", 2.0, 0)] + [("tied", 3.0, 0)] * 500
    odd = [("flat", 4.0, 1)] * 50 + [(None, float(i), 2) for i in range(7)] + [("one", 2.5, 3), ("gone", None, 4), ("hot", float("nan"), 5)]
    return hot + wide + tied + odd


@pytest.fixture(scope="module")
def table(spark, values, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("selection") / "t")
    spark.createDataFrame(values, "g string, v double, column int").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def present(values, g):
    return np.array([v for k, v, _ in values if k == g and v is not None and v == v])


@pytest.mark.parametrize("grid,take", [(1000, 20_000), (50, 10), (4, 1)])
def test_quantiles_by_group(table, values, grid, take):
    got = {r["g"]: r for r in selected_quantiles(table, ["v"], POINTS, NAMES, ["g"], grid, take).collect()}
    assert set(got) == {"hot", "wide", "tied", "flat", "one", "gone", None}
    assert (got["gone"]["n"], got["gone"]["missing"], got["gone"]["p3"]) == (0, 1, None)
    assert (got["hot"]["n"], got["hot"]["missing"]) == (3000, 1)
    for g in set(got) - {"gone"}:
        want = np.quantile(present(values, g), POINTS)
        assert [got[g][n] for n in NAMES] == pytest.approx(list(want)), g


def test_several_columns_in_one_pass(table, values):
    got = {r["column"]: r for r in selected_quantiles(table, ["v", "column"], POINTS, NAMES, grid=20, take=5).collect()}
    for at, name in ((1, "v"), (2, "column")):
        some = np.array([r[at] for r in values if r[at] is not None and r[at] == r[at]], float)
        assert got[name]["n"] == len(some) and got[name]["mean"] == pytest.approx(some.mean())
        assert [got[name][n] for n in NAMES] == pytest.approx(list(np.quantile(some, POINTS)))


def test_a_wrong_sketch_costs_rounds_and_no_values(table, values, monkeypatch):
    """Cuts that always lie at the lower or upper end still lead to the exact values."""
    from pyspark.sql import functions as F

    for end in (F.min, F.max):
        monkeypatch.setattr(selection, "_sketch", lambda grid, end=end: F.array_repeat(end("v"), grid + 1))
        few = table.where("g is null or g in ('tied', 'one')")
        got = {r["g"]: r for r in selected_quantiles(few, ["v"], POINTS, NAMES, ["g"], 4, 1).collect()}
        for g in got:
            assert [got[g][n] for n in NAMES] == pytest.approx(list(np.quantile(present(values, g), POINTS)))


def test_only_counts_are_exchanged(table):
    """No exchange holds rows of the input: every one follows a partial aggregate."""
    values = selection._melted(table, ["v"], ["g"])
    ranks = values.groupBy("k").agg(*[f("v").alias(n) for f, n in ((selection.F.min, "lo"), (selection.F.max, "hi"), (selection.F.count, "m"))])
    ranks = ranks.selectExpr("k", "0L AS rank", "lo", "hi", "0L AS below", "m", "array_repeat(lo, 5) AS s")
    stored = selection.materialised(ranks, "ranks")
    plan = selection._narrowed(values, stored, 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") < plan.rindex("partial_")


def test_boxes(table, values):
    got = {r["g"]: r for r in selected_boxes(table, ["g"], "v", grid=30, take=20).collect()}
    assert "gone" not in got
    for g in ("hot", "tied", None):
        v = present(values, g)
        q1, q3 = np.quantile(v, [0.25, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        want = (inside.min(), inside.max(), len(v) - len(inside), len(v))
        assert (got[g]["whisker_low"], got[g]["whisker_high"], got[g]["outliers"], got[g]["n"]) == want


def test_edges(table, values):
    rows = edge_values(table, ["v", "column"]).collect()
    for at, name in ((1, "v"), (2, "column")):
        some = np.unique([r[at] for r in values if r[at] is not None and r[at] == r[at]])
        for side, want in (("lowest", some[:5]), ("highest", some[::-1][:5])):
            got = sorted((r["place"], r["value"]) for r in rows if r["column"] == name and r["side"] == side)
            assert [v for _, v in got] == list(want) and [p for p, _ in got] == list(range(1, len(want) + 1))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert selected_quantiles(empty, ["v"], POINTS, NAMES, ["g"]).count() == 0
    assert selected_boxes(empty, ["g"], "v").count() == 0 and edge_values(empty, ["v"]).count() == 0


def test_rounds_join_written_ranks(spark, monkeypatch):
    """The values meet few stored rows in every round, so that they are never shuffled to their groups."""
    sizes, narrowed = [], selection._narrowed

    def seen(values, ranks, grid):
        sizes.append(int(str(ranks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return narrowed(values, ranks, grid)

    monkeypatch.setattr(selection, "_narrowed", seen)
    df = spark.range(40_000).selectExpr("id % 2 AS g", "CAST(id * id AS double) AS v")
    got = {r["g"]: r["p"] for r in selected_quantiles(df, ["v"], [0.5], ["p"], ["g"], take=5).collect()}
    assert got == {g: ((19_998 + g) ** 2 + (20_000 + g) ** 2) / 2 for g in (0, 1)}
    assert len(sizes) > 1 and max(sizes) < 1_000_000

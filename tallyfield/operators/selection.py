"""Exact order statistics by counting below candidate cuts: values stay where they are read, only counts move.

A wanted rank lies in an interval of values whose number of rows below is known. A sketch of the interval proposes two
cuts around the rank, exact counts below and at the cuts decide which side of them, or which cut itself, holds the rank,
and the interval shrinks by about a third of `grid` a round. The sketch only proposes: a poor one costs a round, never a
wrong value. A cut that is one value with a third of all rows is found by its own count. Once an interval holds at most
`take` rows these are gathered, which is the only move of values. All columns, groups and ranks share each round.

What moves per round is one sketch per group, column and interval and a few counts per rank, combined in each task
first. That suits tables with far more rows than groups; for very many small groups `quantiles.exact_quantiles` moves
less. The input is read twice a round, so hand in a stored table or a plain scan of one.

Defined cases: missing values and NaN count as missing; a group without values has a row with `n` 0 and missing statistics;
missing group keys are a group; an empty table gives no rows; columns of the input named like results never take part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import materialised

GRID = 1_000
TAKE = 20_000


def _melted(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(k, v): the group with the column's name, and the value, missing where it is NaN."""

    def value(c: str) -> Column:
        v = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(v), v)

    entries = F.array(*[F.struct(F.lit(c).alias("c"), value(c).alias("v")) for c in columns])
    keys = [F.col(f"`{b}`").alias(f"b{i}") for i, b in enumerate(by)]
    return df.select(*keys, F.explode(entries).alias("e")).select(
        F.struct(F.col("e.c").alias("c"), *[f"b{i}" for i in range(len(by))]).alias("k"), F.col("e.v").alias("v")
    )


def _sketch(grid: int) -> Column:
    return F.percentile_approx("v", [i / grid for i in range(grid + 1)], 4 * grid)


def _narrowed(values: DataFrame, ranks: DataFrame, grid: int) -> DataFrame:
    """Smaller intervals for all ranks; `ranks` carries the sketch of its interval as `s`."""
    at = F.floor((F.col("rank") - F.col("below") + 0.5) / F.col("m") * grid).cast("int")
    probed = ranks.select(
        "k", "rank", "lo", "hi", "below", "m",
        F.get("s", F.greatest(at - 1, F.lit(0))).alias("a"),
        F.get("s", F.least(at + 2, F.lit(grid))).alias("b"),
    )
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    between = (v > a) & (v < b)
    counted = (
        values.join(probed, "k")
        .where(v.between(F.col("lo"), F.col("hi")))
        .groupBy("k", "rank", "lo", "hi", "below", "m", "a", "b")
        .agg(
            F.count_if(v < a).alias("under_a"),
            F.count_if(v <= a).alias("to_a"),
            F.count_if(v < b).alias("under_b"),
            F.count_if(v <= b).alias("to_b"),
            F.max(F.when(v < a, v)).alias("left_end"),
            F.min(F.when(between, v)).alias("inner_lo"),
            F.max(F.when(between, v)).alias("inner_hi"),
            F.min(F.when(v > b, v)).alias("right_end"),
        )
    )
    place = F.col("rank") - F.col("below")

    def cell(lo: str, hi: str, before: Column, rows: Column) -> Column:
        return F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), (F.col("below") + before).alias("below"), rows.alias("m"))

    n = F.col
    found = (
        F.when(place < n("under_a"), cell("lo", "left_end", F.lit(0).cast("long"), n("under_a")))
        .when(place < n("to_a"), cell("a", "a", n("under_a"), n("to_a") - n("under_a")))
        .when(place < n("under_b"), cell("inner_lo", "inner_hi", n("to_a"), n("under_b") - n("to_a")))
        .when(place < n("to_b"), cell("b", "b", n("under_b"), n("to_b") - n("under_b")))
        .otherwise(cell("right_end", "hi", n("to_b"), n("m") - n("to_b")))
    )
    return counted.select("k", "rank", found.alias("f")).select("k", "rank", "f.*")


def _gathered(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(k, rank, value) for ranks whose intervals hold few rows."""
    cells = materialised(ranks.select("k", "lo", "hi").distinct(), "selection-cells")
    lists = (
        values.join(cells, "k")
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy("k", "lo", "hi")
        .agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    )
    at = (F.col("rank") - F.col("below")).cast("int")
    return ranks.join(lists, ["k", "lo", "hi"]).select("k", "rank", F.get("sorted", at).alias("value"))


def _position(point: float) -> Column:
    return (F.col("n") - 1) * F.lit(float(point))


def selected_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    points: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    grid: int = GRID,
    take: int = TAKE,
) -> DataFrame:
    """One row per group and column: `column`, `n`, `missing`, `min`, `max`, `mean` and one exact quantile per point.

    Quantiles are interpolated linearly. `grid` is the fineness of the proposed cuts, `take` the number of rows of an
    interval that may be gathered.
    """
    values = _melted(df, columns, by)
    stats = materialised(
        values.groupBy("k").agg(
            F.count("v").alias("n"),
            F.count_if(F.col("v").isNull()).alias("missing"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.avg("v").alias("mean"),
            _sketch(grid).alias("s"),
        ),
        "selection-stats",
    )
    wanted = F.array_distinct(F.array(*[f(_position(p)).cast("long") for p in points for f in (F.floor, F.ceil)]))
    ranks = stats.where("n > 0").select(
        "k", F.explode(wanted).alias("rank"), F.col("min").alias("lo"), F.col("max").alias("hi"),
        F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), "s",
    )
    done = []
    sketched = True
    small = (F.col("lo") == F.col("hi")) | (F.col("m") <= take)
    while True:
        done.append(ranks.where(small).select("k", "rank", "lo", "hi", "below", "m"))
        open_ = ranks.where(~small)
        if open_.isEmpty():
            break
        if not sketched:
            cells = materialised(open_.select("k", "lo", "hi").distinct(), "selection-cells")
            inside = values.join(cells, "k").where(F.col("v").between(F.col("lo"), F.col("hi")))
            sketches = materialised(inside.groupBy("k", "lo", "hi").agg(_sketch(grid).alias("s")), "selection-sketch")
            # Written, as a join's estimated size is the product of its sides': the values would be shuffled to these few rows.
            open_ = materialised(open_.join(sketches, ["k", "lo", "hi"]), "selection-open")
        ranks = materialised(_narrowed(values, open_, grid), "selection-ranks")
        sketched = False
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionAll(part)
    single = settled.where("lo = hi").select("k", "rank", F.col("lo").alias("value"))
    found = single.unionAll(_gathered(values, settled.where("lo < hi")))
    # At most two ranks per point, so the map is as small as the list of points.
    maps = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def quantile(p: float) -> Column:
        h = _position(p)
        low, high = (F.element_at("at", f(h).cast("long")) for f in (F.floor, F.ceil))
        return low + (h - F.floor(h)) * (high - low)

    out = stats.join(maps, "k", "left")
    groups = [F.col(f"k.b{i}").alias(b) for i, b in enumerate(by)]
    results = [quantile(p).alias(name) for p, name in zip(points, names, strict=True)]
    return out.select(*groups, F.col("k.c").alias("column"), "n", "missing", "min", "max", "mean", *results)


def selected_boxes(
    df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5, grid: int = GRID, take: int = TAKE
) -> DataFrame:
    """Quartiles, whiskers, number of outliers and rows per group: one more pass counts against the fences."""
    quartiles = materialised(
        selected_quantiles(df, [value], (0.25, 0.5, 0.75), ("q1", "median", "q3"), by, grid, take).where("n > 0"), "quartiles"
    )
    gap = reach * (F.col("q3") - F.col("q1"))
    key = F.struct(F.col("column").alias("c"), *[F.col(f"`{b}`").alias(f"b{i}") for i, b in enumerate(by)])
    fences = quartiles.select(key.alias("k"), "q1", "median", "q3", "n", (F.col("q1") - gap).alias("low"), (F.col("q3") + gap).alias("high"))
    v = F.col("v")
    inside = v.between(F.col("low"), F.col("high"))
    boxes = (
        _melted(df, [value], by)
        .join(fences, "k")
        .groupBy("k", "q1", "median", "q3", "n")
        .agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    )
    groups = [F.col(f"k.b{i}").alias(b) for i, b in enumerate(by)]
    return boxes.select(*groups, "q1", "median", "q3", "whisker_low", "whisker_high", "outliers", "n")


def edge_values(df: DataFrame, columns: Sequence[str], edge: int = 5) -> DataFrame:
    """The `edge` smallest and largest distinct values: (column, side, place, value), side `lowest` or `highest`.

    Each task keeps that many per column while it reads, so what moves does not grow with the rows of a task.
    """
    names = list(columns)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0) for _ in names]
        for batch in batches:
            for i in range(len(names)):
                some = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                all_ = np.unique(np.concatenate([kept[i], some]))
                kept[i] = all_ if len(all_) <= 2 * edge else np.concatenate([all_[:edge], all_[-edge:]])
        columns_ = [pa.array(np.repeat(np.arange(len(names)), list(map(len, kept))), pa.int32()), pa.array(np.concatenate(kept), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns_, names=["i", "value"])

    plain = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(names)]
    rows = materialised(df.select(*plain).mapInArrow(reduce, "i int, value double").distinct(), "edges")
    named = F.array(*[F.lit(c) for c in names])

    def side(label: str, order: Column) -> DataFrame:
        # A limit on row_number is applied inside every task before the shuffle.
        ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("i").orderBy(order))).where(F.col("place") <= edge)
        return ranked.select(F.get(named, F.col("i")).alias("column"), F.lit(label).alias("side"), "place", "value")

    return side("lowest", F.asc("value")).unionAll(side("highest", F.desc("value")))

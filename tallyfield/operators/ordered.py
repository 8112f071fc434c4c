"""Ordered windows.

Two kinds of group occur. A *panel* holds one row per entity and calendar period, so its groups are bounded by the
calendar and a native window is right. A *ledger* holds any number of rows per entity; there the rows are cut into ranges
of equal size, whatever entities they cut through, and sums are carried over the borders, so no task holds a whole entity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyfield.operators.joins import null_safe_join
from tallyfield.session import materialised

SLICE_ROWS = 1_000_000


def _ascending(columns: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def running_total(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Running sum over a panel; from the first missing value on it stays missing."""
    w = Window.partitionBy(*keys).orderBy(*_ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count_if(value.isNull()).over(w) == 0, F.sum(value).over(w))


def fill_down_up(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Carry the last known value forward, then the first known one backward, over a panel."""
    w = Window.partitionBy(*keys).orderBy(*_ascending(order))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead))


def repair_cumulative(df: DataFrame, total: str, increment: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Close the gaps of a running total over a panel.

    Missing total: next total less next increment; else the next known total; else the previous total plus the own
    increment; else the last known one. All steps share one partitioning and one sort.
    """
    w = Window.partitionBy(*keys).orderBy(*_ascending(order))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    t, inc = F.col(total), F.col(increment)
    return (
        df.withColumn(total, F.coalesce(t, F.lead(total).over(w) - F.lead(increment).over(w)))
        .withColumn(total, F.first(total, ignorenulls=True).over(ahead))
        .withColumn(total, F.coalesce(t, F.lag(total).over(w) + inc))
        .withColumn(total, F.last(total, ignorenulls=True).over(back))
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*_ascending(order))))


def change_from_previous(df: DataFrame, value: str, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Value less the value of the preceding row of an aggregated table."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(order))
    return df.withColumn(out, F.col(value) - F.lag(value).over(w))


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows in partitions of near equal size, cut in (keys, order) order wherever a sample of the rows says, and sorted.

    A cut may fall inside an entity or a day, so neither a hot entity nor an outlier among the ids fills a partition.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // slice_rows))
    by = [*[F.asc(k) for k in keys], *_ascending(order)]
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def _key_changes(held: list[pa.Array], columns: list[pa.Array]) -> np.ndarray:
    """Whether the keys of each row differ from those of the row before; `held` is the row before the first, if any."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = not held
    for k, column in enumerate(columns):
        both = pa.concat_arrays([held[k] if held else column[:1], column])
        new |= np.diff(both.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
    return new


def _sums_per_stretch(values: np.ndarray, new: np.ndarray, carried: Any) -> np.ndarray:
    """Running sums that start anew where `new` is set; a first stretch that does not goes on from `carried`."""
    values = values.copy()
    if not new[0]:
        values[0] += carried
    for start, end in pairwise([*np.unique([0, *np.flatnonzero(new)]), len(values)]):
        values[start:end] = np.cumsum(values[start:end])
    return values


def _local_sums(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Rows of `ranged` with `__part`, the partition, and the running `__sum` and count of `__gaps` of their entity in it.

    A task holds one batch and the last row's keys and sums, however long an entity is.
    """
    summed = rows.select(F.sum(value)).schema[0].dataType
    with_value = rows.withColumns({"__sum": F.coalesce(F.col(value), F.lit(0)).cast(summed), "__gaps": F.col(value).isNull().cast("long")})
    at = [rows.columns.index(k) for k in keys]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId(), [], [0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns, own = list(batch.columns), [batch.column(k) for k in at]
            new = _key_changes(held, own)
            for place, k in enumerate((-2, -1)):
                running = _sums_per_stretch(columns[k].to_numpy(zero_copy_only=False), new, last[place])
                last[place] = running[-1]
                columns[k] = pa.array(running, columns[k].type)
            held = [c[-1:] for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32))], names=[*batch.schema.names, "__part"])

    return with_value.mapInArrow(sums, StructType([*with_value.schema.fields, StructField("__part", IntegerType())]))


def ledger_running_total(
    df: DataFrame, value: str, keys: Sequence[str], day: str, row_id: str, out: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Running sum over ledger rows in (day, row id) order, missing from the first missing value on.

    `row_id` has to be unique. Full rows move once, into ranges of (keys, day, row id) whose borders follow a sample of the
    rows, and every range sums its own rows in order. An entity that crosses a border is the first of its next range and the
    first or last of all others, so the sums that it brings along come from a table of at most two rows per range, and at
    most one row per range goes back to the rows. Missing keys are an entity of their own, a missing day comes last.
    """
    local = materialised(_local_sums(ranged(df, keys, [day, row_id], slice_rows), value, keys), "ledger")
    # A struct is never NULL itself and equals another one field by field, NULLs included, and sorts as the rows do.
    keyed = local.select("__part", F.struct(*keys).alias("__key"), F.col(value).alias("__value"))
    ends = keyed.groupBy("__part").agg(F.min("__key").alias("__first"), F.max("__key").alias("__last"))
    totals = (
        keyed.join(F.broadcast(ends), "__part")
        .where((F.col("__key") == F.col("__first")) | (F.col("__key") == F.col("__last")))
        .groupBy("__part", "__key")
        .agg(F.sum("__value").alias("__brought"), F.count_if(F.col("__value").isNull()).alias("__missing"))
    )
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    carried = totals.select(
        "__part",
        "__key",
        F.count("__part").over(before).alias("__earlier"),
        F.coalesce(F.sum("__brought").over(before), F.lit(0)).alias("__brought"),
        F.sum("__missing").over(before).alias("__missing"),
    ).where("__earlier > 0")
    joined = local.withColumn("__key", F.struct(*keys)).join(F.broadcast(carried), ["__part", "__key"], "left")
    total = F.col("__sum") + F.coalesce("__brought", F.lit(0))
    gaps = F.col("__gaps") + F.coalesce("__missing", F.lit(0))
    return joined.select(*df.columns, F.when(gaps == 0, total).alias(out))


def earliest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ascending order (missing last): an aggregate, so copies collapse before the shuffle."""
    rank = F.struct(*[c for name in order for c in (F.col(name).isNull(), F.col(name))])
    best = df.groupBy(*[F.col(k).alias(f"__key_{k}") for k in keys]).agg(
        F.min_by(F.struct(*df.columns), rank).alias("__row")
    )
    return best.select("__row.*")


def grain_counts(df: DataFrame, date: str, names: tuple[str, str, str]) -> DataFrame:
    """Row counts of the day, month and year of every row.

    The three counts come from one daily count table, which the calendar bounds; rows are joined to it by day instead
    of being gathered per year. The table is written first, so the join is planned by its real size.
    """
    daily_name, monthly_name, yearly_name = names
    daily = df.groupBy(F.col(date).alias("__day")).agg(F.count(F.lit(1)).alias(daily_name))
    year, month = F.year("__day"), F.month("__day")
    counts = daily.select(
        F.col("__day").alias(date),
        daily_name,
        F.sum(daily_name).over(Window.partitionBy(year, month)).alias(monthly_name),
        F.sum(daily_name).over(Window.partitionBy(year)).alias(yearly_name),
    )
    return null_safe_join(df, materialised(counts, "counts"), [date])


def group_mean_on_rows(df: DataFrame, value: Column, keys: Sequence[str], out: str) -> DataFrame:
    """Put an aggregate of the group on each of its rows by a join, not by gathering the group."""
    means = df.groupBy(*keys).agg(value.alias(out))
    return null_safe_join(df, materialised(means, "means"), keys)

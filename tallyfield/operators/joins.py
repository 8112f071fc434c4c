"""Equi-joins with the source scripts' NULL rule, and spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into twice the session's number of partitions.

    For stages whose cost is computing and not bytes: adaptive execution merges small partitions, but never those of a
    stated number. The number differs from the session's, as Spark drops a repartitioning that equals the one below it
    and would then merge that one.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a missing key matches a missing key; key columns appear once.

    `<=>` is a hashable equi-join predicate, so Spark keeps its hash and sort-merge strategies.
    """
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__right_{k}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "outer", "full_outer", "right"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__right_{k}")) for k in keys})
    return joined.drop(*[f"__right_{k}" for k in keys])


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Shared column names in the left frame's order."""
    names = set(right.columns)
    return [c for c in left.columns if c in names]


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    return null_safe_join(left, right, natural_keys(left, right), how)


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows without a partner (missing keys match each other)."""
    return null_safe_join(left, right.select(*keys).distinct(), keys, "left_anti")


def yearly_spine(entities: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    """Every entity with every year: a generated array per row, so no cross join and no shuffle."""
    return entities.withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))


def daily_spine(entities: DataFrame, first: str | Column, last: str | Column, date: str = "date") -> DataFrame:
    """Every entity with every day of the closed range."""
    low = F.lit(first).cast("date") if isinstance(first, str) else first
    high = F.lit(last).cast("date") if isinstance(last, str) else last
    return entities.withColumn(date, F.explode(F.sequence(low, high, F.expr("interval 1 day"))))


def suffixed(df: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Rename the non-key columns, so that two panels with equal names can meet in one join."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keys})

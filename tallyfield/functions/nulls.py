"""Missing-value rules that differ from SQL's: strict means, kept NULL keys, sorting NULLs last."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_avg(value: Column) -> Column:
    """Mean that is NULL as soon as one value of the group is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def strict_min(value: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), F.min(value))


def strict_weighted_avg(value: Column, weight: Column) -> Column:
    """`strict_avg` over rows that each stand for `weight` equal rows."""
    missing = F.count_if(value.isNull())
    return F.when(missing == 0, F.sum(value * weight) / F.sum(weight))


def not_listed(key: Column, excluded: Iterable) -> Column:
    """Row filter `key not in excluded` that keeps rows without a key."""
    return ~F.coalesce(key.isin(list(excluded)), F.lit(False))


def all_true(flag: Column) -> Column:
    """Group predicate; missing flags are ignored and a group without any flag counts as true."""
    return F.coalesce(F.bool_and(flag), F.lit(True))


def any_true(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def fill_from(target: str, sibling: str) -> Column:
    return F.coalesce(F.col(target), F.col(sibling)).alias(target)


def sort_ascending(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_last(c) for c in columns])


def sort_descending(df: DataFrame, *columns: str, then: Sequence[str] = ()) -> DataFrame:
    """Descending with NULL last; `then` breaks ties in ascending order."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in columns], *[F.asc_nulls_last(c) for c in then])

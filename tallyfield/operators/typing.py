"""Typing of whole tables from their values: one profiling aggregate for all columns, then a plain projection.

The profile is a single row whose width is the number of text columns, so collecting it is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions.text import parse_number, parse_percent

# The patterns and the share that decide a column's type. A rule asks for at least one character on a
# side, for which one character is enough; longer runs only make the matcher go back and forth.
MONTH_DAY_YEAR = "^[0-9]+/[0-9]+/([0-9]{2}|[0-9]{4})$"
YEAR_MONTH_DAY = "^[0-9]{4}/[0-9]+/[0-9]+$"
RATIO = ".:."
GROUPED = ".,."
PERCENT = ".%$"
DIGITS = "[0-9]."
SHARE = 0.9


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _profile(df: DataFrame, columns: list[str], measures: dict) -> dict[str, dict]:
    """All measures of all columns in one pass; `measures` maps a name to a column -> aggregate function."""
    aggregates = [
        build(F.col(f"`{c}`")).alias(f"{i}_{name}") for i, c in enumerate(columns) for name, build in measures.items()
    ]
    row = df.agg(*aggregates).first()
    return {c: {name: row[f"{i}_{name}"] for name in measures} for i, c in enumerate(columns)}


def _as_date(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout)).cast("date")


def _month_day_year(text: Column) -> Column:
    """Four-digit years as they stand; two-digit years from 69 on belong to the last century."""
    short = _as_date(text, "M/d/yy")
    return F.coalesce(
        _as_date(text, "M/d/yyyy"), F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)
    )


def type_dates(df: DataFrame) -> DataFrame:
    """Text columns become DATE when all their values are m/d/y, else when all are y/m/d.

    A column without any value stays as it is.
    """
    columns = _text_columns(df)
    if not columns:
        return df
    seen = _profile(
        df,
        columns,
        {
            "mdy": lambda c: F.bool_and(F.regexp_like(c, F.lit(MONTH_DAY_YEAR))),
            "ymd": lambda c: F.bool_and(F.regexp_like(c, F.lit(YEAR_MONTH_DAY))),
        },
    )
    typed = {}
    for c in columns:
        if seen[c]["mdy"]:
            typed[c] = _month_day_year(F.col(f"`{c}`"))
        elif seen[c]["ymd"]:
            typed[c] = _as_date(F.col(f"`{c}`"), "yyyy/M/d")
    return df.withColumns(typed) if typed else df


def type_numbers(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Text columns become DOUBLE by the share of their values that look like numbers; `keep` names pure text.

    In order: ratios keep their text, then grouped numbers, percentages and plain numbers; a share has to exceed 0.9.
    The plain rule asks only for a digit with something behind it, so names that hold digits belong in `keep`.
    """
    columns = [c for c in _text_columns(df) if c not in keep]
    if not columns:
        return df

    def share(pattern: str):
        return lambda c: F.avg(F.regexp_like(c, F.lit(pattern)).cast("double"))

    seen = _profile(
        df,
        columns,
        {"ratio": share(RATIO), "grouped": share(GROUPED), "percent": share(PERCENT), "digits": share(DIGITS)},
    )
    typed = {}
    for c in columns:
        rule = next((r for r in ("ratio", "grouped", "percent", "digits") if (seen[c][r] or 0.0) > SHARE), None)
        value = F.col(f"`{c}`")
        if rule == "grouped":
            typed[c] = parse_number(value)
        elif rule == "percent":
            typed[c] = parse_percent(value)
        elif rule == "digits":
            typed[c] = value.try_cast("double")
    return df.withColumns(typed) if typed else df

"""Long and wide forms, histograms, box statistics and densities as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.joins import null_safe_join
from tallyfield.operators.quantiles import exact_quantiles, quantiles_of, value_frequencies
from tallyfield.session import materialised


def to_wide(df: DataFrame, rows: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per listed name; two values in one cell raise an error, as there is no rule to choose."""
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several values for one cell"))).otherwise(F.first(value))
    cells = df.groupBy(rows, name).agg(cell.cast(df.schema[value].dataType).alias(value))
    return cells.groupBy(rows).pivot(name, list(names)).agg(F.first(value))


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    typed = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return typed.unpivot(list(ids), list(values), name, value)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins over each column's range: (metric, bin, lower, upper, count), bins counted from one.

    The ranges are one row, taken up by the scan as scalar subqueries.
    """
    long = to_long(df, [], columns, "metric", "value").where(F.col("value").isNotNull())
    ranges = df.agg(
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in columns]),
            F.array(*[F.struct(F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high")) for c in columns]),
        ).alias("r")
    )
    bounded = long.withColumn("r", F.element_at(ranges.scalar(), F.col("metric")))
    width = (F.col("r.high") - F.col("r.low")) / bins
    spot = F.when(F.col("r.high") == F.col("r.low"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("r.low")) / F.nullif(width, F.lit(0.0))) + 1, F.lit(bins))
    )
    return (
        bounded.withColumns({"bin": spot.cast("int"), "width": width, "low": F.col("r.low")})
        .groupBy("metric", "bin", "low", "width")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "metric",
            "bin",
            (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("lower"),
            (F.col("low") + F.col("bin") * F.col("width")).alias("upper"),
            "count",
        )
    )


def box_statistics(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5, ranges: int | None = None) -> DataFrame:
    """Quartiles, whiskers (furthest values within `reach` quartile distances) and the number of outliers per group."""
    freq = materialised(value_frequencies(df, value, by), "frequencies")
    quartiles = quantiles_of(freq, (0.25, 0.5, 0.75), ("q1", "median", "q3"), by, ranges)
    gap = reach * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - gap, F.col("q3") + gap)
    values = null_safe_join(freq, quartiles, by, "inner")
    return values.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        F.sum("n").alias("n"),
    )


def log_density(df: DataFrame, by: str, value: str, cells: int = 64, ranges: int | None = None) -> DataFrame:
    """Gaussian density of log10(value) per group on one grid over the whole range: (by, cell, x, density).

    The plain kernel sum over all values; equal values are counted first, and each then meets every grid point, so the
    work is linear in the distinct values. The bandwidth is 0.9 * min(sd, IQR / 1.34) * n ^ -0.2 per group.
    """
    logs = df.where(F.col(value) > 0).select(by, F.log10(F.col(value).cast("double")).alias("v"))
    logs = materialised(logs, "logs")
    extent = logs.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("e"))
    quartiles = exact_quantiles(logs, "v", (0.25, 0.75), ("q1", "q3"), [by], ranges)
    size = logs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    narrow = F.when(iqr > 0, F.least(F.col("sd"), iqr)).otherwise(F.col("sd"))
    width = 0.9 * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    groups = null_safe_join(size, quartiles, [by], "inner").select(by, "n", width.alias("h")).where(F.col("h") > 0)
    counted = logs.groupBy(by, "v").agg(F.count(F.lit(1)).alias("times"))
    placed = null_safe_join(counted, groups, [by], "inner").withColumn("e", extent.scalar())
    gridded = placed.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    x = F.col("e.low") + F.col("cell") * (F.col("e.high") - F.col("e.low")) / (cells - 1)
    kernel = F.col("times") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2.0)))
    return (
        gridded.withColumn("x", x)
        .groupBy(by, "cell", "x", "n", "h")
        .agg(F.sum(kernel).alias("k"))
        .select(by, "cell", "x", (F.col("k") / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"))
    )

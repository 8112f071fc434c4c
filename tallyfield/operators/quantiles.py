"""Exact quantiles, profiles and summaries without gathering a group in one task.

Values are first reduced to a frequency table. Split points taken over all distinct values cut it into value ranges;
every (group, range) pair is ordered on its own and the ranges before it are added as offsets. The split points are
plain numbers on the driver (at most `ranges`), so both branches of the plan see the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import materialised

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
PROFILE_POINTS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def value_frequencies(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n) for non-missing values."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _ranges(freq: DataFrame, ranges: int) -> DataFrame:
    """Add the number of the value range each distinct value falls into."""
    points = [i / ranges for i in range(1, ranges)]
    cuts = freq.stat.approxQuantile("value", points, 1.0 / (4 * ranges)) if points else []
    splits = [float("-inf"), *sorted({c for c in cuts if c == c}), float("inf")]
    if len(splits) < 3:
        return freq.withColumn("__range", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="value", outputCol="__range", handleInvalid="keep").transform(freq)


def ranked_frequencies(freq: DataFrame, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add `before` and `upto` (rows below, rows up to and including the value) and the group size `total`.

    `freq` is read three times, so hand in a materialised table.
    """
    if ranges is None:
        ranges = max(8, int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # One struct key serves the window and the join: NULL groups stay groups, and the values are shuffled once.
    cut = _ranges(freq, ranges).withColumn("__cell", F.struct(*by, "__range"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    offsets = (
        cut.groupBy("__cell", *by, "__range")
        .agg(F.sum("n").alias("__n"))
        .select(
            "__cell",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
            F.sum("__n").over(Window.partitionBy(*by)).alias("total"),
        )
    )
    within = Window.partitionBy("__cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("__upto", F.sum("n").over(within))
    upto = F.col("__upto") + F.col("__offset")
    return local.join(offsets, "__cell").select(
        *by, "value", "n", (upto - F.col("n")).alias("before"), upto.alias("upto"), "total"
    )


def quantile_at(p: float) -> Column:
    """Linear-interpolation quantile (R's default) as an aggregate over ranked frequencies."""
    h = (F.col("total") - 1) * F.lit(float(p))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col("value")))

    low, high = at(F.floor(h)), at(F.ceil(h))
    part = F.max(h - F.floor(h))
    return low + part * (high - low)


def exact_quantiles(
    df: DataFrame,
    value: str,
    points: Sequence[float] = QUARTILES,
    names: Sequence[str] | None = None,
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """One row per group with one column per quantile, missing values left out."""
    names = names or [f"q{round(p * 100):02d}" for p in points]
    freq = materialised(value_frequencies(df, value, by), "frequencies")
    return quantiles_of(freq, points, names, by, ranges)


def quantiles_of(
    freq: DataFrame,
    points: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """`exact_quantiles` of a frequency table."""
    ranked = ranked_frequencies(freq, by, ranges)
    return ranked.groupBy(*by).agg(*[quantile_at(p).alias(name) for p, name in zip(points, names, strict=True)])


def six_numbers(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Per column: minimum, quartiles, mean, maximum and the number of missing values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    freq = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    freq = materialised(freq, "frequencies")
    ranked = ranked_frequencies(freq.where(F.col("value").isNotNull()), ["column"], ranges)
    stats = ranked.groupBy("column").agg(
        *[quantile_at(p).alias(n) for p, n in zip(QUARTILES, ("min", "q1", "median", "q3", "max"), strict=True)],
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    missing = freq.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing")
    )
    return missing.join(stats, "column", "left")


def profile_table(df: DataFrame, ranges: int | None = None, edge: int = 5) -> DataFrame:
    """One row per column: n, missing, distinct and, for numbers, Info, Mean, Gmd, percentiles and both edges.

    Text columns are counted only. Info is (1 - sum p^3) / (1 - 1/n^2) over value shares p; Gmd is the mean absolute
    difference of all pairs, taken from ranks.
    """
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    other = [c for c in df.columns if c not in numeric]

    # One melt serves every column: the text form counts distinct values, the number form feeds the statistics.
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c).cast("string").alias("text") if c in other else F.lit(None).cast("string").alias("text"),
            F.col(c).cast("double").alias("value") if c in numeric else F.lit(None).cast("double").alias("value"),
        )
        for c in df.columns
    ]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    freq = materialised(long.groupBy("column", "text", "value").agg(F.count(F.lit(1)).alias("n")), "profile")
    present = F.col("text").isNotNull() | F.col("value").isNotNull()
    counts = freq.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(present).alias("distinct"),
    )
    ranked = ranked_frequencies(
        freq.where(F.col("value").isNotNull()).select("column", "value", "n"), ["column"], ranges
    )
    total = F.max("total").cast("double")
    share = F.col("n") / F.col("total")
    info = (1 - F.sum(share * share * share)) / F.nullif(1 - 1 / (total * total), F.lit(0.0))
    spread = F.sum(F.col("value") * F.col("n") * (F.col("before") + F.col("upto") - F.col("total")))
    stats = ranked.groupBy("column").agg(
        info.alias("info"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        (2 * spread / F.nullif(total * (total - 1), F.lit(0.0))).alias("gmd"),
        *[quantile_at(p).alias(f"p{round(p * 100):02d}") for p in PROFILE_POINTS],
    )
    # `row_number() <= edge` is limited inside every task before the shuffle.
    lowest = F.row_number().over(Window.partitionBy("column").orderBy(F.asc("value")))
    highest = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("value")))
    values = freq.where(F.col("value").isNotNull()).select("column", "value")
    low = values.withColumn("r", lowest).where(F.col("r") <= edge)
    high = values.withColumn("r", highest).where(F.col("r") <= edge)
    low_wide = low.groupBy("column").agg(
        *[F.max(F.when(F.col("r") == i, F.col("value"))).alias(f"lowest_{i}") for i in range(1, edge + 1)]
    )
    high_wide = high.groupBy("column").agg(
        *[F.max(F.when(F.col("r") == i, F.col("value"))).alias(f"highest_{i}") for i in range(1, edge + 1)]
    )
    return counts.join(stats, "column", "left").join(low_wide, "column", "left").join(high_wide, "column", "left")

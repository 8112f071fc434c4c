"""Repository usage: monthly and daily panels, size segments, spines, comparisons and rankings of sites."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.dates import month_start
from tallyfield.functions.nulls import all_true, not_listed, strict_avg, strict_min
from tallyfield.operators.joins import daily_spine, natural_join, null_safe_join
from tallyfield.operators.ordered import repair_cumulative, row_numbers, running_total
from tallyfield.operators.quantiles import exact_quantiles
from tallyfield.operators.reshape import to_long
from tallyfield.session import materialised

# Sites left out of the monthly panel, and the one left out of the daily panel.
EXCLUDED_SITES = (2, 5, 8, 1794, 2730)
EXCLUDED_DAILY = (2,)
METRICS = ("downloads", "ttl_uploads", "cum_uploads")

MONTH = ("site_key", "years", "months")


def monthly_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads per site and month with their running total."""
    monthly = uploads.groupBy("site_key", F.year("date").alias("years"), F.month("date").alias("months")).agg(
        F.sum("uploads").alias("ttl_uploads")
    )
    return monthly.withColumn("cum_uploads", running_total(F.col("ttl_uploads"), ["site_key"], ["years", "months"]))


def monthly_panel(uploads: DataFrame, downloads: DataFrame, excluded: Iterable = EXCLUDED_SITES) -> DataFrame:
    """Downloads, uploads and total content per site and month, gaps in the total repaired."""
    content = null_safe_join(downloads, monthly_uploads(uploads), MONTH, "full").fillna(0, ["ttl_uploads"])
    repaired = repair_cumulative(content, "cum_uploads", "ttl_uploads", ["site_key"], ["years", "months"])
    return repaired.where(not_listed(F.col("site_key"), excluded)).select(*MONTH, *METRICS)


def daily_uploads(uploads: DataFrame) -> DataFrame:
    """One row per site and day with the running total."""
    daily = uploads.groupBy("site_key", "date").agg(F.sum("uploads").alias("uploads"))
    return daily.withColumn("ttl_uploads", running_total(F.col("uploads"), ["site_key"], ["date"]))


def daily_panel(uploads: DataFrame, downloads: DataFrame, start: str, excluded: Iterable = EXCLUDED_DAILY) -> DataFrame:
    """Daily downloads from `start` on with the total content of their day, gaps repaired."""
    first = F.lit(start).cast("date")
    recent = daily_uploads(uploads.where(F.col("site_key").isNotNull() & not_listed(F.col("site_key"), excluded))).where(
        F.col("date") >= first
    )
    joined = null_safe_join(downloads.where(F.col("date") >= first), recent, ["site_key", "date"]).fillna(0, ["uploads"])
    return repair_cumulative(joined, "ttl_uploads", "uploads", ["site_key"], ["date"])


def size_thresholds(panel: DataFrame, snapshot: str) -> DataFrame:
    """Quartiles of total content on one day: one row."""
    return exact_quantiles(panel.where(F.col("date") == F.lit(snapshot).cast("date")), "ttl_uploads")


def label_sizes(panel: DataFrame, snapshot: str) -> DataFrame:
    """Rows with known content labelled low, medium or high by the snapshot's quartiles."""
    panel = materialised(panel, "daily-panel")
    cut = size_thresholds(panel, snapshot).select(F.struct("q25", "q75")).scalar()
    rows = panel.where(F.col("ttl_uploads").isNotNull()).withColumn("__cut", cut)
    label = (
        F.when(F.col("ttl_uploads") <= F.col("__cut.q25"), "low")
        .when(F.col("ttl_uploads") >= F.col("__cut.q75"), "high")
        .otherwise("medium")
    )
    return rows.withColumn("repo_group", label).drop("__cut")


def site_segments(labelled: DataFrame, mode: str = "all", snapshot: str | None = None) -> DataFrame:
    """Distinct (site, segment) pairs; `all` keeps every label a site ever had, `snapshot` that of one day."""
    if mode == "snapshot":
        labelled = labelled.where(F.col("date") == F.lit(snapshot).cast("date"))
    elif mode != "all":
        raise ValueError(f"unknown mode {mode!r}")
    return labelled.select("site_key", "repo_group").distinct()


def content_by_segment(panel: DataFrame, segments: DataFrame) -> DataFrame:
    """Average total content per segment and month, with the highest month number since a site's start."""
    numbered = row_numbers(panel.where(F.col("years").isNotNull()), ["site_key"], ["years", "months"], "month_number")
    joined = null_safe_join(
        numbered.withColumn("date", month_start(F.col("years"), F.col("months"))), segments, ["site_key"]
    ).where(F.col("repo_group").isNotNull())
    return joined.groupBy("repo_group", "date").agg(
        F.avg("cum_uploads").alias("average"), F.max("month_number").alias("oldest_month")
    )


def full_daily_panel(sites: DataFrame, uploads: DataFrame, first: str, last: str) -> DataFrame:
    """Every site on every day, uploads zero-filled, with the running total."""
    daily = uploads.groupBy("site_key", "date").agg(F.sum("uploads").alias("uploads"))
    spine = daily_spine(sites.select("site_key"), first, last)
    filled = null_safe_join(spine, daily, ["site_key", "date"]).fillna(0, ["uploads"])
    return filled.withColumn("ttl_uploads", running_total(F.col("uploads"), ["site_key"], ["date"]))


def daily_segment_content(
    sites: DataFrame, uploads: DataFrame, segments: DataFrame, first: str, last: str, excluded: Iterable = EXCLUDED_DAILY
) -> DataFrame:
    """Average total content per segment and day over the full calendar, with the number of sites.

    The mean of running totals equals the running total of the segment's uploads over its number of sites, so the
    calendar is laid out per segment and never per site.
    """
    listed = sites.select("site_key").where(not_listed(F.col("site_key"), excluded))
    members = null_safe_join(listed, segments, ["site_key"], "inner")
    sizes = members.groupBy("repo_group").agg(F.count(F.lit(1)).alias("counts"))
    in_range = uploads.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    per_site = in_range.groupBy("site_key", "date").agg(F.sum("uploads").alias("uploads"))
    daily = null_safe_join(per_site, members, ["site_key"], "inner").groupBy("repo_group", "date").agg(
        F.sum("uploads").alias("uploads")
    )
    spine = null_safe_join(daily_spine(sizes, first, last), daily, ["repo_group", "date"]).fillna(0, ["uploads"])
    total = F.sum("uploads").over(
        Window.partitionBy("repo_group").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    )
    return spine.select("repo_group", "date", (total / F.col("counts")).alias("average"), "counts")


def downloads_by_segment(downloads: DataFrame, segments: DataFrame) -> DataFrame:
    """Smallest daily downloads and number of rows per segment; sites without a segment form their own group."""
    return null_safe_join(downloads, segments, ["site_key"]).groupBy("repo_group").agg(
        strict_min(F.col("downloads")).alias("downloads"), F.count(F.lit(1)).alias("counts")
    )


def cumulative_downloads_by_segment(
    downloads: DataFrame, segments: DataFrame, year: int, month: int, excluded: Iterable = EXCLUDED_SITES
) -> DataFrame:
    """Mean of the sites' running download totals at one month, per segment."""
    kept = downloads.where(not_listed(F.col("site_key"), excluded)).withColumn(
        "ttl_downloads", running_total(F.col("downloads"), ["site_key"], ["years", "months"])
    )
    at = kept.where((F.col("years") == year) & (F.col("months") == month))
    return null_safe_join(at, segments, ["site_key"]).groupBy("repo_group", "years", "months").agg(
        strict_avg(F.col("ttl_downloads")).alias("average"), F.count(F.lit(1)).alias("counts")
    )


def segment_ratios(downloads: DataFrame, content: DataFrame) -> DataFrame:
    """Downloads per content for each segment, and each figure relative to the low segment.

    Inputs are (repo_group, downloads) and (repo_group, content), one row per segment.
    """
    both = downloads.join(content, "repo_group").withColumn("ratio", F.try_divide("downloads", "content"))
    low = both.where(F.col("repo_group") == "low").select(F.struct("downloads", "content", "ratio")).scalar()
    return both.withColumn("__low", low).select(
        "repo_group",
        "downloads",
        "content",
        "ratio",
        F.try_divide("downloads", "__low.downloads").alias("downloads_to_low"),
        F.try_divide("content", "__low.content").alias("content_to_low"),
        F.try_divide("ratio", "__low.ratio").alias("ratio_to_low"),
    )


def site_labels(panel: DataFrame, segments: DataFrame) -> DataFrame:
    """One label per site: low when all its labels are low (or it has none), else medium when all are, else high."""
    flags = null_safe_join(panel.select("site_key").distinct(), segments, ["site_key"]).groupBy("site_key").agg(
        all_true(F.col("repo_group") == "low").alias("low"), all_true(F.col("repo_group") == "medium").alias("medium")
    )
    label = F.when(F.col("low"), "low").when(F.col("medium"), "medium").otherwise("high")
    return flags.select("site_key", label.alias("repo_group"))


def sites_without_uploads(panel: DataFrame, form: str = "zero") -> DataFrame:
    """Sites that never uploaded (`zero`), or with a month whose uploads are unknown (`null`)."""
    if form == "null":
        return panel.where(F.col("ttl_uploads").isNull()).select("site_key").distinct()
    return (
        panel.groupBy("site_key")
        .agg(all_true(F.col("ttl_uploads") == 0).alias("none"))
        .where(F.col("none"))
        .select("site_key")
    )


def sites_by_uploads(panel: DataFrame, ordered: bool = True) -> DataFrame:
    """Sites with their smallest monthly upload, in ascending order unless the caller goes on with the rows."""
    least = panel.groupBy("site_key").agg(F.min("ttl_uploads").alias("least_uploads"))
    return least.orderBy(F.asc_nulls_last("least_uploads"), F.asc_nulls_last("site_key")) if ordered else least


def metric_table(panel: DataFrame, segments: DataFrame, first: str, last: str, sites: Iterable | None = None) -> DataFrame:
    """(site, segment, date, metrics, value) of the three metrics in a closed range of months."""
    joined = natural_join(panel, segments).withColumn("date", month_start(F.col("years"), F.col("months")))
    rows = joined.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if sites is not None:
        rows = rows.where(F.col("site_key").isin(list(sites)))
    return to_long(rows, ["site_key", "repo_group", "date"], METRICS, "metrics", "value")


def intervention_candidates(panel: DataFrame, threshold: float) -> DataFrame:
    """Months with more uploads than the threshold, and the first such month of the site."""
    spikes = panel.where(F.col("ttl_uploads") > threshold).withColumn(
        "date", month_start(F.col("years"), F.col("months"))
    )
    return spikes.withColumn("first_spike", F.min("date").over(Window.partitionBy("site_key")))


def usage_ratio(panel: DataFrame, directory: DataFrame, year: int, month: int) -> DataFrame:
    """Running downloads per content at one month, highest first, with the site directory.

    A site without content has no ratio.
    """
    summed = panel.fillna(0, ["downloads"]).withColumn(
        "ttl_downloads", running_total(F.col("downloads"), ["site_key"], ["years", "months"])
    )
    at = summed.where((F.col("years") == year) & (F.col("months") == month)).select(
        "site_key", "cum_uploads", "ttl_downloads", F.try_divide("ttl_downloads", "cum_uploads").alias("ratio")
    )
    return null_safe_join(at, directory, ["site_key"]).orderBy(F.desc_nulls_last("ratio"), F.asc_nulls_last("site_key"))

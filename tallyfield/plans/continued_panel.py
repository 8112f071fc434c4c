"""The monthly panel of all sites, continued month by month instead of being computed anew.

What later months can still change is little: a site's running total goes on, and the rows from its last known total on may
be repaired otherwise once a later total is known. Everything before that row is settled. So the state holds one row of
totals per site and its open rows, and each step reads the new months alone, adds to the totals, repairs the open rows
together with the new ones, and puts down the rows that have become settled as one more part of the panel.

A step's tables count once its `done` table is complete, which is written last: readers see the panel before or after a step,
a step that breaks off is written anew, and one that is complete is not applied twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.functions.nulls import not_listed
from tallyfield.operators.joins import null_safe_join
from tallyfield.operators.ordered import repair_cumulative
from tallyfield.plans.repository import EXCLUDED_SITES, METRICS, MONTH
from tallyfield.session import materialised

SITE, ORDER = ["site_key"], ["years", "months"]


def month_number(years: Column, months: Column) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    return (years * 12 + months - 1).cast("long")


def continued_totals(monthly: DataFrame, totals: DataFrame) -> DataFrame:
    """New months (`site_key`, years, months, `ttl_uploads`) with `cum_uploads`, which goes on from the sites' totals.

    As in the whole panel, a missing number of uploads leaves this and all later totals missing.
    """
    upto = Window.partitionBy(*SITE).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    known = null_safe_join(monthly, totals, SITE)
    gaps = F.coalesce("__gaps", F.lit(0)) + F.count_if(F.col("ttl_uploads").isNull()).over(upto)
    total = F.coalesce("__total", F.lit(0)) + F.coalesce(F.sum("ttl_uploads").over(upto), F.lit(0))
    return known.select(*MONTH, "ttl_uploads", F.when(gaps == 0, total).alias("cum_uploads"))


def added_totals(monthly: DataFrame, totals: DataFrame) -> DataFrame:
    """The totals after the new months: one row per site."""
    new = monthly.groupBy(*SITE).agg(F.sum("ttl_uploads").alias("__new"), F.count_if(F.col("ttl_uploads").isNull()).alias("__missing"))
    both = null_safe_join(totals, new, SITE, "full")
    return both.select(
        *SITE,
        (F.coalesce("__total", F.lit(0)) + F.coalesce("__new", F.lit(0))).alias("__total"),
        (F.coalesce("__gaps", F.lit(0)) + F.coalesce("__missing", F.lit(0))).alias("__gaps"),
    )


class ContinuedPanel:
    """The panel's settled parts and the state of its last step, below a folder that all executors reach.

    Uploads are rows (`site_key`, `date`, `uploads`), downloads rows (`site_key`, `years`, `months`, `downloads`) with one row
    per site and month. Rows without a month belong to no step and are left out, as are rows of months that an earlier
    step has closed; a missing site is a site of its own. Open rows are bounded by the calendar, even for a site that
    never has a known total.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def steps(self) -> list[int]:
        """Last months of the complete steps, in order; one listing, as many entries as there are steps."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/upto-*/done/_SUCCESS")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getParent().getParent().getName().removeprefix("upto-")) for f in files.globStatus(place) or [])

    def _read(self, steps: Iterable[int], table: str, schema: StructType) -> DataFrame:
        paths = [f"{self.path}/upto-{step}/{table}" for step in steps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def advance(self, uploads: DataFrame, downloads: DataFrame, year: int, month: int) -> bool:
        """Add all months after the last step, up to the given one; False, and nothing happens, if it is closed already."""
        step, done = year * 12 + month - 1, self.steps()
        if done and step <= done[-1]:
            return False
        first = done[-1] + 1 if done else 0
        of_day = month_number(F.year("date"), F.month("date"))
        # Grouped before anything else, so that a site's many rows of one month are a single one when they move.
        monthly = uploads.where(of_day.between(first, step)).groupBy("site_key", F.year("date").alias("years"), F.month("date").alias("months"))
        monthly = materialised(monthly.agg(F.sum("uploads").cast("long").alias("ttl_uploads")), "new-months")
        kinds = {c: monthly.schema[c].dataType.simpleString() for c in MONTH}
        site = f"site_key {kinds['site_key']}"
        totals = self._read(done[-1:], "totals", f"{site}, __total long, __gaps long")
        open_schema = f"{site}, years int, months int, downloads {downloads.schema['downloads'].dataType.simpleString()}, ttl_uploads long, cum_uploads long"
        old = self._read(done[-1:], "open", open_schema)
        fetched = downloads.where(month_number(F.col("years"), F.col("months")).between(first, step)).select(*MONTH, "downloads")
        new = null_safe_join(fetched, continued_totals(monthly, totals), MONTH, "full").fillna(0, ["ttl_uploads"])
        rows = old.unionByName(new.select(old.columns))
        after = Window.partitionBy(*SITE).orderBy(*ORDER).rowsBetween(1, Window.unboundedFollowing)
        known = F.col("cum_uploads").isNotNull()
        marked = rows.withColumns({"__raw": F.col("cum_uploads"), "__settled": F.coalesce(F.max(known).over(after), F.lit(False))})
        marked = materialised(repair_cumulative(marked, "cum_uploads", "ttl_uploads", SITE, ORDER), "continued")
        place = f"{self.path}/upto-{step}"
        marked.where("__settled").select(*MONTH, *METRICS).write.mode("overwrite").parquet(f"{place}/settled")
        still = marked.where("NOT __settled")
        still.select(*MONTH, *METRICS).write.mode("overwrite").parquet(f"{place}/repaired")
        still.select(*MONTH, "downloads", "ttl_uploads", F.col("__raw").alias("cum_uploads")).write.mode("overwrite").parquet(f"{place}/open")
        added_totals(monthly, totals).write.mode("overwrite").parquet(f"{place}/totals")
        self.spark.range(1).write.mode("overwrite").parquet(f"{place}/done")
        return True

    def panel(self, excluded: Iterable = EXCLUDED_SITES) -> DataFrame:
        """The panel after the last complete step: all settled parts, and the open rows as they are repaired for now."""
        done = self.steps()
        if not done:
            raise ValueError(f"no complete step below {self.path}")
        schema = self.spark.read.parquet(f"{self.path}/upto-{done[-1]}/repaired").schema
        rows = self._read(done, "settled", schema).unionByName(self._read(done[-1:], "repaired", schema))
        return rows.where(not_listed(F.col("site_key"), excluded)).select(*MONTH, *METRICS)

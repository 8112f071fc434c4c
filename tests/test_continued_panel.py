"""A panel continued month by month equals the panel computed over all months at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyfield.plans.continued_panel import ContinuedPanel
from tallyfield.plans.repository import monthly_panel
from tallyfield.session import work_path

UPLOADS, DOWNLOADS = "site_key long, date date, uploads long", "site_key long, years int, months int, downloads long"


def tables(spark, seed):
    """Sites with gaps of all kinds: none at all, no uploads, no downloads, missing numbers, a missing site, an excluded one."""
    rng = random.Random(seed)
    uploads, downloads = [], []
    for site in (1, 2, 3, 4, 5, 6, 7, 9, None):
        for k in range(18):
            year, month = 2019 + k // 12, 1 + k % 12
            if site != 3 and rng.random() < (0.3 if site == 6 else 0.6):
                for _ in range(rng.randint(1, 3)):
                    uploads.append((site, dt.date(year, month, rng.randint(1, 28)), None if site == 7 and k == 9 else rng.randint(0, 9)))
            if site != 4 and rng.random() < 0.7:
                downloads.append((site, year, month, rng.choice([None, rng.randint(0, 99)])))
    return spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(downloads, DOWNLOADS)


@pytest.mark.parametrize("ends", [[(2019, 1), (2019, 2), (2019, 7), (2020, 6)], [(2018, 5), (2019, 12), (2025, 1)]])
def test_steps_equal_the_whole_panel(spark, rows, ends):
    uploads, downloads = tables(spark, len(ends))
    panel = ContinuedPanel(spark, work_path(spark, "continued"))
    for year, month in ends:
        assert panel.advance(uploads, downloads, year, month)
        last = year * 12 + month - 1
        so_far = uploads.where(F.year("date") * 12 + F.month("date") - 1 <= last)
        want = monthly_panel(so_far, downloads.where(F.col("years") * 12 + F.col("months") - 1 <= last))
        assert rows(panel.panel()) == rows(want.select(panel.panel().columns))
    before = rows(panel.panel())
    assert not panel.advance(uploads, downloads, *ends[-1]) and not panel.advance(uploads, downloads, *ends[0])
    assert rows(ContinuedPanel(spark, panel.path).panel()) == before


def test_a_step_reads_no_closed_month_and_settles_rows_once(spark, rows):
    uploads, downloads = tables(spark, 5)
    panel = ContinuedPanel(spark, work_path(spark, "continued"))
    panel.advance(uploads, downloads, 2019, 12)
    # closed months may be gone from the source, or hold anything
    new = uploads.where("date >= '2020-01-01'").union(uploads.where("date < '2020-01-01'").withColumn("uploads", F.lit(10**6).cast("long")))
    assert panel.advance(new, downloads.where("years = 2020"), 2020, 6)
    whole = monthly_panel(uploads, downloads)
    assert rows(panel.panel()) == rows(whole)
    first, second = (spark.read.parquet(f"{panel.path}/upto-{step}/settled").select("site_key", "years", "months") for step in panel.steps())
    assert first.count() > 0 and second.count() > 0 and first.intersect(second).count() == 0


def test_a_broken_step_leaves_the_panel(spark, rows):
    uploads, downloads = tables(spark, 6)
    panel = ContinuedPanel(spark, work_path(spark, "continued"))
    with pytest.raises(ValueError, match="no complete step"):
        panel.panel()
    panel.advance(uploads, downloads, 2019, 6)
    before = rows(panel.panel())
    broken = downloads.withColumn("downloads", F.when(F.col("years") == 2020, F.raise_error(F.lit("lost"))).otherwise(F.col("downloads")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        panel.advance(uploads, broken, 2020, 6)
    assert panel.steps() == [2019 * 12 + 5] and rows(panel.panel()) == before
    assert panel.advance(uploads, downloads, 2020, 6)
    assert rows(panel.panel()) == rows(monthly_panel(uploads, downloads))


def test_rows_without_a_month_and_empty_tables(spark, rows):
    uploads = spark.createDataFrame([(1, None, 4), (1, dt.date(2020, 1, 2), 3)], UPLOADS)
    downloads = spark.createDataFrame([(1, None, None, 7), (1, 2020, 2, 8)], DOWNLOADS)
    panel = ContinuedPanel(spark, work_path(spark, "continued"))
    assert panel.advance(uploads.limit(0), downloads.limit(0), 2019, 1) and panel.panel().collect() == []
    assert panel.advance(uploads, downloads, 2020, 2)
    assert rows(panel.panel()) == [(1, 2020, 1, None, 3, 3), (1, 2020, 2, 8, 0, 3)]

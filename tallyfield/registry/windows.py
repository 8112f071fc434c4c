"""Queries for window functions, sorting and unions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.functions.nulls import sort_ascending, sort_descending, strict_avg
from tallyfield.operators.ordered import (
    change_from_previous,
    earliest_rows,
    fill_down_up,
    grain_counts,
    group_mean_on_rows,
    ledger_running_total,
    repair_cumulative,
    row_numbers,
    running_total,
)
from tallyfield.plans.repository import daily_uploads
from tallyfield.plans.subscription import cancellation_history, renewal_history
from tallyfield.registry.cleaning import content_repo, rounded
from tallyfield.registry.composites import ASSET, SINCE, labelled, ledgers, panel, segments, times
from tallyfield.registry.core import query
from tallyfield.sources import tables


@query("e1_grain_counts", """
SELECT row_id, event_date, count(*) OVER (PARTITION BY event_date) AS daily, count(*) OVER (PARTITION BY year(event_date), month(event_date)) AS monthly,
  count(*) OVER (PARTITION BY year(event_date)) AS yearly FROM ledger
""", "ledger")
def e1(spark, folder):
    rows = tables.ledger(spark, folder).select("row_id", "event_date")
    return grain_counts(rows, "event_date", ("daily", "monthly", "yearly"))


@query("e2_ledger_running_total", """
SELECT row_id, account_id, CASE WHEN count(*) OVER w = count(days) OVER w THEN CAST(sum(days) OVER w AS BIGINT) END AS total
FROM (SELECT *, event_date - usage_start_date AS days FROM ledger)
WINDOW w AS (PARTITION BY account_id ORDER BY usage_start_date NULLS LAST, row_id ROWS UNBOUNDED PRECEDING)
""", "ledger")
def e2(spark, folder):
    rows = tables.ledger(spark, folder).select("row_id", "account_id", "usage_start_date", F.datediff("event_date", "usage_start_date").alias("days"))
    return ledger_running_total(rows, "days", ["account_id"], "usage_start_date", "row_id", "total").select("row_id", "account_id", "total")


@query("e2_panel_running_total", """
SELECT site_key, years, months, CASE WHEN count(*) OVER w = count(downloads) OVER w THEN CAST(sum(downloads) OVER w AS BIGINT) END AS total FROM content_repo
WINDOW w AS (PARTITION BY site_key ORDER BY years, months ROWS UNBOUNDED PRECEDING)
""", "content_repo")
def e2_panel(spark, folder):
    return content_repo(spark, folder).select("site_key", "years", "months", running_total(F.col("downloads"), ["site_key"], ["years", "months"]).alias("total"))


@query("e3_gap_repair", "SELECT site_key, date, CAST(uploads AS BIGINT) AS uploads, CAST(ttl_uploads AS BIGINT) AS ttl_uploads FROM daily_repo", "daily_repo")
def e3(spark, folder):
    recent = daily_uploads(tables.uploads(spark, folder).where("site_key <> 2")).where("date >= DATE '2001-01-05'")
    joined = tables.downloads_daily(spark, folder).where("date >= DATE '2001-01-05'").join(recent, ["site_key", "date"], "left").fillna(0, ["uploads"])
    return repair_cumulative(joined, "ttl_uploads", "uploads", ["site_key"], ["date"]).select("site_key", "date", "uploads", "ttl_uploads")


@query("e4_fill_down_up", """
SELECT university_name, CAST(year AS INTEGER) AS year, coalesce(last_value(total_score IGNORE NULLS) OVER b, first_value(total_score IGNORE NULLS) OVER f) AS total_score
FROM times WINDOW b AS (PARTITION BY university_name ORDER BY year ROWS UNBOUNDED PRECEDING),
  f AS (PARTITION BY university_name ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""", "times")
def e4(spark, folder):
    return times(spark, folder).select("university_name", "year", fill_down_up(F.col("total_score"), ["university_name"], ["year"]).alias("total_score"))


@query("e5_change_from_previous", """
SELECT name, decision, round(avg_score - lag(avg_score) OVER (PARTITION BY name ORDER BY decision), 6) AS change
FROM (SELECT name, decision, sum(total_score * n_rows) / sum(n_rows) AS avg_score FROM panel WHERE total_score IS NOT NULL GROUP BY ALL)
""", "panel")
def e5(spark, folder):
    means = (
        panel(spark, folder).where(F.col("total_score").isNotNull()).groupBy("name", "decision")
        .agg((F.sum(F.col("total_score") * F.col("n_rows")) / F.sum("n_rows")).alias("avg_score"))
    )
    return rounded(change_from_previous(means, "avg_score", ["name"], "decision", "change").select("name", "decision", "change"))


@query("e6_months_since_start", """
SELECT site_key, years, months, CAST(row_number() OVER (PARTITION BY site_key ORDER BY years, months) AS INTEGER) AS month_number FROM content_repo
""", "content_repo")
def e6(spark, folder):
    return row_numbers(content_repo(spark, folder), ["site_key"], ["years", "months"], "month_number").select("site_key", "years", "months", "month_number")


@query("e7_earliest_record", """
SELECT row_id, account_id, parent_account, usage_start_date FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, parent_account ORDER BY usage_start_date NULLS LAST, row_id) AS rn FROM ledger) WHERE rn = 1
""", "ledger")
def e7(spark, folder):
    rows = tables.ledger(spark, folder).select("row_id", "account_id", "parent_account", "usage_start_date")
    return earliest_rows(rows, ["account_id", "parent_account"], ["usage_start_date", "row_id"])


@query("e8_segment_mean_on_rows", """
SELECT site_key, date, repo_group, round(CASE WHEN count(*) OVER w = count(downloads) OVER w THEN avg(downloads) OVER w END, 6) AS average
FROM labelled WINDOW w AS (PARTITION BY repo_group, date)
""", "labelled")
def e8(spark, folder):
    rows = labelled(spark, folder).select("site_key", "date", "repo_group", "downloads")
    return rounded(group_mean_on_rows(rows, strict_avg(F.col("downloads")), ["repo_group", "date"], "average").drop("downloads"))


@query("e9_ranked_entities", """
SELECT university_name, CAST(year AS INTEGER) AS year, world_rank FROM (
  SELECT *, count(total_score) OVER (PARTITION BY university_name) AS scored FROM times) WHERE scored > 0
""", "times")
def e9(spark, folder):
    scored = F.count("total_score").over(Window.partitionBy("university_name"))
    return times(spark, folder).withColumn("scored", scored).where(F.col("scored") > 0).select("university_name", "year", "world_rank")


@query("f1_sort_ascending", "SELECT row_id, parent_account, usage_start_date FROM ledger ORDER BY parent_account NULLS LAST, usage_start_date, row_id", "ledger")
def f1(spark, folder):
    return sort_ascending(tables.ledger(spark, folder).select("row_id", "parent_account", "usage_start_date"), "parent_account", "usage_start_date", "row_id")


@query("f2_sort_descending", "SELECT site_key, date, uploads FROM uploads ORDER BY date DESC NULLS LAST, site_key", "uploads")
def f2(spark, folder):
    return sort_descending(tables.uploads(spark, folder), "date", then=["site_key"])


@query("f3_first_rows", "SELECT row_id, event_date, price FROM ledger ORDER BY event_date NULLS LAST, row_id LIMIT 6", "ledger")
def f3(spark, folder):
    return sort_ascending(tables.ledger(spark, folder).select("row_id", "event_date", "price"), "event_date", "row_id").limit(6)


@query("g1_union_by_name", "SELECT row_id, decision, usage_days FROM subscription", "subscription")
def g1(spark, folder):
    renewals, cancellations = ledgers(spark, folder)
    return renewal_history(renewals, ASSET).unionByName(cancellation_history(cancellations, ASSET, SINCE)).select("row_id", "decision", "usage_days")

"""Subscription history out of the renewal and cancellation ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.dates import calendar_parts, days_between
from tallyfield.functions.nulls import fill_from
from tallyfield.functions.text import drop_umbrella
from tallyfield.operators.ordered import SLICE_ROWS, earliest_rows, grain_counts, ledger_running_total

KEPT = (
    "row_id", "account_id", "account_name", "parent_account", "carnegie", "billing_country", "employees", "industry",
    "order_type", "year", "month", "day", "wday", "usage_start_date", "onboarding_days", "usage_days", "price",
)


def clean_ledger(ledger: DataFrame, anchored: bool) -> DataFrame:
    """Umbrella parents blanked, then parent and purchase date filled from their siblings."""
    blanked = ledger.withColumn("parent_account", drop_umbrella(F.col("parent_account"), anchored))
    return blanked.withColumns(
        {
            "parent_account": fill_from("parent_account", "account_name"),
            "purchase_date": fill_from("purchase_date", "usage_start_date"),
        }
    )


def _dated(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "*",
        *calendar_parts(F.col("event_date")),
        days_between(F.col("usage_start_date"), F.col("purchase_date")).alias("onboarding_days"),
        days_between(F.col("event_date"), F.col("usage_start_date")).alias("pre_renewal"),
    )


def renewal_history(renewals: DataFrame, asset: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Renewals of one asset with the usage days summed up per account in order of usage start."""
    rows = _dated(clean_ledger(renewals.where(F.col("asset_name") == asset), anchored=False))
    summed = ledger_running_total(
        rows, "pre_renewal", ["account_id"], "usage_start_date", "row_id", "usage_days", slice_rows
    )
    return summed.select(*KEPT, F.lit(1).alias("decision"))


def cancellation_history(cancellations: DataFrame, asset: str, since: str) -> DataFrame:
    """Cancellations of one asset after a day; per account and parent only the earliest usage start stays."""
    rows = cancellations.where((F.col("asset_name") == asset) & (F.col("event_date") > F.lit(since).cast("date")))
    dated = _dated(clean_ledger(rows, anchored=True)).withColumn("usage_days", F.col("pre_renewal").cast("long"))
    kept = earliest_rows(dated, ["account_id", "parent_account"], ["usage_start_date", "row_id"])
    return kept.select(*KEPT, F.lit(0).alias("decision"))


def subscription_history(
    renewals: DataFrame, cancellations: DataFrame, asset: str, since: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Both ledgers as one history; `decision` is 1 for a renewal and 0 for a cancellation."""
    return renewal_history(renewals, asset, slice_rows).unionByName(cancellation_history(cancellations, asset, since))


def activity_timeline(ledger: DataFrame, asset: str, decision: int, ordered: bool = True) -> DataFrame:
    """Events of one asset with the number of events on their day, in their month and in their year.

    Rows are sorted by date unless the caller goes on with them, as a union would drop the order.
    """
    rows = ledger.where(F.col("asset_name") == asset).select(
        "row_id",
        "event_date",
        "account_name",
        F.year("event_date").alias("event_year"),
        F.month("event_date").alias("event_month"),
    )
    counted = grain_counts(rows, "event_date", ("daily_count", "monthly_count", "yearly_count"))
    marked = counted.withColumn("decision", F.lit(decision))
    return marked.orderBy(F.asc_nulls_last("event_date"), "row_id") if ordered else marked

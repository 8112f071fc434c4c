"""Country lookup and the crawl ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import console_url, country_of, http_hosts
from tallyfield.operators.fuzzy import fuzzy_left_join, unmatched_names
from tallyfield.operators.joins import null_safe_join


def countries(addresses: DataFrame) -> DataFrame:
    """(university, country) out of landed geocoder answers."""
    return addresses.select("university", country_of(F.col("address_components")).alias("country"))


def country_list(customers: DataFrame, addresses: DataFrame, name: str, required: str) -> DataFrame:
    """Country of every distinct name whose `required` column is filled; a name without an answer keeps NULL.

    A name that was looked up more than once takes the alphabetically first country found.
    """
    names = customers.where(F.col(required).isNotNull() & F.col(name).isNotNull()).select(F.col(name).alias("university"))
    found = countries(addresses).groupBy("university").agg(F.min("country").alias("country"))
    return null_safe_join(names.distinct(), found, ["university"])


def listed_hosts(lines: DataFrame, parts: str = "parts") -> DataFrame:
    """Hosts of the first field of each line; lines without an http address yield nothing."""
    first = F.get(F.col(parts), F.lit(0))
    return lines.withColumn("host", F.explode(http_hosts(first)))


def crawl_ledger(hosts: DataFrame, landed: DataFrame) -> DataFrame:
    """Every host with `success` when a result landed, else `try`, the address to fetch and the landed reason.

    `landed` is (host, reason), reason NULL for a complete result; several results of a host count as one.
    """
    results = landed.groupBy("host").agg(
        F.bool_or(F.col("reason").isNull()).alias("complete"), F.max("reason").alias("reason")
    )
    joined = null_safe_join(hosts, results, ["host"])
    done = F.coalesce("complete", F.lit(False))
    return joined.select(
        *[c for c in hosts.columns],
        F.when(done, "success").otherwise("try").alias("status"),
        F.when(~done, F.coalesce("reason", F.lit("no result"))).alias("reason"),
        console_url(F.col("host")).alias("resource_url"),
    )


def enriched_history(history: DataFrame, institutions: DataFrame, sites: DataFrame) -> DataFrame:
    """History rows with every institution within two edits of the parent and every site within four of the account.

    `institutions` is (institution, ...) and `sites` (site, ...); `institution_diff` and `site_diff` are the distances.
    Rows without a partner stay with NULL, and so do those without a name.
    """
    matched = fuzzy_left_join(history, institutions, "parent_account", "institution", k=2, distance_col="institution_diff")
    return fuzzy_left_join(matched, sites, "account_name", "site", k=4, distance_col="site_diff")


def enrichment_misses(history: DataFrame, institutions: DataFrame, sites: DataFrame) -> DataFrame:
    """(kind, name) of the distinct parents and accounts that no listed name comes close to."""
    parents = unmatched_names(history, institutions, "parent_account", "institution", k=2)
    accounts = unmatched_names(history, sites, "account_name", "site", k=4)
    named = [df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("name")) for kind, df in (("institution", parents), ("site", accounts))]
    return named[0].union(named[1])

"""Queries for aggregation, reshaping and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.nulls import all_true, any_true, strict_avg
from tallyfield.operators.fits import linear_fit
from tallyfield.operators.joins import null_safe_join
from tallyfield.operators.quantiles import PROFILE_POINTS, exact_quantiles, profile_table, six_numbers
from tallyfield.operators.reshape import box_statistics, histogram, log_density, to_long, to_wide
from tallyfield.operators.selection import edge_values, selected_boxes, selected_quantiles
from tallyfield.plans import repository
from tallyfield.registry.cleaning import content_repo, rounded
from tallyfield.registry.composites import FIRST_DAY, LAST_DAY, SNAPSHOT, daily, history, labelled, segments, times
from tallyfield.registry.core import query
from tallyfield.session import materialised
from tallyfield.sources import tables

METRICS = repository.METRICS


@query("d1_monthly_sum", "SELECT site_key, years, months, ttl_uploads FROM monthly", "monthly")
def d1(spark, folder):
    return repository.monthly_uploads(tables.uploads(spark, folder)).select("site_key", "years", "months", "ttl_uploads")


@query("d2_mean_without_nulls", "SELECT years, months, round(avg(downloads), 6) AS average FROM content_repo GROUP BY ALL", "content_repo")
def d2(spark, folder):
    return rounded(content_repo(spark, folder).groupBy("years", "months").agg(F.avg("downloads").alias("average")))


@query("d3_strict_mean", """
SELECT site_key, round(CASE WHEN count(*) = count(downloads) THEN avg(downloads) END, 6) AS average FROM content_repo GROUP BY ALL
""", "content_repo")
def d3(spark, folder):
    return rounded(content_repo(spark, folder).groupBy("site_key").agg(strict_avg(F.col("downloads")).alias("average")))


@query("d4_row_count", "SELECT industry, kind, count(*) AS count FROM ledger GROUP BY ALL", "ledger")
def d4(spark, folder):
    return tables.ledger(spark, folder).groupBy("industry", "kind").agg(F.count(F.lit(1)).alias("count"))


@query("d5_minimum_and_count", """
SELECT repo_group, CASE WHEN count(*) = count(downloads) THEN min(downloads) END AS downloads, count(*) AS counts
FROM downloads_d LEFT JOIN segments USING (site_key) GROUP BY repo_group
""", "downloads_d segments")
def d5(spark, folder):
    return repository.downloads_by_segment(tables.downloads_daily(spark, folder), segments(spark, folder))


@query("d6_distinct", "SELECT DISTINCT parent_account, industry FROM ledger", "ledger")
def d6(spark, folder):
    return tables.ledger(spark, folder).select("parent_account", "industry").distinct()


def _profile_sql(columns):
    parts = []
    for c in columns:
        points = ", ".join(f"round(quantile_cont(v, {p}), 6) AS p{round(p * 100):02d}" for p in PROFILE_POINTS)
        edges = ", ".join(
            [f"low[{i}] AS lowest_{i}" for i in range(1, 6)] + [f"high[{i}] AS highest_{i}" for i in range(1, 6)]
        )
        parts.append(f"""
SELECT '{c}' AS "column", n, missing, "distinct", round((1 - cubes) / (1 - 1 / (n * n)), 6) AS info, round(mean, 6) AS mean, round(gmd, 6) AS gmd,
  p05, p10, p25, p50, p75, p90, p95, {edges}
FROM (SELECT count(v) AS n, count(*) - count(v) AS missing, count(DISTINCT v) AS "distinct", avg(v) AS mean, {points},
    list_sort(list(DISTINCT v) FILTER (v IS NOT NULL)) AS low, list_reverse_sort(list(DISTINCT v) FILTER (v IS NOT NULL)) AS high
  FROM (SELECT CAST({c} AS DOUBLE) AS v FROM content_repo)),
 (SELECT sum(share * share * share) AS cubes FROM (SELECT count(*) / (SELECT count({c}) FROM content_repo) AS share FROM content_repo WHERE {c} IS NOT NULL GROUP BY {c})),
 (SELECT 2 * sum((2 * r - m - 1) * v) / (m * (m - 1)) AS gmd FROM (SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS m
   FROM content_repo WHERE {c} IS NOT NULL) GROUP BY m)""")
    nulls = ", ".join(["CAST(NULL AS DOUBLE)"] * (3 + 7 + 10))
    parts.append(f"""
SELECT 'label', count(label), count(*) - count(label), count(DISTINCT label), {nulls}
FROM (SELECT 'm' || months AS label FROM content_repo)""")
    return " UNION ALL ".join(parts)


@query("d7_table_profile", _profile_sql(METRICS), "content_repo")
def d7(spark, folder):
    rows = content_repo(spark, folder).select(*METRICS, F.concat(F.lit("m"), F.col("months").cast("string")).alias("label"))
    return rounded(profile_table(rows))


_SIX = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, CAST(max({c}) AS DOUBLE) AS max,
  round(avg({c}), 6) AS mean FROM subscription"""
    for c in ("decision", "usage_days", "onboarding_days", "price")
)


@query("d8_six_numbers", _SIX, "subscription")
def d8(spark, folder):
    return rounded(six_numbers(history(spark, folder), ["decision", "usage_days", "onboarding_days", "price"]))


@query("d9_snapshot_quartiles", "SELECT * FROM cuts", "cuts")
def d9(spark, folder):
    return rounded(repository.size_thresholds(daily(spark, folder), SNAPSHOT))


@query("d10_group_predicates", """
SELECT site_key, coalesce(bool_and(downloads IS NULL), true) AS all_missing, coalesce(bool_or(downloads IS NULL), false) AS any_missing,
  coalesce(bool_and(repo_group = 'low'), true) AS all_low FROM content_repo LEFT JOIN segments USING (site_key) GROUP BY site_key
""", "content_repo segments")
def d10(spark, folder):
    joined = null_safe_join(content_repo(spark, folder), segments(spark, folder), ["site_key"])
    return joined.groupBy("site_key").agg(
        all_true(F.col("downloads").isNull()).alias("all_missing"),
        any_true(F.col("downloads").isNull()).alias("any_missing"),
        all_true(F.col("repo_group") == "low").alias("all_low"),
    )


@query("d11_series_extent", "SELECT min(date) AS first_day, max(date) AS last_day FROM downloads_d", "downloads_d")
def d11(spark, folder):
    return tables.downloads_daily(spark, folder).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))


_NATIONS = [f"NATION_{i}" for i in range(25)]


@query("d12_long_to_wide", "SELECT CAST(year AS INTEGER) AS year, " + ", ".join(
    f"round(avg(total_score) FILTER (country = '{n}'), 6) AS {n}" for n in _NATIONS) + " FROM times GROUP BY year", "times")
def d12(spark, folder):
    scores = times(spark, folder).groupBy("year", "country").agg(F.avg("total_score").alias("score"))
    return rounded(to_wide(scores, "year", "country", "score", _NATIONS))


@query("d13_wide_to_long", """
SELECT site_key, years, months, metrics, value FROM content_repo, LATERAL (VALUES ('downloads', CAST(downloads AS DOUBLE)),
  ('ttl_uploads', CAST(ttl_uploads AS DOUBLE)), ('cum_uploads', CAST(cum_uploads AS DOUBLE))) v(metrics, value)
""", "content_repo")
def d13(spark, folder):
    return to_long(content_repo(spark, folder), ["site_key", "years", "months"], METRICS, "metrics", "value")


@query("d14_histogram", " UNION ALL ".join(f"""
SELECT '{c}' AS metric, CAST(bin AS INTEGER) AS bin, round(low + (bin - 1) * width, 6) AS lower, round(low + bin * width, 6) AS upper, count(*) AS count
FROM (SELECT least(floor(({c} - low) / width) + 1, 30) AS bin, low, width FROM content_repo,
  (SELECT CAST(min({c}) AS DOUBLE) AS low, (max({c}) - min({c})) / 30 AS width FROM content_repo) WHERE {c} IS NOT NULL) GROUP BY ALL""" for c in METRICS), "content_repo")
def d14(spark, folder):
    return rounded(histogram(content_repo(spark, folder), METRICS))


@query("d15_box_statistics", """
WITH low AS (SELECT date, downloads FROM labelled WHERE repo_group = 'low'),
q AS (SELECT date, quantile_cont(downloads, 0.25) AS q1, quantile_cont(downloads, 0.5) AS median, quantile_cont(downloads, 0.75) AS q3 FROM low GROUP BY date)
SELECT date, q1, median, q3, CAST(min(downloads) FILTER (downloads BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_low,
  CAST(max(downloads) FILTER (downloads BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_high,
  count(*) FILTER (NOT downloads BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
FROM low JOIN q USING (date) GROUP BY date, q1, median, q3
""", "labelled")
def d15(spark, folder):
    return rounded(box_statistics(labelled(spark, folder).where(F.col("repo_group") == "low"), ["date"], "downloads"))


@query("d16_log_density", """
WITH logs AS (SELECT repo_group, log10(ttl_uploads) AS v FROM labelled WHERE ttl_uploads > 0 AND date = DATE '2001-01-05'),
e AS (SELECT min(v) AS low, (max(v) - min(v)) / 63 AS step FROM logs),
size AS (SELECT repo_group, n, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * pow(n, -0.2) AS h FROM (
  SELECT repo_group, count(*) AS n, stddev_samp(v) AS sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iqr FROM logs GROUP BY repo_group))
SELECT repo_group, CAST(cell AS INTEGER) AS cell, round(low + cell * step, 6) AS x,
  round(sum(exp(-0.5 * pow((low + cell * step - v) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM logs JOIN size USING (repo_group), e, (SELECT unnest(range(0, 64)) AS cell) g WHERE h > 0 GROUP BY repo_group, cell, low, step, n, h
""", "labelled")
def d16(spark, folder):
    on_day = labelled(spark, folder).where(F.col("date") == F.lit(SNAPSHOT).cast("date"))
    return rounded(log_density(on_day, "repo_group", "ttl_uploads"))


@query("d17_segment_ratios", """
WITH d AS (SELECT repo_group, CAST(sum(downloads) AS DOUBLE) AS downloads FROM downloads_d JOIN segments USING (site_key) WHERE date = DATE '2001-01-05' GROUP BY 1),
r AS (SELECT repo_group, downloads, average AS content, downloads / average AS ratio FROM d JOIN spine_content USING (repo_group) WHERE date = DATE '2001-01-05')
SELECT r.repo_group, r.downloads, round(r.content, 6) AS content, round(r.ratio, 6) AS ratio, round(r.downloads / l.downloads, 6) AS downloads_to_low,
  round(r.content / l.content, 6) AS content_to_low, round(r.ratio / l.ratio, 6) AS ratio_to_low
FROM r, (SELECT * FROM r WHERE repo_group = 'low') l
""", "downloads_d segments spine_content")
def d17(spark, folder):
    groups = segments(spark, folder)
    at = F.col("date") == F.lit(SNAPSHOT).cast("date")
    downloads = null_safe_join(tables.downloads_daily(spark, folder).where(at), groups, ["site_key"], "inner")
    content = repository.daily_segment_content(tables.sites(spark, folder), tables.uploads(spark, folder), groups, FIRST_DAY, LAST_DAY)
    return rounded(
        repository.segment_ratios(
            downloads.groupBy("repo_group").agg(F.sum("downloads").cast("double").alias("downloads")),
            content.where(at).select("repo_group", F.col("average").alias("content")),
        )
    )


@query("d18_linear_fit", """
SELECT site_key, round(regr_slope(downloads, cum_uploads), 6) AS slope, round(regr_intercept(downloads, cum_uploads), 6) AS intercept,
  round(regr_r2(downloads, cum_uploads), 6) AS r2, CAST(regr_count(downloads, cum_uploads) AS BIGINT) AS n FROM content_repo GROUP BY site_key
""", "content_repo")
def d18(spark, folder):
    return rounded(linear_fit(content_repo(spark, folder), "downloads", "cum_uploads", ["site_key"]))


@query("d19_standard_deviation", """
SELECT site_key, round(stddev_samp(downloads), 6) AS sd_downloads, round(stddev_samp(cum_uploads), 6) AS sd_content FROM content_repo GROUP BY site_key
""", "content_repo")
def d19(spark, folder):
    return rounded(
        content_repo(spark, folder).groupBy("site_key").agg(F.stddev_samp("downloads").alias("sd_downloads"), F.stddev_samp("cum_uploads").alias("sd_content"))
    )


@query("d9_quantiles_by_group", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.0), 6) AS q00, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, round(quantile_cont(l_extendedprice, 1.0), 6) AS q100
FROM lineitem GROUP BY l_returnflag
""")
def d9_groups(spark, folder):
    return rounded(exact_quantiles(tables.table(spark, folder, "lineitem"), "l_extendedprice", by=["l_returnflag"]))


@query("d7_edge_values", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{side}' AS side, CAST(place AS INTEGER) AS place, CAST(v AS DOUBLE) AS value
FROM (SELECT v, row_number() OVER (ORDER BY v {order}) AS place FROM (SELECT DISTINCT {c} AS v FROM content_repo WHERE {c} IS NOT NULL)) WHERE place <= 5"""
    for c in METRICS for side, order in (("lowest", "ASC"), ("highest", "DESC"))), "content_repo")
def d7_edges(spark, folder):
    return edge_values(content_repo(spark, folder), METRICS)


@query("d8_selected_six_numbers", _SIX, "subscription")
def d8_selected(spark, folder):
    measures = ["decision", "usage_days", "onboarding_days", "price"]
    rows = materialised(history(spark, folder).select(*measures), "measures")
    found = selected_quantiles(rows, measures, (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    return rounded(found.drop("n"))


_BY_FLAG = " UNION ALL ".join(f"""
SELECT l_returnflag, '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(avg({c}), 6) AS mean, {", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS p{round(p * 100):02d}" for p in PROFILE_POINTS)}
FROM lineitem GROUP BY l_returnflag""" for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query("d9_selected_quantiles", _BY_FLAG)
def d9_selected(spark, folder):
    names = [f"p{round(p * 100):02d}" for p in PROFILE_POINTS]
    rows = tables.table(spark, folder, "lineitem")
    return rounded(selected_quantiles(rows, ["l_quantity", "l_extendedprice", "l_discount"], PROFILE_POINTS, names, ["l_returnflag"]))


@query("d15_selected_boxes", """
WITH q AS (SELECT l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_linestatus)
SELECT l_linestatus, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(l_extendedprice) AS n
FROM lineitem JOIN q USING (l_linestatus) GROUP BY l_linestatus, q1, median, q3
""")
def d15_selected(spark, folder):
    return rounded(selected_boxes(tables.table(spark, folder, "lineitem"), ["l_linestatus"], "l_extendedprice"))

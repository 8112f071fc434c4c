"""Queries for sources, sinks, typing and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.dates import calendar_parts, days_between, month_start
from tallyfield.functions.nulls import fill_from, not_listed
from tallyfield.functions.text import (
    console_url,
    country_of,
    drop_umbrella,
    join_key,
    named_institution,
    parse_number,
    parse_percent,
    period_label,
    range_midpoint,
    split_fields,
)
from tallyfield.operators.fits import standardised
from tallyfield.operators.joins import null_safe_join
from tallyfield.operators.typing import type_dates, type_numbers
from tallyfield.plans.enrichment import listed_hosts
from tallyfield.plans.ranking import RENAMED, complete_entities
from tallyfield.plans.repository import monthly_panel
from tallyfield.registry.core import query
from tallyfield.session import work_path
from tallyfield.sources import files, tables
from tallyfield.sources.landing import Landing


def rounded(df, digits: int = 6):
    """Doubles rounded for comparison; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def content_repo(spark, folder):
    return monthly_panel(tables.uploads(spark, folder), tables.downloads_monthly(spark, folder))


@query("a1_csv_scan", "SELECT row_id, account_id, account_name, parent_account, usage_start_date, event_date, price FROM ledger", "ledger")
def a1(spark, folder):
    path = work_path(spark, "ledger-csv")
    rows = tables.ledger(spark, folder).select("row_id", "account_id", "account_name", "parent_account", "usage_start_date", "event_date", "price")
    files.write_csv(rows, path)
    schema = "row_id bigint, account_id bigint, account_name string, parent_account string, usage_start_date date, event_date date, price double"
    return files.read_csv(spark, path, schema)


def payload_documents(spark, folder):
    """Landed documents of at most a hundred entities each, so that no document grows with the table, and their file names."""
    entry = F.struct(*[c.split()[0] for c in tables.PAYLOAD_ROW.split(", ")])
    parts = tables.payload(spark, folder).groupBy("year", F.floor(F.col("entry_id") / 100).alias("part"))
    name = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("year", "part")])
    return parts.agg(F.collect_list(entry).alias("data")).select(F.concat(name, F.lit(".json")).alias("file"), "data")


_PAYLOAD_SQL = "SELECT name, location, year, rank_order, scores_overall, stats_female_male_ratio FROM payload"
_PAYLOAD_COLUMNS = ("name", "location", "year", "rank_order", "scores_overall", "stats_female_male_ratio")


@query("a2_ranking_payload", _PAYLOAD_SQL, "payload")
def a2(spark, folder):
    path = work_path(spark, "payload-json")
    files.write_json(payload_documents(spark, folder).select("data"), path)
    return files.read_ranking_payload(spark, path, tables.PAYLOAD_ROW, multi_line=False).select(*_PAYLOAD_COLUMNS)


@query("a2_payload_per_file", _PAYLOAD_SQL, "payload")
def a2_files(spark, folder):
    """One document per file, as the source lands them."""
    path = work_path(spark, "payload-files")
    files.write_documents(payload_documents(spark, folder), path)
    return files.read_ranking_payload(spark, path, tables.PAYLOAD_ROW).select(*_PAYLOAD_COLUMNS)


@query("a2_landing_manifest", """
SELECT CAST(year AS INTEGER) AS year, count(*) AS n, 0::BIGINT AS read_again, 1::BIGINT AS broken FROM payload GROUP BY year
""", "payload")
def a2_landing(spark, folder):
    """Documents landed twice and once more with a file that breaks off: entries by year, files read again, broken files."""
    path, state = work_path(spark, "payload-landed"), Landing(spark, work_path(spark, "landing"), tables.PAYLOAD_ROW)
    files.write_documents(payload_documents(spark, folder), path)
    state.take(path)
    again = state.take(path)
    half = state.documents(1).limit(1).select(F.substring(F.to_json(F.struct("data")), 1, 40).alias("value"))
    half.coalesce(1).write.mode("append").text(path)
    state.take(path)
    broken = state.broken().agg(F.count(F.lit(1))).scalar()
    return state.rows().groupBy("year").agg(F.count(F.lit(1)).alias("n")).select("year", "n", F.lit(again).cast("long").alias("read_again"), broken.alias("broken"))


@query("a3_field_lines", """
SELECT trim(split_part(line, ',', 1)) AS first_part, trim(split_part(line, ',', 2)) AS second_part,
  CAST(len(string_split(line, ',')) AS INTEGER) AS n_parts
FROM (SELECT trim(url || ' , ' || page_id || ' ,', ',') AS line FROM pages)
""")
def a3(spark, folder):
    path = work_path(spark, "lines-text")
    tables.table(spark, folder, "pages").select(F.concat("url", F.lit(" , "), F.col("page_id").cast("string"), F.lit(" ,")).alias("value")).write.text(path)
    parts = files.read_field_lines(spark, path)
    return parts.select(F.get("parts", F.lit(0)).alias("first_part"), F.get("parts", F.lit(1)).alias("second_part"), F.size("parts").alias("n_parts"))


@query("a4_csv_sink", "SELECT site_key, years, months, downloads FROM downloads_m", "downloads_m")
def a4(spark, folder):
    path = work_path(spark, "downloads-csv")
    files.write_csv(tables.downloads_monthly(spark, folder), path)
    return files.read_csv(spark, path, "site_key bigint, years int, months int, downloads bigint")


@query("a4_partitioned_panel", "SELECT site_key, months, downloads, ttl_uploads, cum_uploads, years FROM content_repo WHERE years >= 2000", "content_repo")
def a4_panel(spark, folder):
    path = work_path(spark, "panel")
    files.write_panel(content_repo(spark, folder), path, ["years"])
    return spark.read.parquet(path).where(F.col("years") >= 2000)


@query("a5_json_sink", """
SELECT host, CASE WHEN bool_or(html LIKE '%<title>%') THEN 'success' ELSE 'try' END AS status FROM hosts JOIN pages USING (page_id)
GROUP BY host
""", "hosts")
def a5(spark, folder):
    from tallyfield.registry.composites import crawl

    path = work_path(spark, "crawl-json")
    files.write_json(crawl(spark, folder).select("host", "status").distinct(), path)
    return spark.read.schema("host string, status string").json(path)


@query("b1_date_typing", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS short_date, CAST(o_orderdate AS DATE) AS long_date, CAST(o_orderdate AS DATE) AS iso_date,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y/%-m/%-d') ELSE strftime(o_orderdate, '%-m/%-d/%y') END AS mixed,
  o_orderpriority
FROM orders
""")
def b1(spark, folder):
    day = F.col("o_orderdate")
    text = tables.table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format(day, "M/d/yy").alias("short_date"),
        F.date_format(day, "M/d/yyyy").alias("long_date"),
        F.date_format(day, "yyyy/M/d").alias("iso_date"),
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy/M/d")).otherwise(F.date_format(day, "M/d/yy")).alias("mixed"),
        "o_orderpriority",
    )
    return type_dates(text)


@query("b2_number_typing", """
SELECT name, year, CAST(cnt * 10 AS DOUBLE) AS rank_order, stats_female_male_ratio,
  round((cnt + 10) + (score % 10) / 10, 6) AS scores_teaching,
  CAST((score + 1) * 1000 + cnt * 7 % 1000 AS DOUBLE) AS stats_number_students,
  CASE WHEN score % 23 = 0 THEN 0.0 ELSE CAST(score AS DOUBLE) END AS stats_pc_intl_students
FROM rank_source JOIN payload USING (name, year)
""", "rank_source payload")
def b2(spark, folder):
    text = tables.payload(spark, folder).select(
        "name", "year", "rank_order", "scores_teaching", "stats_number_students", "stats_pc_intl_students", "stats_female_male_ratio"
    )
    return rounded(type_numbers(text, keep=("name",)))


@query("b3_parse_number", r"""
SELECT p_partkey, CAST(p_size * 1000 + p_size AS DOUBLE) AS grouped, CAST(nullif(regexp_extract(p_brand, '[0-9]+'), '') AS DOUBLE) AS brand,
  CAST(NULL AS DOUBLE) AS no_number, round(-p_retailprice, 6) AS signed
FROM part
""")
def b3(spark, folder):
    part = tables.table(spark, folder, "part")
    number = F.col("p_size") * 1000 + F.col("p_size")
    return rounded(
        part.select(
            "p_partkey",
            parse_number(F.concat(F.lit("about "), F.format_number(number, 0), F.lit(" pieces, or so"))).alias("grouped"),
            parse_number(F.col("p_brand")).alias("brand"),
            parse_number(F.col("p_type")).alias("no_number"),
            parse_number(F.concat(F.lit("EUR -"), F.col("p_retailprice").cast("string"))).alias("signed"),
        )
    )


@query("b4_range_midpoint", """
SELECT name, year, CASE WHEN score % 7 = 0 THEN NULL WHEN score % 3 = 0 THEN score + 2.5 ELSE score + 0.5 END::DOUBLE AS score FROM rank_source
""", "rank_source")
def b4(spark, folder):
    return tables.payload(spark, folder).select("name", "year", range_midpoint(F.col("scores_overall")).alias("score"))


@query("b5_percent_repair", """
SELECT name, year, CASE WHEN score % 23 = 0 THEN 0.0 ELSE CAST(score AS DOUBLE) END AS share FROM rank_source
""", "rank_source")
def b5(spark, folder):
    return tables.payload(spark, folder).select("name", "year", parse_percent(F.col("stats_pc_intl_students")).alias("share"))


@query("b6_join_key", "SELECT doc_id, regexp_replace(text, '[^0-9a-zA-Z]+', '', 'g') AS name FROM documents")
def b6(spark, folder):
    return tables.table(spark, folder, "documents").select("doc_id", join_key(F.col("text")).alias("name"))


@query("b7_umbrella_parents", """
SELECT row_id, nullif(regexp_replace(parent_account, '(.+System$)|(.+Consortium$)', ''), '') AS anchored,
  nullif(regexp_replace(parent_account, '(.+System$)|(.+Consortium)', ''), '') AS open FROM ledger
""", "ledger")
def b7(spark, folder):
    parent = F.col("parent_account")
    return tables.ledger(spark, folder).select("row_id", drop_umbrella(parent, True).alias("anchored"), drop_umbrella(parent, False).alias("open"))


@query("b8_fill_from_sibling", """
SELECT row_id, coalesce(parent_account, account_name) AS parent_account, coalesce(purchase_date, usage_start_date) AS purchase_date FROM ledger
""", "ledger")
def b8(spark, folder):
    return tables.ledger(spark, folder).select("row_id", fill_from("parent_account", "account_name"), fill_from("purchase_date", "usage_start_date"))


@query("b9_missing_to_zero", "SELECT site_key, years, months, coalesce(downloads, 0) AS downloads, ttl_uploads FROM content", "content")
def b9(spark, folder):
    from tallyfield.plans.repository import MONTH, monthly_uploads

    joined = null_safe_join(tables.downloads_monthly(spark, folder), monthly_uploads(tables.uploads(spark, folder)), MONTH, "full")
    return joined.fillna(0, ["downloads", "ttl_uploads"]).select(*MONTH, "downloads", "ttl_uploads")


@query("b10_calendar_parts", """
SELECT row_id, CAST(year(event_date) AS INTEGER) AS year, CAST(month(event_date) AS INTEGER) AS month, CAST(day(event_date) AS INTEGER) AS day,
  CAST(dayofweek(event_date) + 1 AS INTEGER) AS wday FROM ledger
""", "ledger")
def b10(spark, folder):
    return tables.ledger(spark, folder).select("row_id", *calendar_parts(F.col("event_date")))


@query("b11_day_differences", """
SELECT row_id, CAST(usage_start_date - purchase_date AS INTEGER) AS onboarding_days, CAST(event_date - usage_start_date AS INTEGER) AS usage_days FROM ledger
""", "ledger")
def b11(spark, folder):
    return tables.ledger(spark, folder).select(
        "row_id",
        days_between(F.col("usage_start_date"), F.col("purchase_date")).alias("onboarding_days"),
        days_between(F.col("event_date"), F.col("usage_start_date")).alias("usage_days"),
    )


@query("b12_month_start", "SELECT site_key, make_date(years, months, 1) AS date, downloads FROM downloads_m", "downloads_m")
def b12(spark, folder):
    return tables.downloads_monthly(spark, folder).select("site_key", month_start(F.col("years"), F.col("months")).alias("date"), "downloads")


@query("b13_constant_tags", "SELECT row_id, CAST(CASE kind WHEN 'renewal' THEN 1 ELSE 0 END AS INTEGER) AS decision FROM ledger", "ledger")
def b13(spark, folder):
    rows = tables.ledger(spark, folder)
    tagged = [rows.where(F.col("kind") == kind).withColumn("decision", F.lit(tag)) for kind, tag in (("renewal", 1), ("cancellation", 0))]
    return tagged[0].unionByName(tagged[1]).select("row_id", "decision")


@query("b14_project_and_rename", """
SELECT rank_order AS world_rank, name AS university_name, location AS country, scores_teaching AS teaching,
  scores_international_outlook AS international, scores_research AS research, scores_citations AS citations,
  scores_industry_income AS income, scores_overall AS total_score, stats_number_students AS num_students,
  stats_student_staff_ratio AS student_staff_ratio, stats_pc_intl_students AS international_students,
  stats_female_male_ratio AS female_male_ratio, year FROM payload
""", "payload")
def b14(spark, folder):
    return tables.payload(spark, folder).drop("entry_id").withColumnsRenamed(RENAMED)


@query("b15_rescale", """
SELECT site_key, years, months, round(downloads / stddev_samp(downloads) OVER (PARTITION BY site_key), 6) AS y,
  round(cum_uploads / stddev_samp(cum_uploads) OVER (PARTITION BY site_key), 6) AS x, downloads / 10 AS tenth FROM content_repo
""", "content_repo")
def b15(spark, folder):
    return rounded(
        content_repo(spark, folder).select(
            "site_key", "years", "months", standardised("downloads", ["site_key"]).alias("y"), standardised("cum_uploads", ["site_key"]).alias("x"), (F.col("downloads") / 10).alias("tenth")
        )
    )


@query("b16_conditional_values", """
SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'low' WHEN c_acctbal >= 5000 THEN 'high' ELSE 'medium' END AS bucket,
  CAST(sign(c_acctbal) AS INTEGER) AS direction, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer
""")
def b16(spark, folder):
    balance = F.col("c_acctbal")
    return tables.table(spark, folder, "customer").select(
        "c_custkey",
        F.when(balance <= 0, "low").when(balance >= 5000, "high").otherwise("medium").alias("bucket"),
        F.signum(balance).cast("int").alias("direction"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    )


@query("b17_composed_text", """
SELECT page_id, host, 'https://search.google.com/u/1/search-console/index?resource_id=https%3A%2F%2F' || host || '%2F' AS resource_url,
  year(d.day) || '/' || month(d.day) AS label
FROM hosts, (SELECT min(CAST(o_orderdate AS DATE)) AS day FROM orders) d
""", "hosts")
def b17(spark, folder):
    day = tables.table(spark, folder, "orders").agg(F.min(F.col("o_orderdate").cast("date")))
    hosts = listed_hosts(tables.table(spark, folder, "pages").select("page_id", split_fields(F.col("url")).alias("parts")))
    dated = hosts.withColumn("day", day.scalar())
    return dated.select("page_id", "host", console_url(F.col("host")).alias("resource_url"), period_label(F.year("day"), F.month("day")).alias("label"))


@query("b18_regex_extraction", r"""
SELECT h.page_id, h.host, CAST(NULL AS VARCHAR) AS institution, regexp_replace(h.host, '^([a-z]+)\.(.*)$', '\2.\1') AS swapped
FROM hosts h
UNION ALL
SELECT doc_id, NULL, nullif(regexp_extract(text || chr(10) || 'State University of ' || lang, '([a-zA-Z_]+?)\sUniversity of\s([a-zA-Z_\s]+)'), ''), NULL FROM documents
""", "hosts")
def b18(spark, folder):
    hosts = listed_hosts(tables.table(spark, folder, "pages").select("page_id", split_fields(F.col("url")).alias("parts")))
    found = hosts.select("page_id", "host", F.lit(None).cast("string").alias("institution"), F.regexp_replace("host", r"^([a-z]+)\.(.*)$", "$2.$1").alias("swapped"))
    sentence = F.concat(F.col("text"), F.lit("\nState University of "), F.col("lang"))
    named = tables.table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("host"), named_institution(sentence).alias("institution"), F.lit(None).cast("string").alias("swapped")
    )
    return found.unionByName(named)


@query("b19_country_lookup", "SELECT c_name AS university, n_name AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def b19(spark, folder):
    return tables.addresses(spark, folder).select("university", country_of(F.col("address_components")).alias("country"))


@query("b20_null_filter", "SELECT row_id FROM ledger WHERE parent_account IS NOT NULL AND event_date IS NOT NULL", "ledger")
def b20(spark, folder):
    return tables.ledger(spark, folder).where(F.col("parent_account").isNotNull() & F.col("event_date").isNotNull()).select("row_id")


@query("b21_filters", """
SELECT row_id FROM ledger WHERE asset_name = 'Repository' AND event_date > DATE '1996-01-01' AND NOT (billing_country = 'NATION_3' AND industry = 'MACHINERY')
""", "ledger")
def b21(spark, folder):
    return (
        tables.ledger(spark, folder)
        .where((F.col("asset_name") == "Repository") & (F.col("event_date") > F.lit("1996-01-01").cast("date")))
        .where(~((F.col("billing_country") == "NATION_3") & (F.col("industry") == "MACHINERY")))
        .select("row_id")
    )


@query("b22_exclusion_keeps_null", """
SELECT row_id, parent_account FROM ledger WHERE parent_account IS NULL OR parent_account NOT IN ('Customer#000000002', 'Customer#000000005')
""", "ledger")
def b22(spark, folder):
    excluded = ("Customer#000000002", "Customer#000000005")
    return tables.ledger(spark, folder).where(not_listed(F.col("parent_account"), excluded)).select("row_id", "parent_account")


@query("b23_complete_columns", """
SELECT university_name, CAST(count(DISTINCT year) AS BIGINT) AS years, round(avg(total_score), 6) AS mean_score FROM times GROUP BY 1
HAVING count(DISTINCT year) FILTER (total_score IS NOT NULL) = (SELECT count(DISTINCT year) FROM times) AND count(*) = count(total_score)
""", "times")
def b23(spark, folder):
    from tallyfield.registry.composites import times

    complete = complete_entities(times(spark, folder), "university_name", "year", "total_score")
    return rounded(complete.withColumnRenamed("mean", "mean_score"))

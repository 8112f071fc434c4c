"""Queries for the composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.dates import month_start
from tallyfield.functions.text import split_fields
from tallyfield.operators.controls import controlled_impact, donor_gram, donor_products, donor_weights, impact_points
from tallyfield.operators.fits import gompertz_fits
from tallyfield.operators.impact import align_pairs, impact_summary, regression_impact, sampled_impact, spike_periods
from tallyfield.plans import enrichment, ranking, repository, subscription
from tallyfield.plans.continued_panel import ContinuedPanel
from tallyfield.plans.crawl_state import CrawlState
from tallyfield.registry.cleaning import content_repo, rounded
from tallyfield.registry.core import query
from tallyfield.registry.views import osa_ctes
from tallyfield.session import materialised, work_path
from tallyfield.sources import tables

ASSET = "Repository"
SINCE = "1996-01-01"
FIRST_YEAR, LAST_YEAR = 1995, 2001
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-11-04"
SNAPSHOT = tables.DAILY_START
PRE_END, POST_START, POST_END = "1998-12-01", "1999-01-01", "2001-06-01"


def ledgers(spark, folder):
    rows = tables.ledger(spark, folder)
    return rows.where(F.col("kind") == "renewal"), rows.where(F.col("kind") == "cancellation")


def history(spark, folder):
    return subscription.subscription_history(*ledgers(spark, folder), ASSET, SINCE)


def times(spark, folder):
    landed = tables.payload(spark, folder).where(F.col("year") > tables.HISTORY_END)
    return ranking.load_rankings(landed, tables.rank_history(spark, folder))


def panel(spark, folder):
    return ranking.score_panel(history(spark, folder), times(spark, folder), FIRST_YEAR, LAST_YEAR)


def changes(spark, folder):
    return ranking.score_changes(panel(spark, folder), LAST_YEAR)


def daily(spark, folder):
    return repository.daily_panel(tables.uploads(spark, folder), tables.downloads_daily(spark, folder), SNAPSHOT)


def labelled(spark, folder):
    return repository.label_sizes(daily(spark, folder), SNAPSHOT)


def segments(spark, folder):
    return repository.site_segments(labelled(spark, folder))


def series(spark, folder):
    content = content_repo(spark, folder).withColumn("date", month_start(F.col("years"), F.col("months")))
    pairs = tables.sites(spark, folder).where(F.col("site_key") != 0).select(F.col("site_key").alias("test_key"), F.lit(0).cast("long").alias("control_key"))
    return align_pairs(content, pairs, "site_key", "date", "downloads")


def crawl(spark, folder):
    pages = tables.table(spark, folder, "pages")
    hosts = enrichment.listed_hosts(pages.select("page_id", split_fields(F.col("url")).alias("parts"))).select("page_id", "host")
    reason = F.when(~F.contains("html", F.lit("<title>")), F.lit("no title"))
    landed = hosts.join(pages, "page_id").select("host", reason.alias("reason"))
    return enrichment.crawl_ledger(hosts, landed)


@query("h1_subscription_history", """
SELECT * REPLACE (CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(day AS INTEGER) AS day, CAST(wday AS INTEGER) AS wday,
  CAST(onboarding_days AS INTEGER) AS onboarding_days) FROM subscription
""", "subscription")
def h1(spark, folder):
    return history(spark, folder)


_ENRICHED = f"""
WITH RECURSIVE named AS (SELECT row_id, decision, p_name AS account_name,
    CASE WHEN parent_account IS NOT NULL THEN substr(p_name, 1, 2) || substr(p_name, 4, 1) || substr(p_name, 3, 1) || substr(p_name, 5) END AS parent_account
  FROM subscription LEFT JOIN part ON p_partkey = account_id),
institutions AS (SELECT DISTINCT p_name || CASE WHEN length(p_name) % 2 = 0 THEN ' institute' ELSE '' END AS institution FROM part),
listed_sites AS (SELECT DISTINCT p_name || CASE WHEN length(p_name) % 3 = 0 THEN ' academic press' ELSE ' org' END AS site FROM part),
near AS (SELECT DISTINCT parent_account AS a, institution AS b FROM named, institutions WHERE abs(length(parent_account) - length(institution)) <= 2
  UNION SELECT DISTINCT account_name, site FROM named, listed_sites WHERE abs(length(account_name) - length(site)) <= 4),
{osa_ctes("SELECT a, b FROM near WHERE a IS NOT NULL AND levenshtein(a, b) <= 8")},
i AS (SELECT a, b, dist FROM osa JOIN institutions ON b = institution WHERE dist <= 2),
s AS (SELECT a, b, dist FROM osa JOIN listed_sites ON b = site WHERE dist <= 4)
"""


def enrichment_tables(spark, folder):
    """History with part names for accounts and swapped ones for parents, and two lists of all parts under names of their own.

    Names of some lengths carry an ending that no threshold bridges, so every scale has misses.
    """
    part = tables.table(spark, folder, "part")
    name = F.col("p_name")
    swapped = F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1), F.substring(name, 3, 1), F.substr(name, F.lit(5)))
    events = history(spark, folder)
    named = events.join(part.select("p_partkey", "p_name"), events["account_id"] == part["p_partkey"], "left").select(
        "row_id", "decision", name.alias("account_name"), F.when(F.col("parent_account").isNotNull(), swapped).alias("parent_account")
    )
    length = F.char_length(name)
    institutions = part.select(F.concat(name, F.when(length % 2 == 0, " institute").otherwise("")).alias("institution")).distinct()
    return named, institutions, part.select(F.concat(name, F.when(length % 3 == 0, " academic press").otherwise(" org")).alias("site")).distinct()


@query("h1_enriched_history", _ENRICHED + """
SELECT row_id, decision, account_name, parent_account, i.b AS institution, CAST(i.dist AS INTEGER) AS institution_diff, s.b AS site, CAST(s.dist AS INTEGER) AS site_diff
FROM named LEFT JOIN i ON i.a = parent_account LEFT JOIN s ON s.a = account_name
""", "subscription")
def h1_enriched(spark, folder):
    return enrichment.enriched_history(*enrichment_tables(spark, folder))


@query("h1_enrichment_misses", _ENRICHED + """
SELECT DISTINCT 'institution' AS kind, parent_account AS name FROM named WHERE parent_account IS NULL OR parent_account NOT IN (SELECT a FROM i)
UNION ALL SELECT DISTINCT 'site', account_name FROM named WHERE account_name IS NULL OR account_name NOT IN (SELECT a FROM s)
""", "subscription")
def h1_misses(spark, folder):
    return enrichment.enrichment_misses(*enrichment_tables(spark, folder))


@query("h2_activity_timeline", """
SELECT row_id, event_date, account_name, CAST(year(event_date) AS INTEGER) AS event_year, CAST(month(event_date) AS INTEGER) AS event_month,
  count(*) OVER (PARTITION BY kind, event_date) AS daily_count,
  count(*) OVER (PARTITION BY kind, year(event_date), month(event_date)) AS monthly_count,
  count(*) OVER (PARTITION BY kind, year(event_date)) AS yearly_count, CAST(CASE kind WHEN 'renewal' THEN 1 ELSE 0 END AS INTEGER) AS decision
FROM ledger WHERE asset_name = 'Repository'
""", "ledger")
def h2(spark, folder):
    renewals, cancellations = ledgers(spark, folder)
    return subscription.activity_timeline(renewals, ASSET, 1, ordered=False).unionByName(
        subscription.activity_timeline(cancellations, ASSET, 0, ordered=False)
    )


@query("h3_ranking_load", """
SELECT world_rank, university_name, country, round(teaching, 6) AS teaching, round(international, 6) AS international,
  round(research, 6) AS research, round(citations, 6) AS citations, round(income, 6) AS income, total_score, num_students,
  round(student_staff_ratio, 6) AS student_staff_ratio, international_students, female_male_ratio, CAST(year AS INTEGER) AS year FROM times
""", "times")
def h3(spark, folder):
    return rounded(times(spark, folder))


@query("h4_score_panel", """
SELECT name, CAST(year AS INTEGER) AS year, world_rank, total_score, decision, decision_raw, n_rows FROM panel
""", "panel")
def h4(spark, folder):
    return panel(spark, folder)


@query("h5_score_change", "SELECT increase, count(*) AS count FROM changes GROUP BY increase", "changes")
def h5(spark, folder):
    return ranking.change_signs(changes(spark, folder))


@query("h6_gainers", """
SELECT name, decision, round(avg_score, 6) AS avg_score, round(diff_after, 6) AS diff_after, increase FROM changes WHERE increase = 1 ORDER BY diff_after DESC
""", "changes")
def h6(spark, folder):
    return rounded(ranking.gainers(changes(spark, folder)))


@query("h7_donor_pool", """
WITH free AS (SELECT CAST(t.year AS INTEGER) AS year, regexp_replace(university_name, '[^0-9a-zA-Z]+', '', 'g') AS name, total_score
  FROM times t WHERE total_score IS NOT NULL AND NOT (university_name = 'Customer#000000007' AND country = 'NATION_3') AND NOT EXISTS (
    SELECT 1 FROM subscription s WHERE s.year = t.year
      AND regexp_replace(s.parent_account, '[^0-9a-zA-Z]+', '', 'g') = regexp_replace(t.university_name, '[^0-9a-zA-Z]+', '', 'g')))
SELECT year, name, total_score FROM free WHERE name IN (SELECT name FROM free GROUP BY name HAVING count(DISTINCT year) = 7)
""", "times subscription")
def h7(spark, folder):
    return ranking.donor_pool(
        times(spark, folder), history(spark, folder), FIRST_YEAR, LAST_YEAR, ("Customer#000000007", "NATION_3")
    )


@query("h8_monthly_panel", """
SELECT site_key, years, months, downloads, CAST(ttl_uploads AS BIGINT) AS ttl_uploads, CAST(cum_uploads AS BIGINT) AS cum_uploads FROM content_repo
""", "content_repo")
def h8(spark, folder):
    return content_repo(spark, folder)


@query("h8_continued_panel", """
SELECT site_key, years, months, downloads, CAST(ttl_uploads AS BIGINT) AS ttl_uploads, CAST(cum_uploads AS BIGINT) AS cum_uploads FROM content_repo
""", "content_repo")
def h8_continued(spark, folder):
    """The whole monthly panel, reached in three steps from an empty state; the second step is sent twice."""
    uploads, downloads = tables.uploads(spark, folder), tables.downloads_monthly(spark, folder)
    state = ContinuedPanel(spark, work_path(spark, "continued-panel"))
    for year, month in ((1997, 6), (2000, 2), (2000, 2), (LAST_YEAR, 12)):
        state.advance(uploads, downloads, year, month)
    return state.panel()


@query("h9_size_segments", """
SELECT site_key, date, downloads, CAST(uploads AS BIGINT) AS uploads, CAST(ttl_uploads AS BIGINT) AS ttl_uploads, repo_group FROM labelled
""", "labelled")
def h9(spark, folder):
    return labelled(spark, folder)


@query("h10_site_segments", """
SELECT 'all' AS mode, site_key, repo_group FROM segments UNION ALL
SELECT DISTINCT 'snapshot', site_key, repo_group FROM labelled WHERE date = DATE '2001-01-05'
""", "segments labelled")
def h10(spark, folder):
    rows = labelled(spark, folder)
    every = repository.site_segments(rows).withColumn("mode", F.lit("all"))
    return every.unionByName(repository.site_segments(rows, "snapshot", SNAPSHOT).withColumn("mode", F.lit("snapshot")))


@query("h11_content_by_segment", """
SELECT repo_group, make_date(years, months, 1) AS date, round(avg(cum_uploads), 6) AS average, CAST(max(month_number) AS INTEGER) AS oldest_month
FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY years, months) AS month_number FROM content_repo) JOIN segments USING (site_key)
GROUP BY 1, 2
""", "content_repo segments")
def h11(spark, folder):
    return rounded(repository.content_by_segment(content_repo(spark, folder), segments(spark, folder)))


@query("h12_daily_segment_content", "SELECT repo_group, date, round(average, 6) AS average, counts FROM spine_content", "spine_content")
def h12(spark, folder):
    return rounded(
        repository.daily_segment_content(tables.sites(spark, folder), tables.uploads(spark, folder), segments(spark, folder), FIRST_DAY, LAST_DAY)
    )


@query("h13_cumulative_downloads", """
SELECT repo_group, CAST(years AS INTEGER) AS years, CAST(months AS INTEGER) AS months, round(avg(ttl), 6) AS average, count(*) AS counts
FROM (SELECT *, sum(downloads) OVER (PARTITION BY site_key ORDER BY years, months ROWS UNBOUNDED PRECEDING) AS ttl FROM downloads_m
  WHERE site_key NOT IN (2, 5, 8, 1794, 2730)) LEFT JOIN segments USING (site_key)
WHERE years = 2001 AND months = 1 GROUP BY ALL
""", "downloads_m segments")
def h13(spark, folder):
    return rounded(repository.cumulative_downloads_by_segment(tables.downloads_monthly(spark, folder), segments(spark, folder), 2001, 1))


@query("h14_site_labels", """
SELECT site_key, CASE WHEN coalesce(bool_and(repo_group = 'low'), true) THEN 'low' WHEN coalesce(bool_and(repo_group = 'medium'), true) THEN 'medium'
  ELSE 'high' END AS repo_group
FROM (SELECT DISTINCT site_key FROM content_repo) LEFT JOIN segments USING (site_key) GROUP BY site_key
""", "content_repo segments")
def h14(spark, folder):
    return repository.site_labels(content_repo(spark, folder), segments(spark, folder))


@query("h15_upload_lists", """
SELECT 'by_uploads' AS list, site_key, CAST(min(ttl_uploads) AS BIGINT) AS least_uploads FROM content_repo GROUP BY site_key UNION ALL
SELECT 'zero', site_key, NULL FROM content_repo GROUP BY site_key HAVING bool_and(ttl_uploads = 0) UNION ALL
SELECT DISTINCT 'null', site_key, CAST(NULL AS BIGINT) FROM content_repo WHERE ttl_uploads IS NULL
""", "content_repo")
def h15(spark, folder):
    content = content_repo(spark, folder)
    blank = F.lit(None).cast("long")
    parts = [
        repository.sites_by_uploads(content, ordered=False).withColumn("list", F.lit("by_uploads")),
        repository.sites_without_uploads(content, "zero").withColumns({"list": F.lit("zero"), "least_uploads": blank}),
        repository.sites_without_uploads(content, "null").withColumns({"list": F.lit("null"), "least_uploads": blank}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("h16_metric_table", """
SELECT site_key, repo_group, make_date(years, months, 1) AS date, metrics, value
FROM (UNPIVOT (SELECT * REPLACE (CAST(downloads AS DOUBLE) AS downloads, CAST(ttl_uploads AS DOUBLE) AS ttl_uploads, CAST(cum_uploads AS DOUBLE) AS cum_uploads)
    FROM content_repo LEFT JOIN segments USING (site_key)) ON downloads, ttl_uploads, cum_uploads INTO NAME metrics VALUE value) u
WHERE make_date(years, months, 1) BETWEEN DATE '1996-03-01' AND DATE '2000-05-01'
UNION ALL
SELECT site_key, repo_group, make_date(years, months, 1), metric, NULL FROM content_repo LEFT JOIN segments USING (site_key),
  (VALUES ('downloads'), ('ttl_uploads'), ('cum_uploads')) v(metric)
WHERE CASE metric WHEN 'downloads' THEN downloads WHEN 'ttl_uploads' THEN ttl_uploads ELSE cum_uploads END IS NULL
  AND make_date(years, months, 1) BETWEEN DATE '1996-03-01' AND DATE '2000-05-01'
""", "content_repo segments")
def h16(spark, folder):
    return repository.metric_table(content_repo(spark, folder), segments(spark, folder), "1996-03-01", "2000-05-01")


@query("h17_intervention_candidates", """
SELECT site_key, years, months, downloads, CAST(ttl_uploads AS BIGINT) AS ttl_uploads, CAST(cum_uploads AS BIGINT) AS cum_uploads,
  make_date(years, months, 1) AS date, min(make_date(years, months, 1)) OVER (PARTITION BY site_key) AS first_spike
FROM content_repo WHERE ttl_uploads > 100
""", "content_repo")
def h17(spark, folder):
    return repository.intervention_candidates(content_repo(spark, folder), 100)


@query("h18_aligned_pairs", "SELECT * FROM series", "series")
def h18(spark, folder):
    return series(spark, folder)


def _impact_sql(source: str, period: str) -> str:
    """Points of the regression form; `period` gives pre_start, pre_end, post_start, post_end per pair."""
    return f"""
WITH spans AS ({period}),
timed AS (SELECT s.*, pre_end, post_start FROM {source} s JOIN spans USING (pair) WHERE s.date BETWEEN pre_start AND post_end),
fit AS (SELECT pair, regr_slope(test, control) AS slope, regr_intercept(test, control) AS intercept, regr_count(test, control) AS n_pre,
    regr_syy(test, control) AS syy, regr_sxy(test, control) AS sxy, regr_sxx(test, control) AS sxx, regr_avgx(test, control) AS mx
  FROM timed WHERE date <= pre_end GROUP BY pair),
points AS (SELECT s.pair, s.date, intercept + slope * control AS predicted, test - (intercept + slope * control) AS effect, n_pre, sxx, control - mx AS away,
    CASE WHEN n_pre > 2 THEN sqrt(greatest(syy - slope * sxy, 0) / (n_pre - 2)) END AS residual_sd
  FROM timed s LEFT JOIN fit USING (pair) WHERE date >= post_start AND test IS NOT NULL AND control IS NOT NULL)
"""


_POINTS = """
SELECT pair, date, round(predicted, 6) AS predicted, round(effect, 6) AS effect, round(residual_sd, 6) AS residual_sd, round(total, 6) AS cumulative_effect,
  round(effect - one, 6) AS effect_low, round(effect + one, 6) AS effect_high, round(total - many, 6) AS cumulative_low, round(total + many, 6) AS cumulative_high
FROM (SELECT *, 1.959963984540054 * residual_sd * sqrt(1 + 1.0 / n_pre + away * away / nullif(sxx, 0)) AS one,
    sum(effect) OVER w AS total,
    1.959963984540054 * residual_sd * sqrt(count(*) OVER w + pow(count(*) OVER w, 2) / n_pre + pow(sum(away) OVER w, 2) / nullif(sxx, 0)) AS many
  FROM points WINDOW w AS (PARTITION BY pair ORDER BY date ROWS UNBOUNDED PRECEDING))
"""
_ONE_PERIOD = "SELECT DISTINCT pair, DATE '0001-01-01' AS pre_start, DATE '1998-12-01' AS pre_end, DATE '1999-01-01' AS post_start, DATE '2001-06-01' AS post_end FROM series"
_SPIKE_PERIODS = """SELECT pair, CAST(spike - INTERVAL 36 MONTH AS DATE) AS pre_start, CAST(spike - INTERVAL 1 MONTH AS DATE) AS pre_end, spike AS post_start,
  CAST(spike + INTERVAL 12 MONTH AS DATE) AS post_end
  FROM (SELECT DISTINCT pair, test_key FROM series) JOIN (SELECT site_key, min(make_date(years, months, 1)) AS spike FROM content_repo WHERE ttl_uploads > 100 GROUP BY 1)
    ON site_key = test_key"""
_POINT_COLUMNS = ("pair", "date", "predicted", "effect", "residual_sd", "cumulative_effect", "effect_low", "effect_high", "cumulative_low", "cumulative_high")


@query("h19_regression_impact", _impact_sql("series", _ONE_PERIOD) + _POINTS, "series")
def h19_points(spark, folder):
    return rounded(regression_impact(series(spark, folder), PRE_END, POST_START, POST_END).select(*_POINT_COLUMNS))


@query("h19_spike_periods", _impact_sql("series", _SPIKE_PERIODS) + _POINTS, "series content_repo")
def h19_spikes(spark, folder):
    """Every site judged around its own first upload spike."""
    spikes = repository.intervention_candidates(content_repo(spark, folder), 100)
    own = series(spark, folder).join(spike_periods(spikes), "test_key")
    return rounded(regression_impact(own).select(*_POINT_COLUMNS))


@query("h19_impact_summary", _impact_sql("series", _ONE_PERIOD) + """
SELECT pair, n_pre, n_post, round(total / n_post, 6) AS average_effect, round(total, 6) AS cumulative_effect,
  round(total - reach, 6) AS cumulative_low, round(total + reach, 6) AS cumulative_high,
  round(total / nullif(base, 0), 6) AS relative_effect, round((total - reach) / nullif(base, 0), 6) AS relative_low, round((total + reach) / nullif(base, 0), 6) AS relative_high
FROM (SELECT pair, CAST(max(n_pre) AS BIGINT) AS n_pre, count(*) AS n_post, sum(effect) AS total, sum(predicted) AS base,
    1.959963984540054 * max(residual_sd) * sqrt(count(*) + pow(count(*), 2) / max(n_pre) + pow(sum(away), 2) / nullif(max(sxx), 0)) AS reach
  FROM points GROUP BY pair)
""", "series")
def h19_summary(spark, folder):
    return rounded(impact_summary(regression_impact(series(spark, folder), PRE_END, POST_START, POST_END)))


_DONORS = """
WITH free AS (SELECT CAST(t.year AS INTEGER) AS year, regexp_replace(university_name, '[^0-9a-zA-Z]+', '', 'g') AS name, total_score
  FROM times t WHERE total_score IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM subscription s WHERE s.year = t.year
      AND regexp_replace(s.parent_account, '[^0-9a-zA-Z]+', '', 'g') = regexp_replace(t.university_name, '[^0-9a-zA-Z]+', '', 'g'))),
donors AS (SELECT name, year, avg(total_score) AS score FROM free WHERE name IN (SELECT name FROM free GROUP BY name HAVING count(DISTINCT year) = 7) GROUP BY ALL),
control AS (SELECT year, avg(score) AS control, count(*) AS donors FROM donors GROUP BY year),
donor_pairs AS (SELECT name AS pair, make_date(year, 1, 1) AS date, test, control, donors
  FROM (SELECT regexp_replace(university_name, '[^0-9a-zA-Z]+', '', 'g') AS name, CAST(year AS INTEGER) AS year, avg(total_score) AS test
    FROM times WHERE total_score IS NOT NULL GROUP BY ALL) JOIN control USING (year) WHERE name NOT IN (SELECT name FROM donors))
"""


def ranking_pairs(spark, folder):
    scores, events = materialised(times(spark, folder), "times"), history(spark, folder)
    return ranking.donor_pairs(scores, ranking.donor_pool(scores, events, FIRST_YEAR, LAST_YEAR))


@query("h18_donor_pairs", _DONORS + "SELECT pair, date, round(test, 6) AS test, round(control, 6) AS control, donors FROM donor_pairs", "times subscription")
def h18_donors(spark, folder):
    return rounded(ranking_pairs(spark, folder))


@query("h19_ranking_impact", _DONORS + "," + _impact_sql("donor_pairs", """
  SELECT regexp_replace(parent_account, '[^0-9a-zA-Z]+', '', 'g') AS pair, DATE '0001-01-01' AS pre_start, make_date(CAST(min(year) AS INTEGER) - 1, 1, 1) AS pre_end,
    make_date(CAST(min(year) AS INTEGER), 1, 1) AS post_start, DATE '9999-01-01' AS post_end
  FROM subscription WHERE decision = 1 AND year IS NOT NULL AND parent_account IS NOT NULL GROUP BY 1""").strip().removeprefix("WITH") + _POINTS, "times subscription")
def h19_ranking(spark, folder):
    """Yearly scores of subscribers against the mean of all complete donors, from their first renewal on."""
    own = ranking_pairs(spark, folder).join(ranking.subscription_periods(history(spark, folder)), "pair")
    return rounded(regression_impact(own).select(*_POINT_COLUMNS))


def ranking_controls(spark, folder):
    """Yearly scores of subscribers with their periods, and the yearly scores of every complete donor."""
    scores, events = materialised(times(spark, folder), "times"), history(spark, folder)
    pool = materialised(ranking.donor_pool(scores, events, FIRST_YEAR, LAST_YEAR), "pool")
    tests = ranking.donor_pairs(scores, pool).select("pair", "date", "test").join(ranking.subscription_periods(events), "pair")
    return tests, ranking.donor_series(pool)


@query("h19_donor_gram", _DONORS + """
SELECT a.name AS donor_a, b.name AS donor_b, count(*) AS n, round(regr_sxy(a.score, b.score), 6) AS sxy
FROM donors a JOIN donors b ON a.year = b.year AND a.name <= b.name GROUP BY ALL
""", "times subscription")
def h19_gram(spark, folder):
    """Centred products of every two complete donors."""
    return rounded(donor_gram(ranking_controls(spark, folder)[1]))


@query("h19_donor_products", _DONORS + """,
spans AS (SELECT regexp_replace(parent_account, '[^0-9a-zA-Z]+', '', 'g') AS pair, make_date(CAST(min(year) AS INTEGER) - 1, 1, 1) AS pre_end
  FROM subscription WHERE decision = 1 AND year IS NOT NULL AND parent_account IS NOT NULL GROUP BY 1)
SELECT pair, d.name AS donor, count(*) AS n, round(regr_sxy(test, score), 6) AS sxy
FROM donor_pairs p JOIN spans USING (pair) JOIN donors d ON make_date(d.year, 1, 1) = p.date WHERE p.date <= pre_end GROUP BY ALL
""", "times subscription")
def h19_products(spark, folder):
    """Centred products of every subscriber's scores before its first renewal with every complete donor's."""
    return rounded(donor_products(*ranking_controls(spark, folder)))


@query("h19_donor_weights")
def h19_weights(spark, folder):
    """Which donors speak for a subscriber's scores, and how much: one row per subscriber and donor."""
    return donor_weights(controlled_impact(*ranking_controls(spark, folder), draws=400, burn=100))


@query("h19_controlled_points")
def h19_controlled(spark, folder):
    """Scores of subscribers, year by year, against what all donors together predict."""
    return impact_points(controlled_impact(*ranking_controls(spark, folder), draws=400, burn=100))


@query("h19_planted_donors", """
WITH months AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-06-01', INTERVAL 1 MONTH)) AS DATE) AS date),
panel AS (SELECT site_key, date, coalesce(sum(downloads), 0) AS value FROM (SELECT DISTINCT site_key FROM downloads_m) CROSS JOIN months
  LEFT JOIN (SELECT site_key, make_date(years, months, 1) AS date, downloads FROM downloads_m) USING (site_key, date) GROUP BY ALL),
varied AS (SELECT site_key FROM panel WHERE date <= DATE '2000-12-01' GROUP BY site_key HAVING max(value) > min(value))
SELECT CAST(site_key AS VARCHAR) AS pair, CAST(unnest([site_key, site_key + 1]) AS VARCHAR) AS donor
FROM varied WHERE site_key + 1 IN (SELECT site_key FROM varied)
""", "downloads_m")
def h19_planted(spark, folder):
    """Series mixed from two sites' downloads each, with all sites as donors: exactly these two have to be found."""
    months = F.expr("explode(sequence(DATE '1995-01-01', DATE '2001-06-01', INTERVAL 1 MONTH))")
    known = tables.downloads_monthly(spark, folder).select("site_key", month_start(F.col("years"), F.col("months")).alias("date"), "downloads")
    spine = known.select("site_key").distinct().withColumn("date", months)
    panel = spine.join(known, ["site_key", "date"], "left").groupBy("site_key", "date").agg(F.coalesce(F.sum("downloads"), F.lit(0)).alias("value"))
    panel = materialised(panel, "panel")
    pool = panel.select(F.col("site_key").cast("string").alias("donor"), "date", "value")
    spans = panel.where("date <= DATE '2000-12-01'").groupBy("site_key").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    varied = spans.where("high > low").select("site_key")
    first = panel.join(varied, "site_key")
    second = first.select((F.col("site_key") - 1).alias("site_key"), "date", F.col("value").alias("other"))
    mixed = first.join(second, ["site_key", "date"]).select(F.col("site_key").cast("string").alias("pair"), "date", (2 * F.col("value") - F.col("other") + 30).alias("test"))
    found = donor_weights(controlled_impact(mixed, pool, "2000-12-01", "2001-01-01", "2001-06-01", draws=100, burn=50, least=0.5))
    return found.where("inclusion > 0.5").select("pair", "donor")


@query("h19_sampled_impact")
def h19_sampled(spark, folder):
    return sampled_impact(series(spark, folder), PRE_END, POST_START, POST_END)


@query("h19_sampled_status", """
WITH known AS (SELECT * FROM series WHERE test IS NOT NULL AND control IS NOT NULL AND date <= DATE '2001-06-01')
SELECT pair, CASE WHEN n_pre < 4 OR n_post < 1 OR coalesce(sd, 0) = 0 THEN 'too few points or constant series' ELSE 'ok' END AS status, n_pre, n_post
FROM (SELECT pair, CAST(count(*) FILTER (date <= DATE '1998-12-01') AS INTEGER) AS n_pre, CAST(count(*) FILTER (date >= DATE '1999-01-01') AS INTEGER) AS n_post,
    stddev_samp(test) FILTER (date <= DATE '1998-12-01') AS sd FROM series s SEMI JOIN known k ON s.pair = k.pair
    WHERE test IS NOT NULL AND control IS NOT NULL AND date <= DATE '2001-06-01' GROUP BY pair)
""", "series")
def h19_status(spark, folder):
    """The parts of the sampled form that rules decide."""
    known = series(spark, folder).where(F.col("test").isNotNull() & F.col("control").isNotNull())
    return sampled_impact(known, PRE_END, POST_START, POST_END).select("pair", "status", "n_pre", "n_post")


@query("h20_gompertz_recovery", """
SELECT site_key, CAST(100 + site_key AS DOUBLE) AS asym, CAST(2 + site_key % 3 AS DOUBLE) AS b2, CAST(3 + site_key % 4 AS DOUBLE) AS rate
FROM content_repo WHERE cum_uploads IS NOT NULL GROUP BY site_key HAVING count(DISTINCT cum_uploads) >= 8 AND max(cum_uploads) >= 5 * min(cum_uploads)
""", "content_repo")
def h20_recovery(spark, folder):
    """Exact curves over the real panels, their parameters following from the site's key: the fit has to find them."""
    key, x = F.col("site_key"), F.col("cum_uploads").cast("double")
    rows = content_repo(spark, folder).where(x.isNotNull()).select("site_key", x.alias("cum_uploads"))
    extent = rows.groupBy("site_key").agg(F.max("cum_uploads").alias("most"), F.min("cum_uploads").alias("least"), F.count_distinct("cum_uploads").alias("n"))
    extent = extent.where((F.col("n") >= 8) & (F.col("most") >= 5 * F.col("least"))).select("site_key", "most")
    exact = (100 + key) * F.exp(-(2 + key % 3) * F.exp(-(3 + key % 4) * F.col("cum_uploads") / F.col("most")))
    fits = gompertz_fits(rows.join(extent, "site_key").withColumn("downloads", exact)).join(extent, "site_key")
    of = lambda term: F.max(F.when(F.col("term") == term, F.col("estimate")))
    found = fits.groupBy("site_key", "most").agg(of("Asym").alias("asym"), of("b2").alias("b2"), of("b3").alias("b3"))
    return found.select(
        "site_key", F.round("asym", 2).alias("asym"), F.round("b2", 3).alias("b2"), F.round(-F.log("b3") * F.col("most"), 3).alias("rate")
    )


@query("h20_fit_status", """
SELECT site_key, CAST(count(downloads) FILTER (cum_uploads IS NOT NULL) AS INTEGER) AS n,
  CASE WHEN count(downloads) FILTER (cum_uploads IS NOT NULL) < 4 OR count(DISTINCT cum_uploads) FILTER (downloads IS NOT NULL) < 4 THEN 'too few distinct points'
    WHEN max(downloads) FILTER (cum_uploads IS NOT NULL) = min(downloads) FILTER (cum_uploads IS NOT NULL) THEN 'constant response' ELSE 'fitted or not' END AS rule
FROM content_repo GROUP BY site_key
""", "content_repo")
def h20_status(spark, folder):
    """Number of points per site and the failures that a rule states."""
    message = F.col("message")
    stated = F.when(message.isin("too few distinct points", "constant response"), message).otherwise("fitted or not")
    return gompertz_fits(content_repo(spark, folder)).select("site_key", "n", stated.alias("rule")).distinct()


@query("h20_gompertz_fits")
def h20(spark, folder):
    return gompertz_fits(content_repo(spark, folder), excluded=repository.EXCLUDED_SITES)


@query("h21_usage_ratio", """
SELECT site_key, CAST(cum_uploads AS BIGINT) AS cum_uploads, CAST(ttl AS BIGINT) AS ttl_downloads, round(ttl / nullif(cum_uploads, 0), 6) AS ratio, institution_name, site_url
FROM (SELECT *, sum(coalesce(downloads, 0)) OVER (PARTITION BY site_key ORDER BY years, months ROWS UNBOUNDED PRECEDING) AS ttl FROM content_repo)
LEFT JOIN sites USING (site_key) WHERE years = 2001 AND months = 3
""", "content_repo sites")
def h21(spark, folder):
    return rounded(repository.usage_ratio(content_repo(spark, folder), tables.sites(spark, folder), 2001, 3))


@query("h22_crawl_ledger", """
WITH landed AS (SELECT host, bool_or(html LIKE '%<title>%') AS done FROM hosts JOIN pages USING (page_id) GROUP BY host)
SELECT page_id, host, CASE WHEN done THEN 'success' ELSE 'try' END AS status, CASE WHEN NOT done THEN 'no title' END AS reason,
  'https://search.google.com/u/1/search-console/index?resource_id=https%3A%2F%2F' || host || '%2F' AS resource_url
FROM hosts JOIN landed USING (host)
""", "hosts")
def h22(spark, folder):
    return crawl(spark, folder)


@query("h22_crawl_rounds", """
WITH rounds AS (SELECT host, html LIKE '%<title>%' AS titled, length(html) AS size FROM hosts JOIN pages USING (page_id)),
done AS (SELECT host, bool_or(titled AND size % 2 = 0) AS first, bool_or(titled AND size % 3 = 0) AS second, bool_or(titled) AS third FROM rounds GROUP BY host)
SELECT host, CASE WHEN first OR second OR third THEN 'success' ELSE 'try' END AS status, CAST(CASE WHEN first THEN 1 WHEN second THEN 2 ELSE 3 END AS BIGINT) AS tries,
  CASE WHEN NOT (first OR second OR third) THEN 'no luck in round 3' END AS reason, 1::BIGINT AS first_run,
  CAST(CASE WHEN first THEN 1 WHEN second THEN 2 ELSE 3 END AS BIGINT) AS last_run
FROM done
""", "hosts")
def h22_rounds(spark, folder):
    """Three rounds over the listed hosts, each at those still open; later rounds accept more pages. The second is sent twice."""
    pages = tables.table(spark, folder, "pages")
    hosts = enrichment.listed_hosts(pages.select("page_id", split_fields(F.col("url")).alias("parts"))).select("page_id", "host")
    landed = hosts.join(pages.select("page_id", "html"), "page_id")
    titled, size = F.contains("html", F.lit("<title>")), F.char_length("html")
    state = CrawlState(spark, work_path(spark, "crawl"))
    for run, accepted in ((1, titled & (size % 2 == 0)), (2, titled & (size % 3 == 0)), (2, titled), (3, titled)):
        tried = landed.join(state.open_hosts(hosts), "host", "left_semi")
        state.record(run, tried.select("host", F.when(~F.coalesce(accepted, F.lit(False)), F.lit(f"no luck in round {run}")).alias("reason")))
    return state.current()

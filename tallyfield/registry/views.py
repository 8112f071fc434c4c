"""SQL views for the checks: name -> (views it uses, body). They restate the logical tables independently of Spark."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, uses: str, body: str) -> None:
    VIEWS[name] = (tuple(uses.split()), body)


_view("ledger", "", """
SELECT o.o_orderkey AS row_id, o.o_custkey AS account_id, c.c_name AS account_name,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN c.c_name || ' System'
    WHEN '3-MEDIUM' THEN c.c_name || ' Consortium' WHEN '4-NOT SPECIFIED' THEN c.c_name || ' Consortium West'
    ELSE c.c_name END AS parent_account,
  CASE WHEN c.c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Course Platform' ELSE 'Repository' END AS asset_name,
  c.c_nationkey AS carnegie, n.n_name AS billing_country, CAST(floor(c.c_acctbal) AS BIGINT) AS employees,
  c.c_mktsegment AS industry, o.o_orderpriority AS order_type,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL
    ELSE CAST(o.o_orderdate AS DATE) - CAST(o.o_orderkey % 45 AS INTEGER) END AS purchase_date,
  CAST(o.o_orderdate AS DATE) AS usage_start_date, l.event_date, o.o_totalprice AS price,
  CASE o.o_orderstatus WHEN 'P' THEN 'cancellation' ELSE 'renewal' END AS kind
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS event_date FROM lineitem GROUP BY l_orderkey) l
  ON l.l_orderkey = o.o_orderkey
""")

_view("cleaned", "ledger", r"""
SELECT * REPLACE (
  coalesce(CASE WHEN kind = 'cancellation'
    THEN nullif(regexp_replace(parent_account, '(.+System$)|(.+Consortium$)', ''), '')
    ELSE nullif(regexp_replace(parent_account, '(.+System$)|(.+Consortium)', ''), '') END, account_name) AS parent_account,
  coalesce(purchase_date, usage_start_date) AS purchase_date)
FROM ledger
""")

_view("subscription", "cleaned", """
SELECT row_id, account_id, account_name, parent_account, carnegie, billing_country, employees, industry, order_type,
  year(event_date) AS year, month(event_date) AS month, day(event_date) AS day, dayofweek(event_date) + 1 AS wday,
  usage_start_date, usage_start_date - purchase_date AS onboarding_days,
  CASE WHEN count(*) OVER w = count(event_date) OVER w
    THEN CAST(sum(event_date - usage_start_date) OVER w AS BIGINT) END AS usage_days, price, 1 AS decision
FROM cleaned WHERE asset_name = 'Repository' AND kind = 'renewal'
WINDOW w AS (PARTITION BY account_id ORDER BY usage_start_date NULLS LAST, row_id ROWS UNBOUNDED PRECEDING)
UNION ALL
SELECT row_id, account_id, account_name, parent_account, carnegie, billing_country, employees, industry, order_type,
  year(event_date), month(event_date), day(event_date), dayofweek(event_date) + 1,
  usage_start_date, usage_start_date - purchase_date, CAST(event_date - usage_start_date AS BIGINT), price, 0
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, parent_account ORDER BY usage_start_date NULLS LAST, row_id) AS rn
      FROM cleaned WHERE asset_name = 'Repository' AND kind = 'cancellation' AND event_date > DATE '1996-01-01')
WHERE rn = 1
""")

_view("rank_source", "", """
SELECT c.c_custkey AS entry_id, c.c_name AS name, n.n_name AS location, CAST(year(o.o_orderdate) AS INTEGER) AS year, count(*) AS cnt,
  CAST(floor(avg(o.o_totalprice) / 10000) AS BIGINT) AS score
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY c.c_custkey, c.c_name, n.n_name, year(o.o_orderdate)
""")

_view("payload", "rank_source", """
SELECT entry_id, name, location, year, CAST(cnt * 10 AS VARCHAR) AS rank_order,
  CASE WHEN score % 7 = 0 THEN '-' WHEN score % 3 = 0 THEN score || '—' || (score + 5) ELSE score || '.5' END AS scores_overall,
  (cnt + 10) || '.' || (score % 10) AS scores_teaching,
  (score + 11) || '.' || (cnt % 10) AS scores_international_outlook,
  (score + 12) || '.' || (cnt % 10) AS scores_research,
  (score + 13) || '.' || (cnt % 10) AS scores_citations,
  (score + 14) || '.' || (cnt % 10) AS scores_industry_income,
  (score + 1) || ',' || lpad(CAST(cnt * 7 % 1000 AS VARCHAR), 3, '0') AS stats_number_students,
  (cnt + 9) || '.' || (score % 10) AS stats_student_staff_ratio,
  CASE WHEN score % 23 = 0 THEN '%' ELSE score || '%' END AS stats_pc_intl_students,
  (cnt + 40) || ' : ' || (60 - cnt) AS stats_female_male_ratio
FROM rank_source
""")

# What the texts above stand for, written out as numbers.
_view("times", "rank_source", """
SELECT CAST(cnt AS DOUBLE) AS world_rank, name AS university_name, location AS country,
  (cnt + 10) + (score % 10) / 10 AS teaching, (score + 11) + (cnt % 10) / 10 AS international,
  (score + 12) + (cnt % 10) / 10 AS research, (score + 13) + (cnt % 10) / 10 AS citations,
  (score + 14) + (cnt % 10) / 10 AS income,
  CASE WHEN score % 7 = 0 THEN NULL WHEN year <= 1998 THEN CAST(score AS DOUBLE)
    WHEN score % 3 = 0 THEN score + 2.5 ELSE score + 0.5 END AS total_score,
  CAST((score + 1) * 1000 + cnt * 7 % 1000 AS DOUBLE) AS num_students, (cnt + 9) + (score % 10) / 10 AS student_staff_ratio,
  CASE WHEN year > 1998 AND score % 23 = 0 THEN 0.0 ELSE CAST(score AS DOUBLE) END AS international_students,
  (cnt + 40) || ' : ' || (60 - cnt) AS female_male_ratio, year
FROM rank_source
""")

_view("uploads", "", """
SELECT l_suppkey AS site_key, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS uploads
FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL
""")
_view("downloads_m", "", """
SELECT l_suppkey AS site_key, CAST(year(l_shipdate) AS INTEGER) AS years, CAST(month(l_shipdate) AS INTEGER) AS months, CAST(sum(l_quantity) AS BIGINT) AS downloads
FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL
""")
_view("downloads_d", "", """
SELECT l_suppkey AS site_key, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS downloads
FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL
""")
_view("sites", "", """
SELECT s_suppkey AS site_key, s_name AS institution_name,
  'http://' || replace(lower(s_name), '#', '-') || '.example.org/' AS site_url FROM supplier
""")

_view("monthly", "uploads", """
SELECT *, CAST(sum(ttl_uploads) OVER (PARTITION BY site_key ORDER BY years, months ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_uploads
FROM (SELECT site_key, CAST(year(date) AS INTEGER) AS years, CAST(month(date) AS INTEGER) AS months, CAST(sum(uploads) AS BIGINT) AS ttl_uploads FROM uploads GROUP BY ALL)
""")
_view("content", "downloads_m monthly", """
SELECT site_key, years, months, downloads, coalesce(ttl_uploads, 0) AS ttl_uploads, cum_uploads
FROM downloads_m FULL JOIN monthly USING (site_key, years, months)
""")
_REPAIR = """
SELECT {keys}, {value}, {inc},
  coalesce(t3, last_value(t3 IGNORE NULLS) OVER (PARTITION BY site_key ORDER BY {order} ROWS UNBOUNDED PRECEDING)) AS {total}
FROM (SELECT *, coalesce(t2, lag(t2) OVER (PARTITION BY site_key ORDER BY {order}) + {inc}) AS t3
  FROM (SELECT *, coalesce(t1, first_value(t1 IGNORE NULLS) OVER (PARTITION BY site_key ORDER BY {order}
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t2
    FROM (SELECT *, coalesce({total}, lead({total}) OVER (PARTITION BY site_key ORDER BY {order})
        - lead({inc}) OVER (PARTITION BY site_key ORDER BY {order})) AS t1
      FROM {source})))
"""
_view("repaired", "content", _REPAIR.format(
    keys="site_key, years, months", value="downloads", inc="ttl_uploads", total="cum_uploads",
    order="years, months", source="content"))
_view("content_repo", "repaired", "SELECT * FROM repaired WHERE site_key NOT IN (2, 5, 8, 1794, 2730)")
_view("daily_content", "uploads downloads_d", """
SELECT d.site_key, d.date, d.downloads, coalesce(u.uploads, 0) AS uploads, u.ttl_uploads
FROM (SELECT * FROM downloads_d WHERE date >= DATE '2001-01-05') d LEFT JOIN (
  SELECT * FROM (SELECT *, sum(uploads) OVER (PARTITION BY site_key ORDER BY date ROWS UNBOUNDED PRECEDING) AS ttl_uploads
    FROM uploads WHERE site_key <> 2) WHERE date >= DATE '2001-01-05') u
  ON u.site_key = d.site_key AND u.date = d.date
""")
_view("daily_repo", "daily_content", _REPAIR.format(
    keys="site_key, date", value="downloads", inc="uploads", total="ttl_uploads", order="date", source="daily_content"))
_view("cuts", "daily_repo", """
SELECT quantile_cont(ttl_uploads, 0.0) AS q00, quantile_cont(ttl_uploads, 0.25) AS q25, quantile_cont(ttl_uploads, 0.5) AS q50,
  quantile_cont(ttl_uploads, 0.75) AS q75, quantile_cont(ttl_uploads, 1.0) AS q100
FROM daily_repo WHERE date = DATE '2001-01-05'
""")
_view("labelled", "daily_repo cuts", """
SELECT d.*, CASE WHEN ttl_uploads <= q25 THEN 'low' WHEN ttl_uploads >= q75 THEN 'high' ELSE 'medium' END AS repo_group
FROM daily_repo d, cuts WHERE ttl_uploads IS NOT NULL
""")
_view("segments", "labelled", "SELECT DISTINCT site_key, repo_group FROM labelled")
_view("spine_content", "sites uploads segments", """
SELECT g.repo_group, t.date, avg(t.ttl_uploads) AS average, count(*) AS counts
FROM (SELECT s.site_key, d.date,
    sum(coalesce(u.uploads, 0)) OVER (PARTITION BY s.site_key ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS ttl_uploads
  FROM sites s CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-11-04', INTERVAL 1 DAY)) AS DATE) AS date) d
  LEFT JOIN uploads u ON u.site_key = s.site_key AND u.date = d.date WHERE s.site_key <> 2) t
JOIN segments g ON g.site_key = t.site_key GROUP BY ALL
""")

_view("panel", "subscription times", """
SELECT name, year, world_rank, total_score, coalesce(decision, 0) AS decision, decision AS decision_raw, count(*) AS n_rows
FROM (
  SELECT name, year, decision,
    coalesce(world_rank, last_value(rank_hi IGNORE NULLS) OVER b, first_value(rank_lo IGNORE NULLS) OVER f) AS world_rank,
    coalesce(total_score, last_value(score_hi IGNORE NULLS) OVER b, first_value(score_lo IGNORE NULLS) OVER f) AS total_score
  FROM (
    SELECT s.name, s.year, u.decision, t.world_rank, t.total_score,
      max(t.world_rank) OVER y AS rank_hi, min(t.world_rank) OVER y AS rank_lo,
      max(t.total_score) OVER y AS score_hi, min(t.total_score) OVER y AS score_lo,
      count(t.world_rank) OVER (PARTITION BY s.name) AS ranked
    FROM (SELECT regexp_replace(parent_account, '[^0-9a-zA-Z]+', '', 'g') AS name, r.year
          FROM (SELECT DISTINCT parent_account FROM subscription) p CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) r) s
    LEFT JOIN (SELECT regexp_replace(parent_account, '[^0-9a-zA-Z]+', '', 'g') AS name, year, decision FROM subscription) u
      ON u.name = s.name AND u.year = s.year
    LEFT JOIN (SELECT regexp_replace(university_name, '[^0-9a-zA-Z]+', '', 'g') AS name, year, world_rank, total_score FROM times) t
      ON t.name = s.name AND t.year = s.year
    WINDOW y AS (PARTITION BY s.name, s.year))
  WHERE ranked > 0
  WINDOW b AS (PARTITION BY name ORDER BY year RANGE UNBOUNDED PRECEDING),
    f AS (PARTITION BY name ORDER BY year RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
GROUP BY ALL
""")
_view("changes", "panel", """
SELECT name, decision, avg_score, diff_after, CAST(sign(diff_after) AS INTEGER) AS increase
FROM (SELECT *, avg_score - lag(avg_score) OVER (PARTITION BY name ORDER BY decision) AS diff_after
  FROM (SELECT name, decision, CASE WHEN count(*) = count(total_score) THEN sum(total_score * n_rows) / sum(n_rows) END AS avg_score
    FROM panel WHERE year <> 2001 GROUP BY name, decision))
WHERE diff_after IS NOT NULL
""")
_view("series", "content_repo", """
SELECT t.site_key || '~' || c.site_key AS pair, t.site_key AS test_key, c.site_key AS control_key,
  make_date(t.years, t.months, 1) AS date, t.downloads AS test, c.downloads AS control
FROM content_repo t JOIN content_repo c ON c.site_key = 0 AND t.site_key <> 0 AND t.years = c.years AND t.months = c.months
""")
_view("hosts", "", """
SELECT page_id, url, unnest(regexp_extract_all(trim(split_part(trim(url, ','), ',', 1)), 'http://(.*?)/', 1)) AS host FROM pages
""")
_view("site_names", "", """
SELECT page_id, regexp_replace(url, '^https?://', '') AS name, url LIKE 'https%' AS secure FROM pages
""")
_view("pairs", "site_names", """
SELECT l.name AS a, r.name AS b FROM site_names l JOIN site_names r ON r.page_id = l.page_id + 1
UNION SELECT l.p_name, r.p_name FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1
""")


def osa_ctes(pairs: str) -> str:
    """Swap-aware edit distance of the (a, b) pairs by a recursive table: one row of edit costs per step."""
    return _table_ctes(
        pairs,
        "osa",
        "CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END",
        "CASE WHEN i > 0 AND j > 1 AND a[i + 1] = b[j - 1] AND a[i] = b[j] THEN above[j - 1] + 1 ELSE 1000000 END",
    )


def lcs_ctes(pairs: str) -> str:
    return _table_ctes(pairs, "lcs", "CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 2 END", "1000000")


def _table_ctes(pairs: str, name: str, cost: str, swap: str) -> str:
    return f"""
{name}_pairs AS ({pairs}),
{name}_table AS (
  SELECT a, b, 0 AS i, CAST([] AS BIGINT[]) AS above, range(0, length(b) + 1) AS line FROM {name}_pairs
  UNION ALL
  SELECT a, b, i + 1, line, list_transform(range(0, length(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda t: best[t + 1] + j - t)))
  FROM (SELECT *, list_concat([i + 1], list_transform(range(1, length(b) + 1), lambda j:
      least(line[j + 1] + 1, line[j] + {cost}, {swap}))) AS best FROM {name}_table WHERE i < length(a))
),
{name} AS (SELECT a, b, line[length(b) + 1] AS dist FROM {name}_table WHERE i = length(a))"""

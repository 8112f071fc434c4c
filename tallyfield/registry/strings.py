"""Queries for the string-distance battery over a table of candidate pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import distances as d
from tallyfield.registry.cleaning import rounded
from tallyfield.registry.core import query
from tallyfield.registry.views import lcs_ctes, osa_ctes
from tallyfield.sources import tables


def candidate_pairs(spark, folder):
    """Every site name and every part name with the one of the next key: whole tables, mostly unlike pairs."""
    sites = tables.table(spark, folder, "pages").select(F.col("page_id").alias("key"), F.regexp_replace("url", "^https?://", "").alias("name"))
    parts = tables.table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    both = []
    for named in (sites, parts):
        follows = named.select((F.col("key") - 1).alias("key"), F.col("name").alias("b"))
        both.append(named.join(follows, "key").select(F.col("name").alias("a"), "b"))
    return both[0].union(both[1]).distinct()


_CHARS = """
chars AS (SELECT a, b, ch, count(*) FILTER (side = 0) AS m, count(*) FILTER (side = 1) AS n FROM (
  SELECT a, b, unnest(string_split(a, '')) AS ch, 0 AS side FROM pairs UNION ALL
  SELECT a, b, unnest(string_split(b, '')), 1 FROM pairs) GROUP BY ALL)
"""


def _metric(name, sql, build):
    @query(name, sql, "pairs")
    def run(spark, folder):
        return rounded(candidate_pairs(spark, folder).withColumn("dist", build(F.col("a"), F.col("b"))))

    return run


_metric("k1_osa", f"WITH RECURSIVE {osa_ctes('SELECT a, b FROM pairs')} SELECT a, b, CAST(dist AS INTEGER) AS dist FROM osa", d.osa)
_metric("k2_levenshtein", "SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS dist FROM pairs", F.levenshtein)
_metric("k3_damerau", "SELECT a, b, CAST(damerau_levenshtein(a, b) AS INTEGER) AS dist FROM pairs", d.damerau)
_metric("k4_hamming", """
SELECT a, b, CASE WHEN length(a) = length(b) THEN CAST(hamming(x, y) AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END AS dist
FROM (SELECT a, b, rpad(a, CAST(greatest(length(a), length(b)) AS INTEGER), ' ') AS x, rpad(b, CAST(greatest(length(a), length(b)) AS INTEGER), ' ') AS y FROM pairs)
""", d.hamming)
_metric("k5_lcs", f"WITH RECURSIVE {lcs_ctes('SELECT a, b FROM pairs')} SELECT a, b, CAST(dist AS INTEGER) AS dist FROM lcs", d.lcs)
_metric("k6_qgram", f"WITH {_CHARS} SELECT a, b, CAST(sum(abs(m - n)) AS INTEGER) AS dist FROM chars GROUP BY a, b", d.qgram)
_metric("k7_cosine", f"""
WITH {_CHARS} SELECT a, b, round(CASE WHEN a = b THEN 0 ELSE 1 - sum(m * n) / (sqrt(sum(m * m)) * sqrt(sum(n * n))) END, 6) + 0.0 AS dist FROM chars GROUP BY a, b
""", d.cosine)
_metric("k8_jaccard", f"""
WITH {_CHARS} SELECT a, b, round(1 - count(*) FILTER (m > 0 AND n > 0) / count(*), 6) AS dist FROM chars GROUP BY a, b
""", d.jaccard)
_metric("k9_jaro", "SELECT a, b, round(1 - jaro_similarity(a, b), 6) AS dist FROM pairs", d.jaro)


def _soundex_sql(text: str) -> str:
    """Letter classes, neighbours of one class taken together, vowels dropped, padded to three."""
    codes = f"translate(regexp_replace(upper({text}), '[^A-Z]', '0', 'g'), 'AEIOUYBFPVCGJKQSXZDTLMNRHW', '00000011112222222233455677')"
    line = f"({codes})[1] || replace(({codes})[2:], '7', '')"
    for digit in range(7):
        line = f"regexp_replace({line}, '{digit}+', '{digit}', 'g')"
    return f"upper({text}[1]) || (replace(({line})[2:], '0', '') || '000')[1:3]"


_metric("k10_soundex", f"SELECT a, b, CAST({_soundex_sql('a')} <> {_soundex_sql('b')} AS INTEGER) AS dist FROM pairs", d.soundex_differs)


_REPORT = f"""
WITH RECURSIVE {osa_ctes('SELECT a, b FROM pairs')}, {lcs_ctes('SELECT a, b FROM pairs')}, {_CHARS},
counts AS (SELECT a, b, CAST(sum(abs(m - n)) AS INTEGER) AS qgram,
    CASE WHEN a = b THEN 0 ELSE 1 - sum(m * n) / (sqrt(sum(m * m)) * sqrt(sum(n * n))) END AS cosine,
    1 - count(*) FILTER (m > 0 AND n > 0) / count(*) AS jaccard FROM chars GROUP BY a, b),
padded AS (SELECT a, b, rpad(a, CAST(greatest(length(a), length(b)) AS INTEGER), ' ') AS x, rpad(b, CAST(greatest(length(a), length(b)) AS INTEGER), ' ') AS y FROM pairs)
SELECT a, b, CAST(osa.dist AS INTEGER) AS osa, CAST(levenshtein(a, b) AS INTEGER) AS lv, CAST(damerau_levenshtein(a, b) AS INTEGER) AS dl,
  CASE WHEN length(a) = length(b) THEN CAST(hamming(x, y) AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END AS hamming,
  CAST(lcs.dist AS INTEGER) AS lcs, qgram, round(cosine, 6) + 0.0 AS cosine, round(jaccard, 6) AS jaccard,
  round(1 - jaro_similarity(a, b), 6) AS jw, CAST({_soundex_sql('a')} <> {_soundex_sql('b')} AS INTEGER) AS soundex
FROM osa JOIN lcs USING (a, b) JOIN counts USING (a, b) JOIN padded USING (a, b)
"""


@query("k0_distance_report", _REPORT, "pairs")
def k0(spark, folder):
    """All ten metrics of every candidate pair."""
    return rounded(candidate_pairs(spark, folder).select("a", "b", *d.distance_columns(F.col("a"), F.col("b"))))

"""URL filters: pattern rules indexed by their rarest literal token.

The index is an array of hash buckets that travels with the plan as a literal. A row looks its own URL tokens up in it,
one bucket per distinct token, and runs the regular expressions of the rules found there and no others. The scan is one
map stage without a shuffle; before it, one small count tells how often each token of the rules occurs in the table, so
that rules wait under their rarest token. Rules are a parameter: at most `MAX_RULES`, which bounds the index.

Defined cases: a missing URL, or one without `://`, has an empty host and path, meets no rule and gets the default
verdict; a missing page_id stays missing; repeated rows and repeated URLs are judged one by one, so a host with a third
of all rows costs nothing extra; other columns never take part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = "struct<token:string,rule:string,verdict:string,pattern:string,named:boolean>"


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over `host + path` (named rules) or the whole lower-cased URL (patterns).

    `tokens` are runs of a-z and 0-9 that stand as whole tokens in every URL the expression matches; one at an open end of
    the expression is none of them, as letters may follow it.
    """

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    named: bool


def site_rule(rule: str, verdict: str) -> UrlRule:
    """`host/path` rule: fits the host and its subdomains if the path starts with the rule's."""
    host, slash, rest = rule.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + rest)}"
    whole = re.split("[^a-z0-9]+", host) + re.split("[^a-z0-9]+", rest.lower())[:-1]
    return UrlRule(rule, verdict, pattern, tuple(dict.fromkeys(t for t in whole if t)), True)


def pattern_rule(pattern: str, *tokens: str, verdict: str = "block") -> UrlRule:
    return UrlRule(pattern, verdict, pattern, tokens, False)


# Rules by host and path that the query has to follow.
SITE_RULES = (
    site_rule("org/", "allow"),
    site_rule("example.org/es/", "block"),
    site_rule("example.org/en/1", "block"),
    site_rule("com/fr/", "allow"),
    site_rule("com/de/", "block"),
)

# Addresses of spam, gambling, advertising, tracking and account pages.
PATTERN_RULES = (
    pattern_rule(r"//(?:[^/?#]*\.)?cheap-pills\.", "cheap", "pills"),
    pattern_rule(r"//(?:[^/?#]*\.)?casino-win\.", "casino", "win"),
    pattern_rule(r"//(?:[^/?#]*\.)?free-bets\.", "free", "bets"),
    pattern_rule(r"//(?:[^/?#]*\.)?spam-farm\.", "spam", "farm"),
    pattern_rule(r"//(?:[^/?#]*\.)?ads-track\.", "ads", "track"),
    pattern_rule(r"//(?:[^/?#]*\.)?doubleclick\.net", "doubleclick"),
    pattern_rule(r"//(?:[^/?#]*[.-])?casino[.-]", "casino"),
    pattern_rule(r"//(?:[^/?#]*[.-])?poker[.-]", "poker"),
    pattern_rule(r"//(?:[^/?#]*[.-])?viagra[.-]", "viagra"),
    pattern_rule(r"//(?:[^/?#]*[.-])?porn[.-]", "porn"),
    pattern_rule(r"//(?:[^/?#]*[.-])?xxx[.-]", "xxx"),
    pattern_rule(r"//(?:[^/?#]*[.-])?payday-loans?[.-]", "payday"),
    pattern_rule(r"//(?:[^/?#]*[.-])?replica-watch(?:es)?[.-]", "replica"),
    pattern_rule(r"//adserver\.", "adserver"),
    pattern_rule(r"/ad/banners?/", "ad"),
    pattern_rule(r"/ads/banners?/", "ads"),
    pattern_rule(r"/banner/[^?#]*\.swf", "banner"),
    pattern_rule(r"/popunder/", "popunder"),
    pattern_rule(r"/wp-login\.php", "wp", "login"),
    pattern_rule(r"/wp-admin/", "wp", "admin"),
    pattern_rule(r"/cgi-bin/formmail", "cgi", "bin"),
    pattern_rule(r"/xmlrpc\.php", "xmlrpc"),
    pattern_rule(r"[?&]adurl=", "adurl"),
    pattern_rule(r"[?&]clickid=", "clickid"),
    pattern_rule(r"[?&]sessionid=[0-9a-f]{16}", "sessionid"),
    pattern_rule(r"[?&]replytocom=\d+", "replytocom"),
    pattern_rule(r"/calendar/\d{4}/\d{2}/\d{2}/print", "calendar"),
    pattern_rule(r"/(?:cart|basket)/add(?:/|\?|$)", "add"),
    pattern_rule(r"/account/(?:login|register)", "account"),
)


def lowered(url: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(url, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct runs of a-z and 0-9."""
    return F.array_distinct(F.split(lowered(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def token_counts(pages: DataFrame, url: str, rules: Sequence[UrlRule]) -> dict[str, int]:
    """How many rows hold each token of the rules; the result is as small as the rules."""
    known = sorted({t for r in rules for t in r.tokens})
    found = F.array_intersect(url_tokens(F.col(url)), F.array(*[F.lit(t) for t in known]))
    counted = pages.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in known} | {r["token"]: r["count"] for r in counted}


def _entry(rule: UrlRule, token: str) -> Column:
    return F.struct(
        F.lit(token).alias("token"),
        F.lit(rule.rule).alias("rule"),
        F.lit(rule.verdict).alias("verdict"),
        F.lit(rule.pattern).alias("pattern"),
        F.lit(rule.named).alias("named"),
    )


def _entries(items: list[Column]) -> Column:
    return (F.array(*items) if items else F.array()).cast(f"array<{ENTRY}>")


def rarest_tokens(rules: Sequence[UrlRule], counts: dict[str, int]) -> list[str | None]:
    return [min(r.tokens, key=lambda t: (counts[t], t)) if r.tokens else None for r in rules]


def rule_index(pages: DataFrame, url: str, rules: Sequence[UrlRule]) -> Callable[[Column], Column]:
    """Function from a row's tokens to the rules filed under them; rules without a token are always fetched."""
    rarest = rarest_tokens(rules, token_counts(pages, url, rules))
    n = 1 << max(1, (2 * len(rules) - 1).bit_length())
    filed = [(t,) for t in dict.fromkeys(rarest) if t]
    bucket = F.pmod(F.xxhash64("token"), F.lit(n)).cast("int")
    at = {r["token"]: r["b"] for r in pages.sparkSession.createDataFrame(filed, "token string").select("token", bucket.alias("b")).collect()}
    places: dict[int, list[Column]] = {}
    for rule, token in zip(rules, rarest, strict=True):
        places.setdefault(at[token] if token else -1, []).append(_entry(rule, token or ""))
    table, always = F.array(*[_entries(places.get(k, [])) for k in range(n)]), _entries(places.get(-1, []))

    def fetch(token: Column) -> Column:
        return F.filter(F.get(table, F.pmod(F.xxhash64(token), F.lit(n)).cast("int")), lambda e: e["token"] == token)

    return lambda tokens: F.concat(always, F.flatten(F.transform(tokens, fetch)))


def judge_urls(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[UrlRule] = SITE_RULES + PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """One row per page: host, path, the longest fitting site rule, and the verdict.

    A site rule decides; without one, a URL that meets any pattern takes the pattern's verdict (block before allow).
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index is bounded to {MAX_RULES}")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    index = rule_index(rows, "url", rules)
    host, path = host_and_path(F.col("url"))
    whole = lowered(F.coalesce(F.col("url"), F.lit("")))
    parts = rows.select("page_id", host.alias("host"), path.alias("path"), whole.alias("whole"))
    fetched = parts.withColumns({"site": F.concat("host", "path"), "fetched": index(url_tokens(F.col("whole")))})
    fits = lambda e: F.when(e["named"], F.regexp_like(F.col("site"), e["pattern"])).otherwise(F.regexp_like(F.col("whole"), e["pattern"]))
    met = fetched.withColumn("met", F.filter("fetched", fits))
    named = F.transform(F.filter("met", lambda e: e["named"]), lambda e: F.struct(F.char_length(e["rule"]).alias("n"), e["rule"].alias("rule"), e["verdict"].alias("verdict")))
    other = F.array_max(F.transform(F.filter("met", lambda e: ~e["named"]), lambda e: e["verdict"]))
    return met.withColumn("best", F.array_max(named)).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), other, F.lit(default)).alias("verdict"),
    )


def urls_sql() -> str:
    """The same judgement as SQL: every rule against every row."""
    host = f"translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}')"
    rules = ", ".join(f"('{r.rule}', '{r.verdict}', '{r.rule.partition('/')[0]}', '/{r.rule.partition('/')[2]}')" for r in SITE_RULES)
    pattern = "|".join(f"(?:{r.pattern})" for r in PATTERN_RULES)
    return f"""
    WITH rests AS (
        SELECT page_id, coalesce(url, '') AS url,
            CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ),
    parts AS (
        SELECT page_id, url, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
            row_number() OVER () AS row_no
        FROM rests
    ),
    rules(rule, verdict, rule_host, rule_path) AS (VALUES {rules}),
    best AS (
        SELECT row_no, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM parts JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY row_no
    )
    SELECT page_id, host, path, best.rule,
        coalesce(best.verdict, CASE WHEN regexp_matches(translate(url, '{UPPER}', '{LOWER}'), '{pattern}')
            THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN best USING (row_no)
    """

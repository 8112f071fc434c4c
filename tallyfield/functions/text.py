"""Column functions on text: numbers in text, keys, umbrella names, URLs, nested address parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and sentinels whose effect has to equal the source scripts' results.
NUMBER = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+)"
NOT_ALPHANUMERIC = "[^0-9a-zA-Z]+"
UMBRELLA_ANCHORED = "(.+System$)|(.+Consortium$)"
UMBRELLA_OPEN = "(.+System$)|(.+Consortium)"
LEADING_PERCENT = "^%.*"
RANGE_DASH = "—"
HTTP_HOST = "http://(.*?)/"
NAMED_INSTITUTION = r"([a-zA-Z_]+?)\sUniversity of\s([a-zA-Z_\s]+)"
CONSOLE_URL = ("https://search.google.com/u/1/search-console/index?resource_id=", "https://", "/")


def parse_number(text: Column) -> Column:
    """First number in the text, grouping commas dropped; NULL when there is none."""
    digits = F.regexp_replace(F.regexp_extract(text, NUMBER, 1), ",", "")
    return digits.try_cast("double")


def range_midpoint(text: Column) -> Column:
    """`a—b` to the mean of both ends; NULL when any end holds no number."""
    ends = F.transform(F.split(text, RANGE_DASH), parse_number)
    total = F.aggregate(ends, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.size(ends)


def parse_percent(text: Column) -> Column:
    """Percentage text to a number; text that starts with the sign counts as zero."""
    return parse_number(F.regexp_replace(text, LEADING_PERCENT, "0%"))


def join_key(text: Column) -> Column:
    """Name reduced to ASCII letters and digits."""
    return F.regexp_replace(text, NOT_ALPHANUMERIC, "")


def drop_umbrella(parent: Column, anchored: bool) -> Column:
    """Blank a system or consortium parent; what is left empty becomes NULL.

    Both alternatives start greedily at the first character, so one value holds at most one match.
    """
    pattern = UMBRELLA_ANCHORED if anchored else UMBRELLA_OPEN
    return F.nullif(F.regexp_replace(parent, pattern, ""), F.lit(""))


def split_fields(line: Column) -> Column:
    """Comma-separated line to trimmed parts; commas at either end of the line are ignored."""
    return F.transform(F.split(F.btrim(line, F.lit(",")), ","), lambda part: F.trim(part))


def http_hosts(text: Column) -> Column:
    """All hosts that stand between `http://` and the next slash."""
    return F.regexp_extract_all(text, F.lit(HTTP_HOST), F.lit(1))


def named_institution(text: Column) -> Column:
    """`<word> University of <rest>`, NULL without a match."""
    return F.nullif(F.regexp_extract(text, NAMED_INSTITUTION, 0), F.lit(""))


def console_url(host: Column) -> Column:
    """Percent-encoded resource address of one host."""
    base, scheme, tail = CONSOLE_URL
    return F.concat(F.lit(base), F.url_encode(F.concat(F.lit(scheme), host, F.lit(tail))))


def period_label(year: Column, month: Column) -> Column:
    return F.concat_ws("/", year.cast("string"), month.cast("string"))


def country_of(components: Column) -> Column:
    """Long name of the first address component typed `country`; NULL when none is."""
    matches = F.filter(components, lambda part: F.array_contains(part["types"], "country"))
    return F.get(matches, F.lit(0))["long_name"]

"""Quality rules: clean line by line, then judge the document by what is left.

Everything is column expressions over one row, so the scan needs no shuffle and no Python. Windows of five words are
compared as 64-bit hashes; a list of hashes is bound once per row by `let`, never recomputed per element, and the costly
part (ordering windows with their positions) runs only for texts that hold some window twice. Time is n log n in the
length of a text.

Defined cases: a missing text counts as empty (no words, fails the base rule); a missing doc_id stays missing; repeated
rows are judged one by one; other columns of the input never take part (`quality_report`) or are carried along
unchanged (`clean_documents`), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import SPACE_CLASS, SPACES, let, words_of

WINDOW = 5

# The symbols of the base rule and phrases of page furniture.
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "lorem ipsum",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "accept all cookies",
    "click here to",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "enable javascript",
    "skip to main content",
    "back to top",
    "share this article",
    "page not found",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules. A line fails a rule only if it has at least `min_words` words, phrases aside."""

    min_words: int = 6
    symbols_per_word: float = 0.5
    bars_per_word: float = 0.25
    max_upper: float = 0.7
    max_phrase_words: int = 40
    max_lost: float = 0.4


def length_of(text: Column, characters: str) -> Column:
    """How many of the characters the text holds."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five which occurs twice or more in the list, the first occurrence included."""

    def of_windows(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            same = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

        def covered(starts: Column) -> Column:
            steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(placed, twice), covered)).otherwise(0)

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) < WINDOW, 0).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def bad_line(line: Column, rules: LineRules) -> Column:
    """Whether a line fails the punctuation, shouting, navigation or boilerplate rule."""
    phrase = "|".join(BOILERPLATE)

    def judged(words: Column) -> Column:
        n, chars = F.size(words), F.char_length(line)
        upper = F.char_length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        letters = F.char_length(F.regexp_replace(line, r"[^\p{L}]+", ""))
        bars = length_of(line, "|")
        symbols = length_of(line, SYMBOLS)
        odd = (n >= rules.min_words) & (
            (symbols > rules.symbols_per_word * n) | (bars > rules.bars_per_word * n) | (upper > rules.max_upper * letters)
        )
        furniture = (n <= rules.max_phrase_words) & F.lower(line).rlike(phrase)
        return (chars > 0) & (odd | furniture)

    return let(words_of(line), judged)


def kept_lines(text: Column, rules: LineRules) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: ~bad_line(line, rules))


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per document: counts of the base rule, lines removed, characters left, and both verdicts."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return body.select("doc_id", *measures(F.col("body"), rules)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~lost_too_much(rules)).alias("kept"),
        "n_removed_lines",
        "chars_left",
    )


def measures(body: Column, rules: LineRules) -> list[Column]:
    lines = let(kept_lines(body, rules), lambda x: F.struct(F.size(x).alias("n"), F.char_length(F.array_join(x, "\n")).alias("chars")))
    counted = let(words_of(body), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    return [
        counted["n"].cast("long").alias("n_words"),
        F.char_length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        length_of(body, SYMBOLS).cast("long").alias("n_symbols"),
        duplicate_lines(body).cast("long").alias("n_dup_lines"),
        counted["repeated"].cast("long").alias("n_repeat_words"),
        (F.size(F.split(body, "\n")) - lines["n"]).cast("long").alias("n_removed_lines"),
        lines["chars"].cast("long").alias("chars_left"),
        F.char_length(body).cast("long").alias("chars_before"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def lost_too_much(rules: LineRules) -> Column:
    return F.col("chars_left") < (1 - rules.max_lost) * F.col("chars_before")


def clean_documents(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with failing lines taken out of their text; all columns stay as they were named."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*measures(body, rules)).alias("m"))
    judged = judged.select("row", "m.*").where(~base_failed() & ~lost_too_much(rules))
    cleaned = F.array_join(kept_lines(F.col(f"row.`{text}`"), rules), "\n")
    whole = F.when(F.col("n_removed_lines") == 0, F.col(f"row.`{text}`")).otherwise(cleaned)
    return judged.select(*[whole.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


# The same rules over the whole table for a check by another engine.
_LINES = f"""
    SELECT doc_id, line,
        len(list_filter(string_split_regex(line, '{SPACE_CLASS}+'), lambda x: x <> '')) AS n,
        length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols,
        length(regexp_replace(line, '[^|]+', '', 'g')) AS bars,
        length(regexp_replace(line, '[^\\p{{Lu}}]+', '', 'g')) AS uppers,
        length(regexp_replace(line, '[^\\p{{L}}]+', '', 'g')) AS letters
    FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM bodies)
"""

QUALITY_SQL = f"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
worded AS (
    SELECT doc_id, body, list_filter(string_split_regex(body, '{SPACE_CLASS}+'), lambda x: x <> '') AS w FROM bodies
),
places AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM worded WHERE len(w) >= 5),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+4], chr(10)) AS k FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
),
lines AS ({_LINES}),
judged AS (
    SELECT *, line <> '' AND (
        n >= 6 AND (symbols > 0.5 * n OR bars > 0.25 * n OR uppers > 0.7 * letters)
        OR n <= 40 AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')
    ) AS bad FROM lines
),
dups AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY doc_id
),
left_over AS (
    SELECT doc_id, count(*) FILTER (WHERE bad) AS removed,
        greatest(0, coalesce(sum(length(line) + 1) FILTER (WHERE NOT bad), 0) - 1) AS chars
    FROM judged GROUP BY doc_id
),
counted AS (
    SELECT worded.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        left_over.removed::BIGINT AS n_removed_lines, left_over.chars::BIGINT AS chars_left, length(body) AS chars
    FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN left_over USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT chars_left < 0.6 * chars AS kept,
    n_removed_lines, chars_left
FROM counted
"""

"""Spelling variants: words one edit apart, found through pivotal grams.

Words are counted where they stand, and only words that occur often enough go on. A word's bigrams are put in one order for
all words, rarest first. Its prefix is the first three; its pivots are two of these that share no letter, chosen by dynamic
programming so that they are the rarest pair. One edit can touch only one of two pivots. So for two words one edit apart,
the word whose prefix ends first in that order has a pivot that the edit leaves alone, and the other word has the same
bigram in its prefix, moved by one place at most. (For a bigram that stands at neighbouring places the prefix takes one
place more, so that a shift cannot push it out.)

Pivots are indexed against prefixes with what their place implies: the edit lies on one side of an untouched pivot, so the
other side is equal letter for letter; and it lies in the near or in the far half of its side, so the other half is equal as
well. A key is the pivot with its equal side and the equal half, which is at least half of the word, so keys are shared by
few words however many words there are. Keys are 64-bit hashes; whether two words are one edit apart is decided on the words
themselves inside the join.

The bigram counts are the only thing that tasks get from the driver: at most as many as there are pairs of letters.

Defined cases: a missing or empty text has no words; a missing id counts as the empty text in front of the colon; repeated
rows count each; a very long run is one word (its prefix is three places, whatever its length); an empty table gives no
rows; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import materialised

# The letters of words and what lower-casing covers.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOISE = 31
LENGTH, OFTEN, DOMINANT = 7, 2, 10
GRAM, EDITS = 2, 1
PREFIX, PIVOTS = GRAM * EDITS + 1, EDITS + 1


# --- words ---------------------------------------------------------------------------------------------------------


def noisy(run: Column, doc_id: Column, divisor: int) -> Column:
    """The run without one letter where the divisor divides the checksum of `<doc_id>:<run>`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % divisor == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, doc_id: str, text: str, noise: int | None, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """`word`, `n` of the words with enough letters and occurrences; `noise` deletes letters as planted misspellings."""
    runs = F.regexp_extract_all(F.col("body"), F.lit(f"([{LETTERS}]{{{length},}})"), F.lit(1))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).select("id", F.explode(runs).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    rows = rows.select("id", run.alias("run"))
    words = rows.select((noisy(F.col("run"), F.col("id"), noise) if noise else F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many places each bigram stands; at most one entry per pair of letters."""
    places = F.transform(F.sequence(F.lit(1), F.char_length("word") - GRAM + 1), lambda i: F.substring("word", i, F.lit(GRAM)))
    rows = words.where(F.char_length("word") >= GRAM).select(F.explode(places).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {gram: n for gram, n in rows.collect()}


# --- grams ---------------------------------------------------------------------------------------------------------


def prefix(word: str, counts: dict[str, int]) -> list[tuple[int, str, int]]:
    """The rarest bigrams of a word as (count, bigram, place), and those that a shift by one place may bring in."""
    grams = sorted((counts[word[i : i + GRAM]], word[i : i + GRAM], i) for i in range(len(word) - GRAM + 1))
    end = grams[:PREFIX][-1]
    return [g for k, g in enumerate(grams) if k < PREFIX or (g[1] == end[1] and g[2] <= end[2] + EDITS)]


def pivots(grams: list[tuple[int, str, int]]) -> list[int]:
    """Places of the rarest bigrams of a prefix that share no letter: least sum of counts, by dynamic programming."""
    placed = sorted((place, count) for count, _, place in grams[:PREFIX])
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * PIVOTS]
    for i, (place, count) in enumerate(placed):
        before = max((j + 1 for j in range(i) if placed[j][0] + GRAM <= place), default=0)
        row = list(best[i])
        for k in range(1, PIVOTS + 1):
            if (with_ := best[before][k - 1]) is not None:
                taken = (with_[0] + count, (*with_[1], place))
                row[k] = taken if row[k] is None else min(row[k], taken)
        best.append(row)
    return list(best[-1][PIVOTS][1])


def keys(word: str, place: int, slack: int) -> set[int]:
    """Hashes of a bigram at its place with the equal side and the equal half of the other side.

    `slack` 0 halves the side as it is (for pivots); 1 also as it may be in a word with one letter less or more.
    """
    n, end = len(word), place + GRAM
    hash_ = xxhash.xxh64_intdigest
    found = set()
    for right, size in ((True, n - end), (False, place)):
        whole = {m for m in range(size - slack, size + slack + 1) if m >= 0}
        for near in {m // 2 for m in whole}:
            if near <= size:
                part = f"n{place}:{word[: end + near]}" if right else f"N{n - place}:{word[place - near :]}"
                found.add(hash_(part))
        for far in {m - m // 2 for m in whole}:
            if far <= size:
                part = f"f{place}:{word[:end]}:{word[n - far :]}" if right else f"F{n - place}:{word[:far]}:{word[place:]}"
                found.add(hash_(part))
    return {h - (1 << 64) if h >> 63 else h for h in found}


def gram_keys(words: DataFrame, counts: dict[str, int], only_pivots: bool) -> DataFrame:
    """A row per word and key of its pivots, or of its whole prefix."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.column(0), batch.num_rows
            for lo in range(0, rows, 2048):
                own, at = [], []
                for k, word in enumerate(names.slice(lo, 2048).to_pylist(), lo):
                    grams = prefix(word, counts)
                    if only_pivots:
                        found = set().union(*(keys(word, place, 0) for place in pivots(grams)))
                    else:
                        found = set().union(*(keys(word, place, EDITS) for _, _, place in grams))
                    own += found
                    at += [k] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), names.take(pa.array(at, pa.int64()))], names=["key", "word"])

    return words.select("word").mapInArrow(spread, "key long, word string")


# --- jobs ----------------------------------------------------------------------------------------------------------


def near_words(words: DataFrame) -> DataFrame:
    """Every pair (`a` < `b`) of words exactly one inserted, deleted or replaced letter apart, once."""
    counts = gram_counts(words)
    left = gram_keys(words, counts, True).withColumnRenamed("word", "x")
    right = gram_keys(words, counts, False).withColumnRenamed("word", "y")
    near = (F.col("x") != F.col("y")) & (F.levenshtein("x", "y", EDITS) == EDITS)
    return left.join(right, "key").where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root` for every word that has a form: forms followed to the last one.

    A form occurs many times as often as its word, so there are no cycles, and paths halve in every round.
    """
    paths = forms.select("word", F.col("form").alias("root"))
    while True:
        up = paths.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = paths.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        moved = materialised(moved, "roots")
        paths = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return paths


def spelling_variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    noise: int | None = None,
    length: int = LENGTH,
    often: int = OFTEN,
    dominant: int = DOMINANT,
) -> DataFrame:
    """One row per word: its common form, the root that forms lead to, counts, and the number of words one edit apart.

    The form is the most frequent word one edit apart (ties: the first in code-point order), if it occurs `dominant` times
    as often as the word. Words take at least `length` letters, at least four, so that two pivots fit.
    """
    if length < PREFIX + GRAM - 1:
        raise ValueError(f"words take at least {PREFIX + GRAM - 1} letters")
    words = materialised(word_counts(docs, doc_id, text, noise, length, often), "words")
    pairs = materialised(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    first = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("first"))
    common = -F.col("first.n") >= dominant * F.col("n")
    known = words.join(near, "word", "left").select(
        "word",
        F.when(common, F.col("first.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, -F.col("first.n")).alias("form_n"),
    )
    known = materialised(known, "forms")
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The same words by deleting each letter of every word and comparing what is left; the checksum is laid out bit by bit.
VARIANTS_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS run FROM documents
), low AS (
    SELECT translate(run, '{UPPER}', '{LOWER}') AS run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head
    FROM runs WHERE length(run) >= {LENGTH}
), bytes AS (
    SELECT run, flatten(list_transform(string_split(head || run, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), 128 + unicode(c) % 64] END)) AS b
    FROM low
), sums AS (
    SELECT run, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x:
        list_reduce(list_prepend(xor(h, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) AS h
    FROM bytes
), noisy AS (
    SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
    FROM sums
), words AS (
    SELECT word, count(*) AS n FROM noisy WHERE length(word) >= {LENGTH} GROUP BY word HAVING count(*) >= {OFTEN}
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), gaps AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS rest FROM places
), near AS (
    SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, min((-n, other)) AS first FROM near GROUP BY word
), forms AS (
    SELECT w.word, CASE WHEN -first[1] >= {DOMINANT} * n THEN first[2] END AS form, n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -first[1] >= {DOMINANT} * n THEN -first[1] END AS form_n
    FROM words w LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN forms f ON f.word = walk.next
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON f.word = walk.word AND walk.next IS NULL
"""

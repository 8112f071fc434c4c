"""Spelling variants: pivots and keys lose no pair, results against deleting letters, edge cases."""

import collections
import random
import re
import zlib

import pytest

from tallyfield.llm.spelling_variants import EDITS, LOWER, PIVOTS, UPPER, keys, near_words, pivots, prefix, spelling_variants, word_counts


def distance_one(a, b):
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, noise=31, length=7, often=2, dominant=10):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if noise and h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    count = {w: n for w, n in count.items() if len(w) >= length and n >= often}
    by_size = collections.defaultdict(list)
    for w in count:
        by_size[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if distance_one(w, x)] for w in count}
    form = {}
    for w, others in near.items():
        first = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = first if first is not None and count[first] >= dominant * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items()}


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def edited(word, draw, letters):
    i = draw.randrange(len(word) + 1)
    kind = draw.randrange(3)
    if kind == 0:
        return word[:i] + draw.choice(letters) + word[i:]
    i = min(i, len(word) - 1)
    return word[:i] + word[i + 1 :] if kind == 1 else word[:i] + draw.choice(letters) + word[i + 1 :]


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzàÿ"])
def test_pivots_and_prefixes_of_any_near_words_share_a_key(letters):
    draw = random.Random(len(letters))
    for _ in range(4000):
        a = "".join(draw.choice(letters) for _ in range(draw.choice([4, 5, 7, 8, 9, 15, 30])))
        b = edited(a, draw, letters)
        if not distance_one(a, b) or len(b) < 4:
            continue
        counts = {g: draw.randrange(1, 4) for w in (a, b) for g in (w[i : i + 2] for i in range(len(w) - 1))}
        pre = {w: prefix(w, counts) for w in (a, b)}
        piv = {w: pivots(pre[w]) for w in (a, b)}
        met = False
        for x, y in ((a, b), (b, a)):
            mine = set().union(*(keys(x, p, 0) for p in piv[x]))
            met |= bool(mine & set().union(*(keys(y, p, EDITS) for _, _, p in pre[y])))
        assert met, (a, b, counts)


def test_pivots_are_the_rarest_disjoint_pair():
    draw = random.Random(1)
    for _ in range(500):
        word = "".join(draw.choice("abcd") for _ in range(draw.randint(4, 12)))
        counts = {word[i : i + 2]: draw.randrange(1, 9) for i in range(len(word) - 1)}
        first = prefix(word, counts)[:3]
        assert 3 <= len(prefix(word, counts)) <= 3 + EDITS
        pairs = [(p[0] + q[0]) for p in first for q in first if q[2] - p[2] >= 2]
        got = pivots(prefix(word, counts))
        assert len(got) == PIVOTS and got[1] - got[0] >= 2
        assert sum(counts[word[p : p + 2]] for p in got) == min(pairs)


def test_a_long_word_has_few_keys():
    word = "ab" * 20_000
    counts = {"ab": 1, "ba": 1}
    assert len(prefix(word, counts)) <= 3 + EDITS
    assert sum(len(keys(word, p, EDITS)) for _, _, p in prefix(word, counts)) <= 8 * (3 + EDITS)


@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_near_words_equal_all_pairs(spark, letters):
    draw = random.Random(5)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(7, 9))) for _ in range(400)}
    words |= {edited(w, draw, letters) for w in sorted(words)}
    words = sorted(w for w in words if len(w) >= 7)
    got = near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in words for b in words if a < b and distance_one(a, b)]


def test_results_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(spelling_variants(docs, noise=31)) == brute([tuple(r) for r in docs.collect()])


def test_chains_of_forms_end_in_one_root(spark):
    text = " ".join(["colouring"] * 2000 + ["colourings"] * 200 + ["kolourings"] * 20 + ["kolouringz"] * 2 + ["unrelated"] * 3)
    got = result(spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got == brute([(1, text)], None)
    assert got["kolouringz"][:2] == ("kolourings", "colouring") and got["unrelated"] == (None, "unrelated", 3, 0, None)


def test_ties_take_the_first_form(spark):
    text = " ".join(["lettera"] * 40 + ["letterÿ"] * 40 + ["letterz"] * 40 + ["letterq"] * 4)
    got = result(spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got["letterq"] == ("lettera", "lettera", 4, 3, 40) == brute([(1, text)], None)["letterq"]


def test_edge_cases(spark):
    long = "x" * 30_000
    rows = [(None, "Missing missing MISSINGS"), (None, None), (1, ""), (1, "ÀÉÎõüÿ× àéîõüÿ÷"), (2, long), (3, long + " " + long[:-1]), (4, long[:-1])]
    rows += [(5, "repeated words repeated"), (5, "repeated words repeated"), (6, "dot.separated dot,separated under_score under_score")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for noise in (None, 2, 31):
        assert result(spelling_variants(docs, noise=noise)) == brute(rows, noise)
    assert spelling_variants(docs.where("doc_id > 99")).collect() == []
    assert spelling_variants(docs.where("doc_id = 1")).collect() == []
    with pytest.raises(ValueError, match="at least 4"):
        spelling_variants(docs, length=3)
    assert word_counts(docs, "doc_id", "text", None, 8).where("word = 'repeated'").first()["n"] == 4


def test_one_word_with_most_places(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat(repeat('frequent ', 20), 'frequemt') AS text")
    got = result(spelling_variants(docs))
    assert got["frequent"] == (None, "frequent", 60_000, 1, None) and got["frequemt"] == ("frequent", "frequent", 3000, 1, 60_000)

"""Missing values, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfield.llm.embedding_dedup import link_embeddings
from tallyfield.llm.language_id import accepted, identify
from tallyfield.llm.license_scan import scan_licenses
from tallyfield.llm.minhash_dedup import deduplicated, near_duplicates
from tallyfield.llm.packing import pack_documents
from tallyfield.llm.quality_rules import clean_documents, quality_report
from tallyfield.llm.sharding import shard_documents
from tallyfield.llm.token_rollups import corpus_rollup
from tallyfield.llm.url_filters import judge_urls
from tallyfield.llm.word_bpe import decoded, encoded

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("body", "row", "m", "n", "h", "d", "cell", "part", "group", "groups", "node", "a", "b", "same", "print", "sig", "key", "order", "shard", "ids")
LONG = "palabra " * 40_000 + "\n" + "x" * 100_000

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "s", 0),
    (1, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "s", 0),
    (2, None, "en", None, 0),
    (3, "", None, "s", 0),
    (None, "licensed under the mit license and nothing else in this place here", "en", "s", 0),
    (5, " \t\n\x0b ", "en", "s", None),
    (6, "### $$$ 123 !!", None, None, 0),
    (7, LONG, "es", "s", 0),
    (8, "a", "en", "s", 0),
    (9, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "s", 0),
    (10, "emoji \U0001f642 and 中文 and <|endoftext|> inside of a text with ten words", "en", "s", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"clash-{c}") for c in CLASHES})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "quality": quality_report,
    "packing": pack_documents,
    "sharding": shard_documents,
    "minhash": near_duplicates,
    "language": identify,
    "licenses": scan_licenses,
    "bpe": encoded,
    "rollup": corpus_rollup,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"rollup", "packing"}))
def test_odd_rows_and_clashing_names(docs, name):
    got = [r["doc_id"] for r in OPERATORS[name](docs).collect()]
    assert sorted(got, key=repr) == sorted([r[0] for r in ROWS], key=repr)


def test_quality_cases(docs):
    got = {r["doc_id"]: r for r in quality_report(docs).collect()}
    assert got[2]["n_words"] == got[3]["n_words"] == got[5]["n_words"] == 0 and got[2]["base_failed"]
    assert got[7]["n_words"] == 40_001 and got[7]["n_repeat_words"] == 40_000 and not got[7]["kept"]
    assert got[1]["kept"]


def test_cleaning_keeps_columns_and_clean_text(docs):
    got = clean_documents(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"]: r for r in got.collect()}
    assert kept[9]["text"] == ROWS[9][1] and kept[9]["row"] == "clash-row" and 2 not in kept


def test_minhash_cases(docs):
    got = {r["doc_id"]: r for r in near_duplicates(docs, words=2).collect()}
    assert got[2]["n_shingles"] == got[3]["n_shingles"] == got[5]["n_shingles"] == 0
    assert got[9]["component_id"] == 1 and not got[9]["kept"] and got[1]["kept"]
    assert got[8]["n_shingles"] == 1 and got[8]["component_id"] == 8
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_one_document_of_each_group_stays(docs):
    got = deduplicated(docs, words=2)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted([1, 2, 3, None, 5, 6, 7, 8, 10], key=repr)


def test_language_cases(docs):
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 5, 6))
    assert got[None]["held_out"] and 0 < got[1]["score"] <= 1


def test_license_cases(docs):
    got = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    assert got[2]["n_words"] == 0 and got[2]["first_word"] is None and got[2]["labels"] == ""
    assert (got[None]["n_base"], got[None]["first_word"], got[None]["base_labels"], got[None]["labels"]) == (1, 3, "mit", "mit")


def test_packing_cases(docs):
    rows = pack_documents(docs, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["doc_tokens"] == 1 and by[i][0]["ids"] == [1] for i in (2, 3, 5))
    assert len(by[1]) == 2 and len(by[7]) > 10
    assert sum(r["length"] for r in by[7]) == by[7][0]["doc_tokens"]


def test_bpe_ids_and_decoding(docs):
    ids = encoded(docs)
    got = {r["doc_id"]: r for r in decoded(ids).collect()}
    assert got[2]["decoded"] == "" and "<|endoftext|>" in got[10]["decoded"]


def test_rollup_of_odd_rows(docs):
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in corpus_rollup(docs).collect()}
    assert got[(None, "en", "words-1")] == (1, 0)
    assert ("s", "es", "pieces-1") in got


def test_url_cases(spark):
    rows = [(1, None), (2, "no scheme"), (3, ""), (None, "http://A.B.ORG"), (5, "http://x.ORG/"), (5, "http://x.ORG/"), (6, "https://cheap-pills.net/" + "a" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "path", "tokens", "rule", "met", "best", "site")})
    got = sorted(((r["page_id"], r["host"], r["path"][:3], r["rule"], r["verdict"]) for r in judge_urls(pages).collect()), key=repr)
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (None, "a.b.org", "", None, "allow")]
    want += [(5, "x.org", "/", "org/", "allow")] * 2 + [(6, "cheap-pills.net", "/aa", None, "block")]
    assert got == sorted(want, key=repr)
    assert judge_urls(pages.limit(0)).collect() == []


def test_embedding_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0])]
    rows += [(8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1e300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("z") for c in ("vector", "node", "copies", "cell", "links")})
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in link_embeddings(df).collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (11, 3, 1, False), (None, 0, None, True)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted(want, key=repr)
    assert link_embeddings(df.limit(0)).collect() == []


def test_pipeline_takes_odd_rows(spark, docs, none):
    for start in (docs, none):
        df = start.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, "")
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {"doc_id", "sequence_id"} <= set(corpus_pipeline.STAGES[-1][1](spark, df, "").columns)


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "", None), (5, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in accepted(docs).collect()) == [1, 5]


def test_one_id_with_several_texts_is_judged_text_by_text(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (2, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(1, 1, True), (2, 2, True), (5, 1, False), (5, 2, False)]

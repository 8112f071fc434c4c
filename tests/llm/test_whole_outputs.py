"""Output columns of the licence scan and the word encoder over the whole documents, against brute force and the library."""

import hashlib
import re

import pytest
from tokenizers import Tokenizer

from tallyfield.llm.common import documents
from tallyfield.llm.queries import QUERIES
from tallyfield.llm.word_bpe import tokenizer_path

FOLDER = "/root/testdata/sf0.01"
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, FOLDER).select("doc_id", "text").collect()}


def test_license_columns_equal_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op8_license_scan"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        words = WORD.findall(text.translate(LOWER))
        places = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if tuple(words[i : i + len(phrase)]) == phrase]
        starts, row = [i for i, _ in places], got[doc]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert (row["first_word"], row["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        base = sorted({label for _, label in places})
        assert row["base_labels"] == ",".join(base)
        labels = row["labels"].split(",") if row["labels"] else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= row["score"] <= 1


def test_encoded_columns_equal_the_library(spark, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    got = {r["doc_id"]: r for r in QUERIES["op10_word_bpe"](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want = (len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), decoded)))
        assert tuple(got[doc][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want

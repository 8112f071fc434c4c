"""Binary id files: exact round trips against the tokenizers library, damaged and repeated files, edge cases."""

import random
import zlib

import numpy as np
import pytest

from tallyfield.llm.token_planes import (
    TOKENIZER,
    binary_ids,
    encoder,
    opened,
    place,
    pressed,
    read_documents,
    read_window,
    shuffled,
    unshuffled,
    write_ids,
)
from tallyfield.llm.word_bpe import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(TOKENIZER))


def expected(library, rows, end=0):
    """Rows of the contract for (doc_id, text) in file order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_the_library(library):
    draw = random.Random(8)
    letters = "abcdefgh 's're\n\t.,!0123 ßİΣσςé  　\x1c\x01 中文🙂<|endoftext|> _½²٣Ａ​\x85 àb 'S ǅ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(draw.choice("abcdef") for _ in range(30_000)), " " * 5000, "<|endoftext|>" * 9]
    encode = encoder(tokenizer_path(TOKENIZER))
    for text in texts:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    other = encoder(tokenizer_path())  # a file whose ids do not follow bytes runs in its own library
    assert other("Hello there").tolist() == __import__("tokenizers").Tokenizer.from_file(tokenizer_path()).encode("Hello there", add_special_tokens=False).ids


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("kind", ["<u4", "<i8"])
def test_planes_round_trip(planes, kind):
    draw = np.random.default_rng(4)
    for count in (1, 7, 8, 9, 1000):
        for top in (1, 2, 50_257, 1 << 31):
            values = draw.integers(0, top, count).astype(kind)
            rows = shuffled(values, planes)
            assert len(rows) == np.dtype(kind).itemsize * (8 if planes == "bit" else 1)
            back = opened(pressed(rows, 3), len(rows))
            assert back == rows and (unshuffled(back, count, kind, planes) == values).all()


@pytest.mark.parametrize(("planes", "block"), [("byte", 65_536), ("bit", 1000), ("byte", 1)])
def test_files_read_back_equal_the_library(spark, library, planes, block):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.limit(3) if block == 1 else docs
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    manifest = write_ids(docs.repartition(5), planes=planes, block=block)
    got = sorted(tuple(r) for r in read_documents(manifest, planes).collect())
    assert got == expected(library, rows)
    with_ids = {r["doc_id"]: r["ids"] for r in read_documents(manifest, planes, with_ids=True).collect()}
    assert all(with_ids[i] == [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in rows)


def test_files_hold_ascending_documents_and_any_window(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    manifest = write_ids(docs, block=512)
    files = [r for r in manifest.orderBy("first_id").collect()]
    flat = np.concatenate([read_window(r["file"], 0, r["ids"]) for r in files])
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = np.concatenate([[*library.encode(t, add_special_tokens=False).ids, 0] for _, t in rows])
    assert (flat == want).all() and [r["part"] for r in files] == sorted(r["part"] for r in files)
    file, first = files[-1]["file"], files[-1]["first_id"]
    for lo, n in ((0, 1), (500, 30), (511, 2), (1000, 5000)):
        assert (read_window(file, lo, n) == want[first + lo : first + lo + n]).all()


def test_a_damaged_block_is_found(spark):
    file = write_ids(spark.createDataFrame([(1, "some words " * 500)], "doc_id long, text string")).first()["file"]
    system, name = place(file)
    with system.open_input_file(name) as f:
        data = bytearray(f.read())
    data[40] ^= 1
    with system.open_output_stream(name + "-bad") as f:
        f.write(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        read_window(file + "-bad", 0, 10)


def test_files_of_lost_tasks_are_not_read(spark, library):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    manifest = write_ids(docs)
    system, name = place(manifest.first()["file"])
    with system.open_output_stream(name.rsplit("/", 1)[0] + "/part-000000-lost.planes") as f:
        f.write(b"half a file")
    assert read_documents(manifest).count() == 20


def test_edge_cases(spark, library):
    long = "word " * 200_000
    rows = [(None, "b"), (None, None), (3, "x"), (3, "x"), (3, "y"), (-5, ""), (7, long), (1 << 62, "z")]
    docs = spark.createDataFrame([(i, t, 0, "s", -1) for i, t in rows], "doc_id long, text string, start int, ids string, n_tokens int")
    got = binary_ids(docs, block=4096).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -5, 3, 3, 3, 7, 1 << 62]
    sizes = {r["doc_id"]: r["n_tokens"] for r in got}
    assert sizes[-5] == 1 and sizes[7] == len(library.encode(long, add_special_tokens=False).ids) + 1
    starts = [r["start"] for r in got]
    assert starts == np.cumsum([0, *[r["n_tokens"] for r in got][:-1]]).tolist()
    assert len({(r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == 3}) == 2
    empty = docs.where("doc_id = 99")
    assert binary_ids(empty).collect() == [] and write_ids(empty).collect() == []
    with pytest.raises(ValueError, match="byte or bit"):
        write_ids(docs, planes="word")


def test_one_id_with_most_rows_is_cut(spark):
    docs = spark.range(4000).selectExpr("CAST(5 AS LONG) AS doc_id", "concat('text ', id % 3) AS text")
    manifest = write_ids(docs)
    assert manifest.selectExpr("sum(documents)").first()[0] == 4000
    assert read_documents(manifest).selectExpr("max(start + n_tokens)").first()[0] == manifest.selectExpr("sum(ids)").first()[0]

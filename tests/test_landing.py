"""Landing with a manifest: files read once, changed files replaced, broken files kept apart, broken takes undone."""

import json
import os

import pytest
from oracle import compare, connect
from pyspark.sql import DataFrameReader

from tallyfield.registry import ORACLES, QUERIES
from tallyfield.session import work_path
from tallyfield.sources import files, landing
from tallyfield.sources.landing import Landing

ROW = "name string, score int"


def put(folder, name, text, at=None):
    path = folder / name
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def entries(*pairs):
    return json.dumps({"data": [{"name": n, "score": s} for n, s in pairs]})


def test_files_are_read_once_and_broken_ones_kept_apart(spark, tmp_path):
    state = Landing(spark, work_path(spark, "landing"), ROW)
    assert state.rows().collect() == [] and state.manifest().collect() == [] and state.broken().collect() == []
    put(tmp_path, "a b.json", entries(("x", 1), ("y", None)), 1_000_000)
    put(tmp_path, "b.json", entries(("x", 2)), 1_000_000)
    put(tmp_path, "half.json", '{"data": [{"name": "z"', 1_000_000)
    put(tmp_path, "other.json", '{"rows": []}', 1_000_000)
    put(tmp_path, "none.json", "\n \n", 1_000_000)
    put(tmp_path, "zero.json", "", 1_000_000)
    folder = str(tmp_path)
    assert state.take(folder) == 5 and state.take(folder) == 0 and state.takes() == [1]
    found = lambda: sorted((r["name"], r["score"] or 0) for r in state.rows().collect())
    broken = lambda: {r["file"].rsplit("/", 1)[1]: r["reason"] for r in state.broken().collect()}
    assert found() == [("x", 1), ("x", 2), ("y", 0)]
    reasons = broken()
    assert reasons.pop("none.json") in ("empty file", "not a document", "no entries named data")
    assert reasons == {"half.json": "not a document", "other.json": "no entries named data"}
    put(tmp_path, "b.json", entries(("x", 3), ("w", 4)), 2_000_000)
    put(tmp_path, "half.json", entries(("z", 5)), 2_000_000)
    put(tmp_path, "c.json", entries(), 2_000_000)
    assert state.take(folder) == 3 and state.take(folder) == 0
    assert found() == [("w", 4), ("x", 1), ("x", 3), ("y", 0), ("z", 5)] and set(broken()) == {"other.json", "none.json"}
    assert state.manifest().count() == 8


def test_a_take_that_broke_off_is_done_anew(spark, tmp_path):
    state = Landing(spark, work_path(spark, "landing"), ROW)
    put(tmp_path, "a.json", entries(("x", 1)))
    (tmp_path / "left").mkdir()
    spark.createDataFrame([("lost", None, "lost")], "file string, data array<struct<name string, score int>>, reason string").write.parquet(f"{state.path}/take-1/documents")
    assert state.takes() == [] and state.rows().collect() == []
    assert state.take(str(tmp_path)) == 1 and [(r["name"], r["score"]) for r in state.rows().collect()] == [("x", 1)]


def test_many_new_files_are_read_from_the_folder(spark, tmp_path, monkeypatch):
    """Above `FEW` new files no path passes the driver, whatever their times; the result is that of reading by paths."""
    asked, read = [], DataFrameReader.json
    monkeypatch.setattr(DataFrameReader, "json", lambda self, path, *a, **b: asked.append(path) or read(self, path, *a, **b))
    monkeypatch.setattr(landing, "FEW", 2, raising=False)
    folder, found, broken = str(tmp_path), {}, {}
    states = [Landing(spark, work_path(spark, "landing"), ROW) for _ in range(2)]
    (tmp_path / "in").mkdir()

    def taken():
        for few, state in zip((2, 1_000), states, strict=True):
            monkeypatch.setattr(landing, "FEW", few, raising=False)
            yield state.take(folder)
            found[few] = sorted((r["file"], r["name"], r["score"] or 0) for r in state.rows().collect())
            broken[few] = sorted(map(tuple, state.broken().collect()))

    for k in range(5):
        put(tmp_path, f"a {k}.json", entries((f"x{k}", k)), 2_000_000 + k)
    put(tmp_path, "zero.json", "", 2_000_000)
    assert [*taken()] == [5, 5] and asked[0] == folder and len(asked[1]) == 5
    put(tmp_path, "a 3.json", entries(("y", 3), ("z", None)), 3_000_000)
    put(tmp_path / "in", "older.json", entries(("o", 7)), 1_000_000)
    put(tmp_path, "half.json", '{"data": [{"name": "z"', 2_000_001)
    assert [*taken()] == [3, 3] and asked[2] == folder and len(asked[3]) == 3 and [*taken()] == [0, 0]
    put(tmp_path, "half.json", entries(("h", 1)), 4_000_000)
    assert [*taken()] == [1, 1] and len(asked[4]) == len(asked[5]) == 1 and not broken[2]
    assert found[2] == found[1_000] and broken[2] == broken[1_000]
    assert [r[1:] for r in found[2]] == [("x0", 0), ("x1", 1), ("x2", 2), ("y", 3), ("z", 0), ("x4", 4), ("h", 1), ("o", 7)]
    # the folder is read whole, but what a former take holds is not kept again
    assert states[0].documents(2).count() == states[1].documents(2).count() == 3


def test_documents_are_written_one_per_file(spark, tmp_path):
    rows = [("1_a.json", "é", 1), ("2 b.json", None, 2), ("none_none.json", "x\ny", None)]
    frame = spark.createDataFrame(rows, "file string, name string, score int").repartition(3, "file")
    for path in (f"{tmp_path}/out", f"file:{tmp_path}/out"):  # the second time the files stand in for those of the first
        assert files.write_documents(frame, path) == 3
    assert sorted(os.listdir(tmp_path / "out")) == [r[0] for r in rows]
    assert (tmp_path / "out" / "2 b.json").read_text() == '{"score":2}\n'
    got = spark.read.schema(ROW).json(f"{tmp_path}/out", multiLine=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r[1:] for r in rows), key=repr)
    assert files.write_documents(frame.limit(0), f"{tmp_path}/none") == 0 and os.listdir(tmp_path / "none") == []


@pytest.mark.parametrize("name", ["a2_landing_manifest"])
def test_counts_equal_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    ok, message = compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name])
    assert ok, message

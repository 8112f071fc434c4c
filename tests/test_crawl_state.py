"""The crawl ledger over many runs: final success, counted retries, broken and repeated runs."""

import pytest
from oracle import compare, connect

from tallyfield.plans.crawl_state import CrawlState
from tallyfield.registry import ORACLES, QUERIES
from tallyfield.session import work_path


def attempts(spark, *rows):
    return spark.createDataFrame(list(rows), "host string, reason string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_success_is_final_and_failures_are_counted(spark):
    state = CrawlState(spark, work_path(spark, "crawl"))
    assert state.current().collect() == [] and state.runs() == []
    assert state.record(1, attempts(spark, ("a", None), ("b", "slow"), ("b", "gone"), ("c", "slow"), (None, None)))
    assert state.record(3, attempts(spark, ("a", "late failure"), ("b", None), ("b", "slow"), ("d", "slow")))
    assert state.record(4, attempts(spark, ("c", "gone"), ("d", "gone")))
    want = [("a", "success", 1, None, 1, 1), ("b", "success", 2, None, 1, 3), ("c", "try", 2, "gone", 1, 4), ("d", "try", 2, "gone", 3, 4)]
    assert rows(state.current()) == want
    hosts = attempts(spark, ("a", None), ("c", None), ("c", None), ("d", None), ("e", None), (None, None))
    assert rows(state.open_hosts(hosts)) == [("c",), ("d",), ("e",)]
    assert rows(state.open_hosts(hosts, most_tries=2)) == [("e",)]
    assert state.record(5, attempts(spark).limit(0)) and rows(state.current()) == want
    state.drop_old(2)
    assert state.runs() == [4, 5] and rows(state.current()) == want


def test_repeated_and_broken_runs(spark):
    state = CrawlState(spark, work_path(spark, "crawl"))
    state.record(1, attempts(spark, ("a", "slow")))
    before = rows(state.current())
    assert not state.record(1, attempts(spark, ("a", None))) and rows(state.current()) == before
    broken = attempts(spark, ("a", None), ("b", None)).selectExpr("host", "CASE WHEN host = 'b' THEN raise_error('lost') ELSE reason END AS reason")
    with pytest.raises(Exception, match="lost"):
        state.record(2, broken)
    assert state.runs() == [1] and rows(state.current()) == before
    assert state.record(2, attempts(spark, ("a", None)))
    assert rows(state.current()) == [("a", "success", 2, None, 1, 2)]
    assert rows(CrawlState(spark, state.path).current()) == rows(state.current())


def test_three_rounds_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, message = compare(QUERIES["h22_crawl_rounds"](spark, folder), connect(folder), ORACLES["h22_crawl_rounds"])
    assert ok, message

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from ledgerloom.operators import graph, lineage
from ledgerloom.plans import projection
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(projection.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = projection.QUERIES[name](spark, DATA)
    want = duck.sql(projection.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() == 27 + 776
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_closure_ends_on_cycles_and_empty_tables(spark):
    edges = spark.createDataFrame([("l", 1, 2), ("l", 2, 3), ("l", 3, 1), ("m", 1, 9)], "log_id string, src int, dst int")
    seeds = spark.createDataFrame([("l", 1), ("l", 1)], "log_id string, node int")
    assert sorted(map(tuple, graph.closure(seeds, edges).collect())) == [("l", 1, 0), ("l", 2, 1), ("l", 3, 2)]
    assert graph.closure(seeds.limit(0), edges).count() == 0


def test_descent_order(spark):
    back = spark.createDataFrame(
        [("l", 5, 4, "a", 1), ("l", 5, 3, "b", 0), ("l", 4, 2, "a", 0), ("l", 3, 2, "b", 0)], "log_id string, src int, dst int, via string, ordinal int"
    )
    start = spark.createDataFrame([("l", 5)], "log_id string, start int")
    rows = graph.descents(start, back).orderBy("level", "rank").collect()
    assert [(r["node"], r["via"]) for r in rows] == [(3, "b"), (4, "a"), (2, "b")]


def test_taint_time_takes_the_earliest_way(spark):
    records = spark.createDataFrame([("l", 1, 1, 9), ("l", 2, 2, None), ("l", 3, 12, None), ("l", 4, 3, 5)], "log_id string, id int, time int, ret_time int")
    edges = spark.createDataFrame([("l", 2, 1), ("l", 3, 2), ("l", 2, 4)], "log_id string, src int, dst int")
    assert sorted(map(tuple, graph.taint_times(records, edges).collect())) == [("l", 2, 5), ("l", 3, 12)]


def test_restorations_follow_chains(spark):
    sel = spark.createDataFrame([("l", 1, True, None), ("l", 2, True, 1), ("l", 3, False, 2)], "log_id string, id int, unsound boolean, replaces int")
    assert sorted(map(tuple, lineage.restorations(sel).collect())) == [("l", 1, 3), ("l", 2, 3)]

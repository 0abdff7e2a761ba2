"""Scripted ledgers against their pinned verdicts and answers."""

import duckdb
import pytest

from ledgerloom.functions.canonical import dumps
from ledgerloom.functions.records import Record
from ledgerloom.operators import batteries
from ledgerloom.operators.relational import verify_logs
from ledgerloom.plans import scratch, scripted
from ledgerloom.sources import frames


@pytest.mark.parametrize("name", sorted(scripted.QUERIES))
def test_query_equals_pinned_table(spark, name):
    got, want = scripted.QUERIES[name](spark, ""), duckdb.sql(scripted.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_families_reach_most_reasons():
    reached = {reason for cases in scripted.CASES.values() for _, reason, _ in cases.values()}
    assert len(reached) >= 24 and sum(map(len, scripted.CASES.values())) > 150


def test_relational_rules_judge_every_record_alike(spark):
    """All records of covered kinds, not only the scripts' last ones, against the sequential judge."""
    logs = scripted._all_logs()
    records = scripted.record_table(spark, {n: s.records for n, s in logs.items()})
    rules = spark.createDataFrame([(n, dumps(s.rules.written()).decode()) for n, s in logs.items()], "log_id string, rules_json string")
    got = {(r["log_id"], r["pos"]): r["reason"] for r in batteries.reasons(records, rules, scripted.DIALECT).collect()}
    want = {
        (name, pos): s.ledger.data(s.records[pos + 1])["reason"]
        for name, s in logs.items() for pos in range(0, len(s.records), 2) if s.records[pos].kind in batteries.COVERED
    }
    assert got == want and len(want) > 250


def test_signatures_survive_tables_and_files(spark, tmp_path):
    log = scripted._signed_log()
    rows = scripted.record_table(spark, {"a": log.records}).orderBy("pos").collect()
    assert [Record.from_row(r) for r in rows] == log.records and rows[0]["signature"]["sig"] == log.records[0].signature[1]
    for name in ("x.log", "y.log"):
        (tmp_path / name).write_bytes(b"".join(map(frames.encode, log.records)))
    spark.dataSource.register(frames.FrameLogSource)
    local = spark.read.format("frame_log").option("paths", f"{tmp_path}/x.log,{tmp_path}/y.log").load()
    stored = frames.frame_records(spark.read.format("binaryFile").load(f"{tmp_path}/*.log"))
    for table in (local, stored):
        got = verify_logs(table, log.rules, scripted.DIALECT).select("result", "checked").collect()
        assert [tuple(r) for r in got] == [("Accept", 8)] * 2


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch.scratch_root(Session)
    Session.conf = Conf({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs:///x/"})
    assert scratch.scratch_root(Session) == "hdfs:///x"
    Session.conf = Conf({"spark.master": "local[4]"})
    assert scratch.scratch_root(Session).startswith("file:///")

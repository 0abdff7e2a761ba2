import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import relational
from ledgerloom.operators.judge import replay
from ledgerloom.sources import frames
from ledgerloom.sources.writer import Proposal
from tests.test_ledger import ROLES, SCOPE, THREAD, D, Log, broken_benchmark, rules


def random_log(folder, seed, steps=50):
    rng, log, ids = random.Random(seed), Log(folder), []
    for _ in range(steps):
        pick = lambda: rng.choice(ids) if ids else bytes(32)
        kind, x = rng.choice(["request", "summary", "summary", "retract", "candidate", "evaluate"]), pick()
        source = {"git": {"algo": "sha1", "tree": "ab" * 20, "commit": None}, "manifest_hash": None, "binding": "reported"}
        by, schema, payload, refs = {
            "request": ("human", "request.v1", {"objective": "o", "scope": SCOPE, "attachments": [], "parent_request_id": None}, ()),
            "summary": ("agent", "summary.v1", {"summary_type": "Lesson", "subject": SCOPE, "scope": SCOPE, "claim_payload": b""}, (("Use", x), ("Use", pick()), *([("Require", pick())] if rng.random() < 0.2 else []))),
            "retract": ("human", "retraction.v1", {"target_id": x, "reason": ""}, (("Cause", x),)),
            "candidate": ("agent", "candidate.v1", {"source": source, "basis": "root", "parent": None, "note": None, "artifacts": None}, ()),
            "evaluate": ("host", "evaluation.v1", {"candidate": x, "criterion": "c", "procedure": None, "outcome": "passed"}, (("Use", x),)),
        }[kind]
        ids.append(log.w.commit(Proposal(THREAD, by, ROLES[by], schema, payload, refs)).id)
    return log


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    made = {}
    for seed in range(4):
        made[seed] = random_log(tmp_path_factory.mktemp("log"), seed)
    made[9] = Log(tmp_path_factory.mktemp("log"))
    broken_benchmark(made[9])
    spark.dataSource.register(frames.FrameLogSource)
    table = spark.read.format("frame_log").option("paths", ",".join(m.w.path for m in made.values())).load().cache()
    yield {m.w.path: m.w for m in made.values()}, table
    for m in made.values():
        m.w.close()


def test_relational_state_equals_the_fold(logs):
    writers, table = logs
    rows = relational.ledger(table).select("log_id", "id", "accepted", "ret_time", "taint_time").collect()
    for path, w in writers.items():
        mine = [r for r in rows if r["log_id"] == path]
        s = w.ledger.state
        assert {bytes(r["id"]) for r in mine if r["accepted"]} == s.accepted
        assert {bytes(r["id"]) for r in mine if r["ret_time"] is not None} == s.retracted
        assert {bytes(r["id"]) for r in mine if r["taint_time"] is not None} == s.tainted
    assert any(w.ledger.state.tainted for w in writers.values())


def test_checks_agree_with_the_verdicts(logs):
    writers, table = logs
    judged = relational.ledger(table)
    assert relational.chain_failures(table).count() == 0
    assert relational.evidence_failures(table, judged, D).count() == 0
    failed = {(r["log_id"], bytes(r["id"])): r["reason"] for r in relational.reference_failures(table, judged).collect()}
    stored = {(r["log_id"], bytes(r["id"])): r["reason"] for r in judged.where("not accepted").collect()}
    assert failed.items() <= stored.items()
    assert {k for k, v in stored.items() if v in ("RefUnresolved", "RefCrossSpace")} <= failed.keys() and failed
    assert {r["tainted"] for r in relational.log_heads(table).collect()} == {len(w.ledger.state.tainted) for w in writers.values()}


def test_failures_are_found(logs):
    writers, table = logs
    path = next(iter(writers))
    mine = table.where(F.col("log_id") == path)
    assert [r["pos"] for r in relational.chain_failures(mine.where("pos <> 3")).collect()][:1] == [2]
    weaker = mine.withColumn("evidence", F.when(F.col("pos") == 0, "Assumed").otherwise(F.col("evidence")))
    assert 0 in [r["pos"] for r in relational.evidence_failures(weaker, relational.ledger(weaker), D).collect()]
    got = {r["log_id"]: (r["result"], r["checked"]) for r in relational.verify_logs(table, rules(), D).collect()}
    assert got == {p: ("Accept", len(w.records)) for p, w in writers.items()}
    cut = relational.verify_logs(mine.where("pos < 9"), rules(), D).collect()[0]
    assert (cut["result"], cut["checked"]) == ("Reject", 8)
    w = writers[path]
    bad = [dataclasses.replace(w.records[0], author="x"), *w.records[1:]]
    assert not replay(bad, w.rules, D).accepted

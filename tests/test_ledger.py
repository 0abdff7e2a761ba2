import dataclasses
import json
import os
import random

import pytest

from ledgerloom.functions.records import Receipt, Rules
from ledgerloom.functions.schemas import Dialect
from ledgerloom.operators.judge import acyclic, replay
from ledgerloom.operators.receipts import Limits, Queries, QueryError, validate, validate_receipts, receipt_records
from ledgerloom.sources import frames
from ledgerloom.sources.manifest import Entry, manifest_hash, scan
from ledgerloom.sources.writer import LogError, LogWriter, Proposal, export, head_attestation

D = Dialect("example")
THREAD, SCOPE = bytes([2] * 32), bytes([10] * 32)
ROLES = {"human": "User", "agent": "Provider", "tool": "Executor", "host": "System"}
CORE = {"id": "core", "version": 1, "clauses": [{"id": f"B{i}", "statement": "s"} for i in range(1, 7)]}
DELIVERY = {"id": "delivery", "version": 1, "clauses": [{"id": f"D{i}", "statement": "s"} for i in range(8)]}
SIGNED = {"id": "signed", "version": 1, "clauses": [{"id": f"S{i}", "statement": "s"} for i in range(4)]}
TABLES = {t["id"]: t for t in (CORE, DELIVERY, SIGNED)}


def rules(**more):
    return Rules.default(D, **({"author_roles": dict(ROLES), "admin_retraction_actors": {"human"}} | more))


class Log:
    """Short names for what tests commit."""

    def __init__(self, folder, **more):
        self.w = LogWriter(str(folder), rules(**more.pop("rules", {})), D, **more)

    def put(self, schema, payload, *refs, by="agent", ok=True):
        done = self.w.commit(Proposal(THREAD, by, ROLES.get(by, "Provider"), schema, payload, tuple(refs)))
        if ok is True:
            assert done.reason is None, done
            return done.id
        assert done.reason == ok
        return done.id

    def request(self, parent=None, ok=True):
        refs = [("Cause", parent)] if parent else []
        return self.put("request.v1", {"objective": "o", "scope": SCOPE, "attachments": [], "parent_request_id": parent}, *refs, by="human", ok=ok)

    def candidate(self, basis, *refs, parent=None, ok=True, by="agent", artifacts=None):
        source = {"git": {"algo": "sha1", "tree": "ab" * 20, "commit": None}, "manifest_hash": None, "binding": "reported"}
        return self.put("candidate.v1", {"source": source, "basis": basis, "parent": parent, "note": None, "artifacts": artifacts}, *refs, by=by, ok=ok)

    def evaluation(self, c, outcome="passed", by="host", ok=True):
        return self.put("evaluation.v1", {"candidate": c, "criterion": "bench", "procedure": None, "outcome": outcome}, ("Use", c), by=by, ok=ok)

    def selection(self, considered, winners, uses, objective="adopt-baseline", replaces=None, ok=True):
        refs = [("Use", u) for u in uses] + [("Require", w) for w in winners] + ([("Replace", replaces)] if replaces else [])
        outcome = {"selected": {"candidates": list(winners)}} if winners else "none"
        return self.put("selection.v1", {"objective": objective, "considered": list(considered), "outcome": outcome, "rationale": None}, *refs, ok=ok)

    def retract(self, x, by="human", ok=True):
        return self.put("retraction.v1", {"target_id": x, "reason": "wrong"}, ("Cause", x), by=by, ok=ok)

    def report(self, **more):
        return validate(export(self.w), D, **more)


@pytest.fixture
def log(tmp_path):
    made = Log(tmp_path / "log")
    yield made
    made.w.close()


def broken_benchmark(log):
    n = {"c0": log.candidate("root")}
    n["bench0"] = log.evaluation(n["c0"])
    n["s0"] = log.selection([n["c0"]], [n["c0"]], [n["bench0"]])
    n["c1"] = log.candidate("continuation", ("Cause", n["s0"]), parent=n["c0"])
    n["c2"] = log.candidate("derivation", ("Cause", n["c1"]))
    n["c2b"] = log.candidate("derivation", ("Cause", n["c1"]))
    n["c3"] = log.candidate("derivation", ("Cause", n["c2"]))
    n["c4"] = log.candidate("derivation", ("Cause", n["c0"]), ("Cause", n["bench0"]))
    log.retract(n["bench0"])
    n["c5"] = log.candidate("derivation", ("Cause", n["c3"]))
    n["review0"] = log.put("evaluation.v1", {"candidate": n["c0"], "criterion": "manual-review", "procedure": None, "outcome": "passed"}, ("Use", n["c0"]), by="human")
    n["s1"] = log.selection([n["c0"]], [n["c0"]], [n["review0"]], replaces=n["s0"])
    log.retract(n["c5"], by="host", ok="AuthorRoleInvalid")
    return n


def test_named_queries_on_the_broken_benchmark(log):
    n = broken_benchmark(log)
    name = {v.hex(): k for k, v in n.items()}
    q = log.w.queries()
    ids = lambda nodes: [name[x["id"]] for x in nodes]
    assert [(name[x["id"]], x["via"]) for x in q.descent(n["c5"])] == [
        ("c3", "derivation"), ("c2", "derivation"), ("c1", "derivation"), ("s0", "continuation-anchor"), ("c0", "parent"),
    ]
    s0 = next(x for x in q.descent(n["c5"]) if name[x["id"]] == "s0")
    assert s0["standing"] == "unsound" and s0["tainted"]
    assert ids(q.descent(n["c4"])) == ["c0"]
    assert ids(q.descendants(n["s0"])) == ["c1", "c2", "c2b", "c3", "c5"]
    assert ids(q.descendants(n["c0"])) == ["c1", "c2", "c2b", "c3", "c4", "c5"]
    assert ids(q.siblings(n["c2"])) == ["c2b"]
    assert q.siblings(n["c4"]) == q.siblings(n["c1"]) == q.siblings(n["c0"]) == []
    assert [(name[x["id"]], x["state"]) for x in q.frontier()] == [(c, "unconsidered") for c in ("c1", "c2", "c2b", "c3", "c4", "c5")]
    assert ids(q.standing(n["s0"])["restored_by"]) == ["s1"]
    assert q.standing(n["c2"])["standing"] == "sound"
    assert q.standing(n["bench0"])["standing"] == "n/a" and q.standing(n["bench0"])["retracted"]
    assert [(name[e["id"]], e["criterion"], e["outcome"]) for e in q.evidence(n["s1"])[0]["evaluations"]] == [("review0", "manual-review", "passed")]
    group = q.evidence(n["c3"])[0]
    assert name[group["selection"]["id"]] == "s0" and [(name[e["id"]], e["retracted"]) for e in group["evaluations"]] == [("bench0", True)]
    assert [(name[x["id"]], x["standing"]) for x in q.selected("adopt-baseline")] == [("s0", "unsound"), ("s1", "sound")]
    with pytest.raises(QueryError, match="NotFound"):
        q.descent(bytes(32))
    with pytest.raises(QueryError, match="KindMismatch"):
        q.descent(n["s0"])
    report = log.report()
    assert report.status == "Tainted" and report.standing.unsound == {n["s0"]} and not report.standing.compromised


def test_compromise_spreads_without_a_restoration(log):
    c0 = log.candidate("root")
    e = log.evaluation(c0)
    s = log.selection([c0], [c0], [e])
    c1 = log.candidate("continuation", ("Cause", s), parent=c0)
    c2 = log.candidate("derivation", ("Cause", c1))
    log.retract(e)
    assert log.report().standing.compromised == {c1, c2}


def test_actions_capabilities_and_approvals(log):
    r = log.request()
    action = lambda cls="write", **k: {"request_id": r, "action_class": cls, "scope": SCOPE, "exec_mode": "Internal", "params": {"n": 1.5} | k}
    log.put("action.v1", action(), ok="CapabilityMissing")
    grant = lambda mode, cls="write": log.put("capability.v1", {"actor_id": "agent", "action_class": cls, "scope": SCOPE, "mode": mode, "expiry": None}, by="human")
    auto = grant("Auto", "read")
    log.put("action.v1", action("read"), ok="AuthorityRefMissing")
    a = log.put("action.v1", action("read"), ("Require", auto))
    log.put("response.v1", {"request_id": r, "content": "c", "turn_index": 0, "closes_request": True}, ok="InvalidPayload")  # an action is open
    done = log.put("result.v1", {"action_id": a, "status": "Success", "output": "", "artifacts": None}, ("Cause", a), by="tool")
    log.put("result.v1", {"action_id": a, "status": "Success", "output": "", "artifacts": None}, ("Cause", a), by="tool", ok="ActionClosed")
    ask = grant("Ask")
    log.put("action.v1", action(), ("Require", ask), ok="ApprovalMissing")
    late = log.put("approval.v1", {"target_action": None, "action_class": "write", "scope": SCOPE, "actor_id": "agent", "expiry": 1}, by="human")
    log.put("action.v1", action(), ("Require", ask), ("Require", late), ok="ApprovalExpired")
    from ledgerloom.functions.canonical import canonical_hash

    exact = canonical_hash(["agent", action(k=2)])
    once = log.put("approval.v1", {"target_action": exact, "action_class": None, "scope": SCOPE, "actor_id": "agent", "expiry": None}, by="human")
    log.put("action.v1", action(k=2), ("Require", ask), ("Require", once))
    log.put("action.v1", action(k=2), ("Require", ask), ("Require", once), ok="ApprovalExpired")  # used up; the expired class one is final
    log.put("approval.v1", {"target_action": None, "action_class": None, "scope": SCOPE, "actor_id": None, "expiry": None}, by="human", ok="InvalidPayload")
    log.put("usage.v1", {"actor": "agent", "used_record": r, "consuming_record": done, "role": "input", "outcome": "Done"}, ("Use", r))
    assert log.w.ledger.state.usage == {(r, "input"): {"Done": 1, "NotDone": 0, "NoChange": 0}}
    grant("Deny", "read")
    log.put("action.v1", action("read"), ("Require", auto), ok="CapabilityDenied")
    assert log.report().status == "Clean"


def test_plans_responses_requirements_and_refusals(log):
    r = log.request()
    task = lambda i, status="pending", deps=(): {
        "id": i, "description": "", "kind": "generic", "tool_hint": None, "inputs_from": [], "produces": None, "done_when": "tool_success",
        "status": status, "result_record_id": None, "depends_on": list(deps), "on_failure": "abort",
    }
    plan = lambda tasks, status: {"request_id": r, "tasks": tasks, "status": status}
    log.put("plan.v1", plan([task("a", deps="b"), task("b", deps="a")], "running"), ("Cause", r), ok="InvalidPayload")
    first = log.put("plan.v1", plan([task("a"), task("b", deps="a")], "running"), ("Cause", r))
    log.put("response.v1", {"request_id": r, "content": "", "turn_index": 0, "closes_request": True}, ok="InvalidPayload")
    log.put("plan.v1", plan([task("a", "done"), task("b", "done")], "completed"), ("Cause", r), ("Replace", first))
    log.put("response.v1", {"request_id": r, "content": "", "turn_index": 1, "closes_request": False}, ok="InvalidPayload")
    log.put("response.v1", {"request_id": r, "content": "", "turn_index": 0, "closes_request": False})
    need = lambda key, **k: {"key": key, "description": "d", "required": True, "expected_evidence": None, "provenance": "derived"} | k
    x = log.put("requirement.v1", need("k"), ("Cause", r))
    log.put("requirement.v1", need("k"), ("Cause", r), ok="RequirementInvalid")
    log.put("requirement.v1", need("j", provenance="user_authored"), ("Cause", r), ok="AuthorRoleInvalid")
    log.retract(x)
    y = log.put("requirement.v1", need("k"), ("Cause", r))
    log.retract(x)  # retracting again frees the key that y holds: kept as it is
    log.put("requirement.v1", need("k"), ("Cause", r))
    assert y in log.w.ledger.state.accepted
    log.put("refusal.v1", {"target_id": r, "target_kind": "Request", "reason_code": None}, ("Cause", r), by="human")
    log.put("response.v1", {"request_id": r, "content": "", "turn_index": 1, "closes_request": False}, ok="RequestMissing")


def test_taint_by_use_not_by_cause(log):
    r = log.request()
    cap = log.put("capability.v1", {"actor_id": "agent", "action_class": "x", "scope": SCOPE, "mode": "Auto", "expiry": None}, by="human")
    a = log.put("action.v1", {"request_id": r, "action_class": "x", "scope": SCOPE, "exec_mode": "Internal", "params": None}, ("Require", cap))
    res = log.put("result.v1", {"action_id": a, "status": "Success", "output": "", "artifacts": None}, ("Cause", a), by="tool")
    summary = lambda *refs, ok=True: log.put("summary.v1", {"summary_type": "Lesson", "subject": SCOPE, "scope": SCOPE, "claim_payload": b"x"}, *refs, ok=ok)
    s1 = summary(("Use", res))
    s2 = summary(("Use", s1))
    s3 = summary(("Use", r))
    log.retract(res)
    report = log.report()
    assert report.status == "Tainted" and report.retracted == {res} and report.tainted == {s1, s2} and s3 not in report.tainted
    assert log.w.ledger.evidence(dataclasses.replace(log.w.get(s2))) == 4  # assumed from now on


def test_signatures_and_profiles(tmp_path):
    from ledgerloom.functions import ed25519

    seed = bytes([0x15] * 32)
    keys = {"agent": {ed25519.public_key(seed)}}
    with LogWriter(str(tmp_path / "a"), rules(author_keys=keys), D) as w:
        log = Log.__new__(Log)
        log.w = w
        log.candidate("root", ok="SignatureMissing")
    with LogWriter(str(tmp_path / "b"), rules(author_keys=keys), D, seeds={"agent": seed}) as w:
        log.w = w
        r = log.request()
        need = log.put("requirement.v1", {"key": "k", "description": "d", "required": True, "expected_evidence": None, "provenance": "derived"}, ("Cause", r))
        art = {"scheme": "sha256-bytes", "digest": "ab" * 32, "name": None}
        c = log.candidate("root", ("Cause", r), artifacts=[art])
        verdict = {
            "candidate": c, "criterion": "t", "procedure": None, "outcome": "passed", "basis": "recomputed", "evidence": [art], "requirements": [need],
            "evaluator": {"id": "e", "version": None, "procedure_hash": SCOPE, "input_hash": SCOPE},
        }
        e = log.put("evaluation.v2", verdict, ("Use", c), ("Use", need), by="host")
        log.selection([c], [c], [e])
        report = log.report(profiles=["core", "delivery", "signed", "none"], tables=TABLES)
        got = {p["id"]: p for p in report.profiles}
        assert got["core"]["status"] == got["delivery"]["status"] == "Conformant", got
        assert got["none"]["status"] == "Unknown"
        assert got["signed"]["clauses"] == {"S0": True, "S1": False, "S2": False, "S3": False}
        own = log.put("evaluation.v2", verdict | {"outcome": "failed"}, ("Use", c), ("Use", need), by="agent")
        log.selection([c], [c], [e, own])
        bad = log.report(profiles=["delivery"], tables=TABLES).profiles[0]["clauses"]
        assert (bad["D1"], bad["D2"], bad["D3"], bad["D4"]) == (True, False, True, False)


def test_forged_logs_are_invalid(log):
    broken_benchmark(log)
    records = log.w.records
    ok = replay(records, log.w.rules, D)
    assert ok.accepted and ok.checked == len(records)
    assert replay(records[:-1], log.w.rules, D).reason == "InvalidPayload"
    assert replay(records[2:], log.w.rules, D).checked == 0
    late = [dataclasses.replace(r, author="other") if i == 4 else r for i, r in enumerate(records)]
    assert (replay(late, log.w.rules, D).reason, replay(late, log.w.rules, D).checked) == ("InvalidPayload", 0)
    forged = log.w._verdict(records[4], "Refused")
    assert replay([*records[:5], forged, *records[6:]], log.w.rules, D).reason == "InvalidPayload"
    huge = dataclasses.replace(records[0], time=2**64 - 1)
    assert not replay([huge], log.w.rules, D).accepted


def test_structural_failures(log):
    log.request()
    good = json.loads(export(log.w))
    assert validate(b"{", D).problem.startswith("unparseable")
    assert validate(export(log.w), D, Limits(max_bytes=10)).problem.startswith("receipt exceeds size")
    assert validate(export(log.w), D, Limits(max_records=1)).problem.startswith("receipt exceeds record")
    put = lambda **k: json.dumps(good | k).encode()
    assert validate(put(spec_version="0.2"), D).problem.startswith("unsupported")
    assert validate(put(more=1), D).status == "Invalid"
    twice = [{"id": "core", "version": 1, "hash": [0] * 32}] * 2
    assert validate(put(profiles=twice), D).problem.endswith("more than once")
    declared = validate(put(profiles=twice[:1]), D, tables=TABLES).profiles[0]
    assert declared["declared"] and declared["declaration_matches"] is False
    assert Receipt.from_bytes(export(log.w)).to_bytes() == export(log.w)


def test_writer_recovers_and_compares(tmp_path):
    log = Log(tmp_path)
    with pytest.raises(LogError, match="AlreadyLocked"):
        LogWriter(str(tmp_path), rules(), D)
    log.request()
    head, n = log.w.head, log.w.size
    p = [Proposal(THREAD, "human", "User", "request.v1", {"objective": str(i), "scope": SCOPE, "attachments": [], "parent_request_id": None}) for i in range(3)]
    first = log.w.checked_batch_commit(p, head)
    assert log.w.checked_batch_commit(p, head) == first and len(log.w.records) == 8
    with pytest.raises(LogError, match="HeadConflict"):
        log.w.checked_batch_commit(p[:1], bytes(32))
    assert [r.time for r in log.w.scan(2, 4)] == [2, 3, 4]
    head_attestation(log.w, "2024-02-29T00:00:00Z")
    with pytest.raises(ValueError):
        head_attestation(log.w, "2023-02-29T00:00:00Z")
    log.w.close()
    data = (tmp_path / "log").read_bytes()
    bodies, end = frames.split(data)
    one = 4 + len(bodies[-1])
    (tmp_path / "log").write_bytes(data[: end - one] + b"\x00\x00")  # the last verdict is torn off
    with LogWriter(str(tmp_path), rules(), D) as w:
        assert (tmp_path / "log").read_bytes() == data and len(w.records) == 8
    assert n > 0
    with pytest.raises(frames.FrameError), LogWriter(str(tmp_path), rules(), D, most=100):
        pass


def test_generated_logs_replay(tmp_path):
    rng = random.Random(0xDEADBEEF)
    log = Log(tmp_path)
    ids = []
    for _ in range(60):
        kind = rng.choice(["request", "candidate", "evaluate", "select", "retract", "derive"])
        pick = rng.choice(ids) if ids else bytes(32)
        p = {
            "request": ("human", "request.v1", {"objective": "o", "scope": SCOPE, "attachments": [], "parent_request_id": None}, ()),
            "evaluate": ("host", "evaluation.v1", {"candidate": pick, "criterion": "c", "procedure": None, "outcome": {"scored": {"value": 930, "scale": 3}}}, (("Use", pick),)),
            "retract": ("human", "retraction.v1", {"target_id": pick, "reason": ""}, (("Cause", pick),)),
            "select": ("agent", "selection.v1", {"objective": "o", "considered": [pick], "outcome": "none", "rationale": None}, (("Use", rng.choice(ids or [bytes(32)])),)),
        }.get(kind)
        if p is None:
            source = {"git": {"algo": "sha1", "tree": "ab" * 20, "commit": None}, "manifest_hash": None, "binding": "reported"}
            basis, refs = ("derivation", (("Cause", pick),)) if kind == "derive" else ("root", ())
            p = ("agent", "candidate.v1", {"source": source, "basis": basis, "parent": None, "note": None, "artifacts": None}, refs)
        ids.append(log.w.commit(Proposal(THREAD, p[0], ROLES[p[0]], p[1], p[2], p[3])).id)
    again = replay(log.w.records, log.w.rules, D)
    assert again.accepted
    assert dataclasses.asdict(again.ledger.state)["tainted"] == log.w.ledger.state.tainted
    assert again.ledger.state.requirement_keys == log.w.ledger.state.requirement_keys and again.ledger.state.accepted == log.w.ledger.state.accepted
    log.w.close()


def test_receipts_and_logs_in_spark(spark, log, tmp_path):
    n = broken_benchmark(log)
    rows = [("a", export(log.w)), ("b", b"junk"), ("c", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r for r in validate_receipts(df, D, profiles=("core",), tables=TABLES).collect()}
    assert got["a"]["status"] == "Tainted" and got["a"]["unsound"] == [n["s0"].hex()] and got["a"]["profiles"][0]["met"]
    assert got["b"]["status"] == got["c"]["status"] == "Invalid"
    assert receipt_records(df, "path").groupBy("log_id").count().collect() == [("a", len(log.w.records))]
    spark.dataSource.register(frames.FrameLogSource)
    table = spark.read.format("frame_log").option("paths", log.w.path).load()
    assert table.count() == len(log.w.records) and table.where("kind = 'Retraction'").count() == 2


def test_manifest(tmp_path):
    (tmp_path / "d" / ".git").mkdir(parents=True)
    (tmp_path / "d" / ".git" / "x").write_text("no")
    (tmp_path / "d" / "f").write_text("hi")
    os.symlink("f", tmp_path / "d" / "l")
    found = scan(str(tmp_path))
    assert found == [Entry.file("d/f", b"hi"), Entry.symlink("d/l", b"f")]
    assert manifest_hash(found) == manifest_hash(found[::-1]) and manifest_hash(found * 2) is None


def test_task_graphs():
    assert acyclic({"a": [], "b": ["a", "a"]}) and not acyclic({"a": ["a"]})


def test_queries_refuse_a_rejecting_log(log):
    log.request()
    with pytest.raises(QueryError, match="LogInvalid"):
        Queries(replay(log.w.records[:1], log.w.rules, D))

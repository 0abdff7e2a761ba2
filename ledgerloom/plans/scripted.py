"""Scripted ledgers: small logs whose verdicts, standing and answers are known beforehand.

Each script commits to a log in memory and ends with the record under test; the
expected verdicts stand beside the scripts, as the rules of the ledger give
them, and their SQL is the table of them.  The queries put the scripts' records
into tables and run the library's operators over those.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import ed25519
from ledgerloom.functions.canonical import canonical_hash, dumps
from ledgerloom.functions.records import RECORD_COLUMNS, Record, Rules
from ledgerloom.functions.schemas import SCHEMAS, Dialect
from ledgerloom.operators import batteries
from ledgerloom.operators.judge import Ledger
from ledgerloom.operators.receipts import Limits, Queries, validate_receipts
from ledgerloom.operators.relational import judge_logs, verify_logs
from ledgerloom.sources.writer import Commit, LogWriter, Proposal, export

DIALECT = Dialect("scripted")
THREAD, OTHER, SCOPE = (bytes([b]) * 32 for b in (2, 3, 10))
ROLES = {"ann": "User", "bob": "User", "pat": "Provider", "sys": "System", "exe": "Executor"}
SEEDS = {"pat": bytes([21]) * 32, "exe": bytes([22]) * 32}
ART = {"scheme": "sha256-bytes", "digest": "ab" * 32, "name": None}


def pinned(*names: str) -> dict[str, Any]:
    return {"author_keys": {n: {ed25519.public_key(SEEDS[n])} for n in names}}


class Script(LogWriter):
    """A log in memory, with short names for what scripts commit."""

    def __init__(self, **rules: Any):
        self.rules = Rules.default(DIALECT, **({"author_roles": dict(ROLES), "admin_retraction_actors": {"ann"}} | rules))
        self.dialect, self.seeds, self.rules_hash = DIALECT, {}, self.rules.hash()
        self.records, self.size, self.most, self.path, self.broken = [], 0, 1 << 40, "", False
        self.ledger = Ledger(self.rules, DIALECT)

    def _append(self, records: list[Record]) -> None:
        pass

    def close(self) -> None:
        pass

    def put(self, schema: str, data: dict[str, Any], *refs: tuple[str, bytes], by: str = "pat", role: str | None = None, thread: bytes = THREAD) -> bytes:
        return self.commit(Proposal(thread, by, role or ROLES[by], schema, data, refs)).id

    def raw(self, change: Callable[[Record], Record], schema: str, data: dict[str, Any], *refs: tuple[str, bytes], by: str = "pat", new_id: bool = True) -> Commit:
        """A record that no proposal would make."""
        r = change(self.build(Proposal(THREAD, by, ROLES[by], schema, data, refs)))
        if new_id:
            r = dataclasses.replace(r, id=r.computed_id())
        reason = self.ledger.judge(r)
        self._take(r, self._verdict(r, reason), reason)
        return Commit(r.id, r.time, "Reject" if reason else "Accept", reason)

    def request(self, by: str = "ann", parent: bytes | None = None, **k: Any) -> bytes:
        refs = [("Cause", parent)] if parent else []
        return self.put("request.v1", {"objective": "build", "scope": SCOPE, "attachments": [], "parent_request_id": parent}, *refs, by=by, **k)

    def grant(self, mode: str = "Auto", cls: str = "write", expiry: int | None = None, *refs: tuple[str, bytes], by: str = "ann") -> bytes:
        return self.put("capability.v1", {"actor_id": "pat", "action_class": cls, "scope": SCOPE, "mode": mode, "expiry": expiry}, *refs, by=by)

    def action_data(self, request: bytes, cls: str = "write", mode: str = "Internal", params: Any = None, scope: bytes = SCOPE) -> dict[str, Any]:
        return {"request_id": request, "action_class": cls, "scope": scope, "exec_mode": mode, "params": params}

    def action(self, request: bytes, *need: bytes, thread: bytes = THREAD, **k: Any) -> bytes:
        return self.put("action.v1", self.action_data(request, **k), *(("Require", x) for x in need), thread=thread)

    def approve(self, exact: bytes | None = None, cls: str | None = None, actor: str | None = "pat", expiry: int | None = None, *refs: tuple[str, bytes], by: str = "ann") -> bytes:
        return self.put("approval.v1", {"target_action": exact, "action_class": cls, "scope": SCOPE, "actor_id": actor, "expiry": expiry}, *refs, by=by)

    def result(self, action: bytes, schema: str = "result.v1", by: str = "exe", artifacts: Any = None, cause: bytes | None = None) -> bytes:
        return self.put(schema, {"action_id": action, "status": "Success", "output": "", "artifacts": artifacts}, ("Cause", cause or action), by=by)

    def respond(self, request: bytes, turn: int = 0, closes: bool = False) -> bytes:
        return self.put("response.v1", {"request_id": request, "content": "", "turn_index": turn, "closes_request": closes})

    def refuse(self, target: bytes, kind: str, by: str = "ann") -> bytes:
        return self.put("refusal.v1", {"target_id": target, "target_kind": kind, "reason_code": None}, ("Cause", target), by=by)

    def summary(self, *refs: tuple[str, bytes], type_: str = "Lesson") -> bytes:
        return self.put("summary.v1", {"summary_type": type_, "subject": SCOPE, "scope": SCOPE, "claim_payload": b"x"}, *refs)

    def retract(self, x: bytes, by: str = "ann") -> bytes:
        return self.put("retraction.v1", {"target_id": x, "reason": ""}, ("Cause", x), by=by)

    def plan(self, request: bytes, status: str, *tasks: dict[str, Any], refs: tuple = ()) -> bytes:
        return self.put("plan.v1", {"request_id": request, "tasks": list(tasks), "status": status}, ("Cause", request), *refs)

    def candidate(self, basis: str = "root", *refs: tuple[str, bytes], parent: bytes | None = None, artifacts: Any = None, source: dict | None = None, by: str = "pat", role: str | None = None) -> bytes:
        git = {"git": {"algo": "sha1", "tree": "cd" * 20, "commit": None}, "manifest_hash": None, "binding": "reported"}
        return self.put("candidate.v1", {"source": git | (source or {}), "basis": basis, "parent": parent, "note": None, "artifacts": artifacts}, *refs, by=by, role=role)

    def evaluate(self, c: bytes, outcome: Any = "passed", by: str = "sys", use: bool = True, role: str | None = None, criterion: str = "bench") -> bytes:
        return self.put("evaluation.v1", {"candidate": c, "criterion": criterion, "procedure": None, "outcome": outcome}, *([("Use", c)] if use else []), by=by, role=role)

    def evaluate2(self, c: bytes, needs: tuple[bytes, ...] = (), used: tuple[bytes, ...] | None = None, schema: str = "evaluation.v2", by: str = "sys", **k: Any) -> bytes:
        data = {
            "candidate": c, "criterion": "gate", "procedure": None, "outcome": "passed", "basis": "recomputed", "evidence": [ART], "requirements": list(needs),
            "evaluator": {"id": "e", "version": None, "procedure_hash": SCOPE, "input_hash": SCOPE},
        } | k
        return self.put(schema, data, *(("Use", x) for x in (c, *(needs if used is None else used))), by=by)

    def select_data(self, considered: list[bytes], winners: list[bytes], objective: str = "adopt") -> dict[str, Any]:
        outcome = {"selected": {"candidates": winners}} if winners else "none"
        return {"objective": objective, "considered": considered, "outcome": outcome, "rationale": None}

    def select(self, considered: list[bytes], winners: list[bytes], uses: list[bytes] = (), need: list[bytes] | None = None, replaces: bytes | None = None, objective: str = "adopt", by: str = "pat", role: str | None = None) -> bytes:
        refs = [("Use", x) for x in uses] + [("Require", x) for x in (winners if need is None else need)] + ([("Replace", replaces)] if replaces else [])
        return self.put("selection.v1", self.select_data(list(considered), list(winners), objective), *refs, by=by, role=role)

    def require(self, request: bytes | None, key: str = "k", provenance: str = "derived", by: str = "pat", *refs: tuple[str, bytes]) -> bytes:
        cause = [("Cause", request)] if request else []
        return self.put("requirement.v1", {"key": key, "description": "d", "required": True, "expected_evidence": None, "provenance": provenance}, *cause, *refs, by=by)

    def basis(self) -> tuple[bytes, bytes]:
        """A request and a capability to write."""
        return self.request(), self.grant()

    def chosen(self) -> tuple[bytes, bytes, bytes]:
        """A candidate, its evaluation and a selection of it."""
        c = self.candidate()
        e = self.evaluate(c)
        return c, e, self.select([c], [c], [e])


def task(name: str, status: str = "pending", after: tuple[str, ...] = (), result: bytes | None = None) -> dict[str, Any]:
    return {
        "id": name, "description": "", "kind": "generic", "tool_hint": None, "inputs_from": [], "produces": None, "done_when": "tool_success",
        "status": status, "result_record_id": result, "depends_on": list(after), "on_failure": "abort",
    }


#: family -> case -> (script, expected reason or None, rules)
CASES: dict[str, dict[str, tuple[Callable[[Script], Any], str | None, dict[str, Any]]]] = {}


def case(family: str, reason: str | None = None, **rules: Any):
    """Register a script whose last record is accepted, or rejected for ``reason``."""

    def keep(script: Callable[[Script], Any]) -> Callable[[Script], Any]:
        CASES.setdefault(family, {})[script.__name__] = (script, reason, rules)
        return script

    return keep


# -- the record itself: identity, schema, author, signature, references, evidence --------------------


@case("common")
def plain_request(s): s.request()  # noqa: E704


@case("common")
def free_numbers(s):
    r, g = s.basis()
    s.action(r, g, params=json.loads('{"a": 0.1, "b": 4.11e46, "c": 1e-7, "d": -0.0, "e": 5e-324, "f": 3.0, "g": [true, null, "\\u00e9"]}'))


@case("common", "InvalidPayload")
def other_id(s): s.raw(lambda r: dataclasses.replace(r, id=bytes(32)), "request.v1", _request(), by="ann", new_id=False)  # noqa: E704


@case("common", "InvalidPayload")
def references_out_of_order(s):
    a, b = sorted([s.request(), s.request()])
    s.raw(lambda r: dataclasses.replace(r, refs=(("Use", b), ("Use", a))), "summary.v1", _summary(), ("Use", a), ("Use", b))


@case("common", "InvalidPayload")
def same_reference_twice(s):
    a = s.request()
    s.raw(lambda r: dataclasses.replace(r, refs=(("Use", a), ("Use", a))), "summary.v1", _summary(), ("Use", a))


@case("common", "InvalidPayload")
def another_space(s): s.raw(lambda r: dataclasses.replace(r, space=bytes(32)), "request.v1", _request(), by="ann")  # noqa: E704


@case("common", "UnknownSchema")
def schema_nobody_knows(s): s.raw(lambda r: dataclasses.replace(r, schema=bytes(32)), "request.v1", _request(), by="ann")  # noqa: E704


@case("common", "KindSchemaMismatch")
def kind_of_another_schema(s): s.raw(lambda r: dataclasses.replace(r, kind="Capability"), "request.v1", _request(), by="ann")  # noqa: E704


@case("common", "AuthorRoleInvalid")
def kind_not_for_the_role(s): s.request(by="pat")  # noqa: E704


@case("common", "AuthorRoleInvalid")
def author_nobody_registered(s): s.put("request.v1", _request(), by="eve", role="User")  # noqa: E704


@case("common", "AuthorRoleInvalid")
def author_in_another_role(s): s.put("request.v1", _request(), by="pat", role="User")  # noqa: E704


@case("common", "SignatureMissing", signature_required_kinds={"Candidate"})
def unsigned_where_signing_is_asked(s): s.candidate()  # noqa: E704


@case("common", "SignatureMissing", **pinned("pat"))
def unsigned_by_a_pinned_author(s): s.candidate()  # noqa: E704


@case("common", None, **pinned("pat"))
def signed_by_a_pinned_author(s):
    s.seeds = SEEDS
    s.candidate()


@case("common", "SignatureInvalid", **pinned("pat"))
def signed_with_another_key(s):
    s.seeds = {"pat": SEEDS["exe"]}
    s.candidate()


@case("common", "SignatureInvalid", **pinned("pat"))
def signature_of_other_bytes(s):
    s.seeds = SEEDS
    s.raw(lambda r: dataclasses.replace(r, signature=(r.signature[0], bytes(64))), "candidate.v1", _candidate())


@case("common", "RefUnresolved")
def reference_to_nothing(s): s.summary(("Use", bytes([9]) * 32))  # noqa: E704


@case("common", "RefUnresolved")
def require_of_a_rejected_record(s):
    bad = s.request(by="pat")
    s.summary(("Require", bad))


@case("common", "RefUnresolved")
def require_of_a_retracted_record(s):
    r = s.request()
    s.retract(r)
    s.summary(("Use", s.request()), ("Require", r))


@case("common", "RefUnresolved")
def require_of_a_tainted_record(s):
    r = s.request()
    x = s.summary(("Use", r))
    s.retract(r)
    s.summary(("Use", s.request()), ("Require", x))


@case("common")
def cause_of_a_retracted_record(s):
    r = s.request()
    s.retract(r)
    s.request(parent=r)


@case("common", "InvalidPayload")
def two_replacements(s):
    a, b = s.grant(), s.grant(cls="read")
    s.grant("Ask", "write", None, ("Replace", a), ("Replace", b))


@case("common", "ReplacementInvalid")
def replacement_by_another_kind(s):
    a = s.grant()
    s.summary(("Use", s.request()), ("Replace", a))


@case("common", "ReplacementInvalid")
def replacement_of_another_slot(s):
    a = s.grant()
    s.grant("Ask", "read", None, ("Replace", a))


@case("common")
def replacement_of_a_capability(s):
    a = s.grant()
    s.grant("Ask", "write", None, ("Replace", a))


@case("common", "InvalidPayload")
def evidence_too_good(s): s.raw(lambda r: dataclasses.replace(r, evidence="Verified"), "request.v1", _request(), by="ann")  # noqa: E704


@case("common", "EvidenceBelowThreshold", evidence_thresholds={"Request": "Verified"})
def evidence_below_the_threshold(s): s.request()  # noqa: E704


@case("common", "InvalidPayload")
def payload_with_spaces(s): s.raw(lambda r: dataclasses.replace(r, data=r.data.replace(b":", b": ", 1)), "request.v1", _request(), by="ann")  # noqa: E704


@case("common", "InvalidPayload")
def payload_with_one_field_more(s): s.raw(lambda r: dataclasses.replace(r, data=r.data[:-1] + b',"z":1}'), "request.v1", _request(), by="ann")  # noqa: E704


@case("common", "InvalidPayload")
def payload_that_is_no_json(s): s.raw(lambda r: dataclasses.replace(r, data=b"{"), "request.v1", _request(), by="ann")  # noqa: E704


# -- requests, actions, results ----------------------------------------------------------------------


@case("actions")
def child_request(s): s.request(parent=s.request())  # noqa: E704


@case("actions", "InvalidPayload")
def child_without_its_cause(s):
    r = s.request()
    s.put("request.v1", _request() | {"parent_request_id": r}, by="ann")


@case("actions", "RequestMissing")
def child_of_a_rejected_request(s): s.request(parent=_rejected_request(s))  # noqa: E704


@case("actions")
def action_under_a_capability(s):
    r, g = s.basis()
    s.action(r, g)


@case("actions", "RequestMissing")
def action_without_a_request(s):
    _, g = s.basis()
    s.action(bytes([7]) * 32, g)


@case("actions", "RequestMissing")
def action_of_another_thread(s):
    r, g = s.basis()
    s.action(r, g, thread=OTHER)


@case("actions", "RequestMissing")
def action_after_the_request_closed(s):
    r, g = s.basis()
    s.respond(r, 0, True)
    s.action(r, g)


@case("actions", "InvalidPayload")
def action_in_another_scope(s):
    r, g = s.basis()
    s.action(r, g, scope=bytes([11]) * 32)


@case("actions", "CapabilityMissing")
def action_without_a_capability(s): s.action(s.request())  # noqa: E704


@case("actions", "CapabilityMissing")
def action_under_a_retracted_capability(s):
    r, g = s.basis()
    s.retract(g)
    s.action(r)


@case("actions", "CapabilityMissing")
def action_under_an_expired_capability(s):
    r, g = s.request(), s.grant(expiry=5)
    s.action(r, g)


@case("actions", "CapabilityDenied")
def action_that_is_denied(s):
    r, g = s.request(), s.grant("Deny")
    s.action(r, g)


@case("actions", "AuthorityRefMissing")
def action_that_names_no_authority(s):
    r, _ = s.basis()
    s.action(r)


@case("actions", "ApprovalMissing")
def action_to_be_approved(s):
    r, g = s.request(), s.grant("Ask")
    s.action(r, g)


@case("actions", "AuthorityRefMissing")
def action_that_names_no_approval(s):
    r, g = s.request(), s.grant("Ask")
    s.approve(cls="write")
    s.action(r, g)


@case("actions")
def action_with_an_approved_class(s):
    r, g = s.request(), s.grant("Ask")
    s.action(r, g, s.approve(cls="write"))


@case("actions")
def action_with_a_class_approved_for_all(s):
    r, g = s.request(), s.grant("Ask")
    s.action(r, g, s.approve(cls="write", actor=None))


@case("actions", "ApprovalExpired")
def action_with_an_expired_approval(s):
    r, g = s.request(), s.grant("Ask")
    s.action(r, g, s.approve(cls="write", expiry=7))


@case("actions")
def action_approved_exactly(s):
    r, g = s.request(), s.grant("Ask")
    s.action(r, g, s.approve(canonical_hash(["pat", s.action_data(r)])))


@case("actions", "ApprovalMissing")
def exact_approval_used_twice(s):
    r, g = s.request(), s.grant("Ask")
    a = s.approve(canonical_hash(["pat", s.action_data(r)]))
    s.action(r, g, a)
    s.action(r, g, a)


@case("actions", "ApprovalMissing")
def exact_approval_of_another_actor(s):
    r, g = s.request(), s.grant("Ask")
    s.action(r, g, s.approve(canonical_hash(["pat", s.action_data(r)]), actor="sys"))


@case("actions", "InvalidPayload")
def approval_of_both_kinds(s): s.approve(SCOPE, "write")  # noqa: E704


@case("actions", "InvalidPayload")
def exact_approval_without_an_actor(s): s.approve(SCOPE, actor=None)  # noqa: E704


@case("actions")
def result_of_an_action(s):
    r, g = s.basis()
    s.result(s.action(r, g))


@case("actions", "ActionClosed")
def second_result(s):
    r, g = s.basis()
    a = s.action(r, g)
    s.result(a)
    s.result(a)


@case("actions", "InvalidPayload")
def result_with_another_cause(s):
    r, g = s.basis()
    s.result(s.action(r, g), cause=r)


@case("actions", "ExternalReceiptRequired")
def plain_result_of_an_external_action(s):
    r, g = s.basis()
    s.result(s.action(r, g, mode="External"))


@case("actions", "SignatureMissing")
def unsigned_external_receipt(s):
    r, g = s.basis()
    s.result(s.action(r, g, mode="External"), "result.external_receipt.v1")


@case("actions", "SignatureInvalid")
def external_receipt_of_an_unpinned_author(s):
    r, g = s.basis()
    a = s.action(r, g, mode="External")
    s.seeds = SEEDS
    s.result(a, "result.external_receipt.v1")


@case("actions", None, **pinned("exe"))
def external_receipt(s):
    r, g = s.basis()
    a = s.action(r, g, mode="External")
    s.seeds = SEEDS
    s.result(a, "result.external_receipt.v1")


@case("actions", "InvalidPayload", **pinned("exe"))
def external_receipt_of_an_internal_action(s):
    r, g = s.basis()
    a = s.action(r, g)
    s.seeds = SEEDS
    s.result(a, "result.external_receipt.v1")


@case("actions")
def result_with_artifacts(s):
    r, g = s.basis()
    s.result(s.action(r, g), artifacts=[ART])


@case("actions", "ArtifactRefInvalid")
def result_with_half_a_byte(s):
    r, g = s.basis()
    s.result(s.action(r, g), artifacts=[ART | {"digest": "abc"}])


@case("actions")
def refused_action(s):
    r, g = s.basis()
    s.refuse(s.action(r, g), "Action")


@case("actions", "ActionClosed")
def refusal_after_the_result(s):
    r, g = s.basis()
    a = s.action(r, g)
    s.result(a)
    s.refuse(a, "Action")


@case("actions", "InvalidPayload")
def refusal_of_the_wrong_kind(s): s.refuse(s.request(), "Action")  # noqa: E704


@case("actions", "RequestMissing")
def refusal_of_a_closed_request(s):
    r = s.request()
    s.respond(r, 0, True)
    s.refuse(r, "Request")


@case("actions")
def refused_effect(s):
    r, g = s.basis()
    s.refuse(s.result(s.action(r, g), "result.effect_confirmation.v1"), "VerifiedEffect")


@case("actions", "InvalidPayload")
def refused_effect_of_a_plain_result(s):
    r, g = s.basis()
    s.refuse(s.result(s.action(r, g)), "VerifiedEffect")


@case("actions")
def counted_use(s):
    r, g = s.basis()
    done = s.result(s.action(r, g))
    s.put("usage.v1", {"actor": "pat", "used_record": r, "consuming_record": done, "role": "in", "outcome": "Done"}, ("Use", r))


@case("actions", "InvalidPayload")
def use_counted_for_another(s):
    r, g = s.basis()
    done = s.result(s.action(r, g))
    s.put("usage.v1", {"actor": "sys", "used_record": r, "consuming_record": done, "role": "in", "outcome": "Done"}, ("Use", r))


@case("actions", "InvalidPayload")
def use_without_its_reference(s):
    r, g = s.basis()
    done = s.result(s.action(r, g))
    s.put("usage.v1", {"actor": "pat", "used_record": r, "consuming_record": done, "role": "in", "outcome": "Done"})


@case("actions", "InvalidPayload")
def use_by_a_request(s):
    r = s.request()
    s.put("usage.v1", {"actor": "pat", "used_record": r, "consuming_record": r, "role": "in", "outcome": "Done"}, ("Use", r))


# -- turns, summaries, plans, retractions ------------------------------------------------------------


@case("turns")
def first_response(s): s.respond(s.request())  # noqa: E704


@case("turns", "InvalidPayload")
def skipped_turn(s): s.respond(s.request(), 1)  # noqa: E704


@case("turns", "InvalidPayload")
def closing_over_an_open_action(s):
    r, g = s.basis()
    s.action(r, g)
    s.respond(r, 0, True)


@case("turns", "InvalidPayload")
def closing_over_a_running_plan(s):
    r = s.request()
    s.plan(r, "running", task("a"))
    s.respond(r, 0, True)


@case("turns", "RequestMissing")
def response_after_the_last(s):
    r = s.request()
    s.respond(r, 0, True)
    s.respond(r, 1)


@case("turns")
def summary_of_a_request(s): s.summary(("Use", s.request()))  # noqa: E704


@case("turns", "InvalidPayload")
def summary_of_nothing(s): s.summary()  # noqa: E704


@case("turns", "InvalidPayload", allowed_summary_types={"Pattern"})
def summary_of_a_type_not_allowed(s): s.summary(("Use", s.request()))  # noqa: E704


@case("turns")
def ordered_plan(s): s.plan(s.request(), "running", task("a"), task("b", after=("a",)))  # noqa: E704


@case("turns", "InvalidPayload")
def circular_plan(s): s.plan(s.request(), "running", task("a", after=("b",)), task("b", after=("a",)))  # noqa: E704


@case("turns", "InvalidPayload")
def plan_with_a_name_twice(s): s.plan(s.request(), "running", task("a"), task("a"))  # noqa: E704


@case("turns", "InvalidPayload")
def plan_without_tasks(s): s.plan(s.request(), "running")  # noqa: E704


@case("turns", "InvalidPayload")
def plan_on_an_unknown_task(s): s.plan(s.request(), "running", task("a", after=("z",)))  # noqa: E704


@case("turns", "InvalidPayload")
def completed_plan_with_work_left(s): s.plan(s.request(), "completed", task("a", "done"), task("b"))  # noqa: E704


@case("turns")
def abandoned_plan(s): s.plan(s.request(), "abandoned", task("a", "done"), task("b", "skipped"))  # noqa: E704


@case("turns")
def plan_with_a_result(s):
    r, g = s.basis()
    done = s.result(s.action(r, g))
    s.plan(r, "completed", task("a", "done", result=done))


@case("turns", "InvalidPayload")
def pending_task_with_a_result(s):
    r, g = s.basis()
    done = s.result(s.action(r, g))
    s.plan(r, "running", task("a", "pending", result=done))


@case("turns", "InvalidPayload")
def task_with_another_requests_result(s):
    r, g = s.basis()
    done = s.result(s.action(r, g))
    s.plan(s.request(), "completed", task("a", "done", result=done))


@case("turns", "ReplacementInvalid")
def plan_for_another_request(s):
    old = s.plan(s.request(), "running", task("a"))
    s.plan(s.request(), "running", task("a"), refs=(("Replace", old),))


@case("turns")
def own_retraction(s): s.retract(s.request("bob"), by="bob")  # noqa: E704


@case("turns")
def retraction_by_an_admin(s): s.retract(s.candidate())  # noqa: E704


@case("turns", "AuthorRoleInvalid")
def retraction_of_anothers(s): s.retract(s.candidate(), by="bob")  # noqa: E704


@case("turns", "InvalidPayload")
def retraction_of_a_retraction(s): s.retract(s.retract(s.request()))  # noqa: E704


@case("turns", "InvalidPayload")
def retraction_of_a_rejected_record(s): s.retract(_rejected_request(s))  # noqa: E704


@case("turns", "InvalidPayload")
def retraction_of_a_verdict(s):
    s.request()
    s.retract(s.records[-1].id)


# -- requirements ------------------------------------------------------------------------------------


@case("requirements")
def required_by_a_user(s): s.require(s.request(), provenance="user_authored", by="ann")  # noqa: E704


@case("requirements")
def derived_requirement(s): s.require(s.request())  # noqa: E704


@case("requirements", "AuthorRoleInvalid")
def users_word_by_a_provider(s): s.require(s.request(), provenance="user_authored")  # noqa: E704


@case("requirements", "AuthorRoleInvalid")
def derived_by_a_user(s): s.require(s.request(), by="ann")  # noqa: E704


@case("requirements", "AuthorRoleInvalid")
def required_by_an_executor(s): s.require(s.request(), by="exe")  # noqa: E704


@case("requirements", "RequirementInvalid")
def key_used_twice(s):
    r = s.request()
    s.require(r)
    s.require(r)


@case("requirements")
def key_free_after_retraction(s):
    r = s.request()
    s.retract(s.require(r))
    s.require(r)


@case("requirements")
def key_of_another_request(s):
    s.require(s.request())
    s.require(s.request())


@case("requirements", "RequirementInvalid")
def empty_key(s): s.require(s.request(), "")  # noqa: E704


@case("requirements", "RequirementInvalid")
def requirement_of_nothing(s): s.require(None)  # noqa: E704


@case("requirements", "RequirementInvalid")
def requirement_of_a_candidate(s): s.require(s.candidate())  # noqa: E704


@case("requirements", "ReplacementInvalid")
def replaced_requirement(s):
    r = s.request()
    x = s.require(r)
    s.require(r, "j", "derived", "pat", ("Replace", x))


# -- candidates, evaluations, selections -------------------------------------------------------------


@case("lines")
def root(s): s.candidate()  # noqa: E704


@case("lines")
def root_of_a_request(s): s.candidate("root", ("Cause", s.request()))  # noqa: E704


@case("lines", "AuthorRoleInvalid")
def candidate_of_a_stranger(s): s.candidate(by="eve", role="Provider")  # noqa: E704


@case("lines", "SourceBindingInvalid")
def manifest_without_its_hash(s): s.candidate(source={"binding": "manifest"})  # noqa: E704


@case("lines", "SourceBindingInvalid")
def short_tree(s): s.candidate(source={"git": {"algo": "sha256", "tree": "cd" * 20, "commit": None}})  # noqa: E704


@case("lines")
def candidate_with_artifacts(s): s.candidate(artifacts=[ART, ART | {"name": "x"}])  # noqa: E704


@case("lines", "ArtifactRefInvalid")
def digest_of_another_length(s): s.candidate(artifacts=[ART | {"digest": "ab" * 20}])  # noqa: E704


@case("lines", "ArtifactRefInvalid")
def digest_in_capitals(s): s.candidate(artifacts=[ART | {"digest": "AB" * 32}])  # noqa: E704


@case("lines", "ArtifactRefInvalid")
def scheme_that_is_no_token(s): s.candidate(artifacts=[ART | {"scheme": "Sha 256"}])  # noqa: E704


@case("lines", "ArtifactRefInvalid")
def artifacts_out_of_order(s): s.candidate(artifacts=[ART | {"name": "x"}, ART])  # noqa: E704


@case("lines", "ArtifactRefInvalid")
def artifact_twice(s): s.candidate(artifacts=[ART, ART])  # noqa: E704


@case("lines", "ArtifactRefInvalid")
def short_digest_of_a_scheme_of_ones_own(s): s.candidate(artifacts=[ART | {"scheme": "own", "digest": "ab" * 19}])  # noqa: E704


@case("lines", "LineageInvalid")
def root_with_a_parent(s):
    c = s.candidate()
    s.candidate("root", parent=c)


@case("lines", "PayloadRefUnresolved")
def parent_that_is_no_candidate(s):
    c, e, x = s.chosen()
    s.candidate("continuation", ("Cause", x), parent=e)


@case("lines")
def continuation(s):
    c, _, x = s.chosen()
    s.candidate("continuation", ("Cause", x), parent=c)


@case("lines", "LineageInvalid")
def continuation_of_a_loser(s):
    c, d = s.candidate(), s.candidate(source={"git": {"algo": "sha1", "tree": "ef" * 20, "commit": None}})
    e = s.evaluate(c)
    x = s.select([c, d], [c], [e])
    s.candidate("continuation", ("Cause", x), parent=d)


@case("lines", None)
def continuation_of_an_unsound_choice(s):
    c, e, x = s.chosen()
    s.retract(e)
    s.candidate("continuation", ("Cause", x), parent=c)


@case("lines", "LineageInvalid", reject_compromised_continuation=True)
def continuation_of_an_unsound_choice_refused(s):
    c, e, x = s.chosen()
    s.retract(e)
    s.candidate("continuation", ("Cause", x), parent=c)


@case("lines")
def derivation(s): s.candidate("derivation", ("Cause", s.candidate()))  # noqa: E704


@case("lines", "LineageInvalid")
def derivation_of_nothing(s): s.candidate("derivation")  # noqa: E704


@case("lines", "LineageInvalid")
def derivation_of_a_selection(s): s.candidate("derivation", ("Cause", s.chosen()[2]))  # noqa: E704


@case("lines")
def scored(s): s.evaluate(s.candidate(), {"scored": {"value": 93, "scale": 2}})  # noqa: E704


@case("lines", "AuthorRoleInvalid")
def evaluation_in_another_role(s): s.evaluate(s.candidate(), by="sys", role="Executor")  # noqa: E704


@case("lines", "EvaluationInvalid")
def evaluation_without_use(s): s.evaluate(s.candidate(), use=False)  # noqa: E704


@case("lines", "PayloadRefUnresolved")
def evaluation_of_a_request(s): s.evaluate(s.request())  # noqa: E704


@case("lines")
def full_evaluation(s):
    q = s.require(s.request())
    s.evaluate2(s.candidate(), (q,))


@case("lines")
def blocked_evaluation(s): s.evaluate2(s.candidate(), outcome="blocked")  # noqa: E704


@case("lines", "EvaluationInvalid")
def nameless_evaluator(s): s.evaluate2(s.candidate(), evaluator={"id": "", "version": None, "procedure_hash": None, "input_hash": None})  # noqa: E704


@case("lines", "EvaluationInvalid")
def requirement_that_is_not_used(s):
    q = s.require(s.request())
    s.evaluate2(s.candidate(), (q,), ())


@case("lines", "EvaluationInvalid")
def requirement_that_is_none(s):
    r = s.request()
    s.evaluate2(s.candidate(), (r,))


@case("lines", "EvaluationInvalid")
def requirements_out_of_order(s):
    r = s.request()
    s.evaluate2(s.candidate(), tuple(sorted([s.require(r, "a"), s.require(r, "b")], reverse=True)))


@case("lines", "ArtifactRefInvalid")
def malformed_evidence(s): s.evaluate2(s.candidate(), evidence=[ART | {"digest": "zz"}])  # noqa: E704


@case("lines", None, **pinned("exe"))
def attested(s):
    c = s.candidate()
    s.seeds = SEEDS
    s.evaluate2(c, schema="evaluation.attested.v1", by="exe")


@case("lines", "SignatureMissing")
def attested_unsigned(s): s.evaluate2(s.candidate(), schema="evaluation.attested.v1", by="exe")  # noqa: E704


@case("lines", "SignatureInvalid")
def attested_by_an_unpinned_author(s):
    c = s.candidate()
    s.seeds = SEEDS
    s.evaluate2(c, schema="evaluation.attested.v1", by="exe")


@case("choices")
def choice(s): s.chosen()  # noqa: E704


@case("choices")
def choice_of_none(s):
    c = s.candidate()
    s.select([c], [], [s.evaluate(c)])


@case("choices", "AuthorRoleInvalid")
def choice_by_an_executor(s):
    c = s.candidate()
    s.select([c], [c], [s.evaluate(c)], by="exe")


@case("choices", "SelectionInvalid")
def nothing_considered(s): s.select([], [])  # noqa: E704


@case("choices", "SelectionInvalid")
def winner_that_is_not_required(s):
    c = s.candidate()
    s.select([c], [c], [s.evaluate(c)], need=[])


@case("choices", "SelectionInvalid")
def none_that_requires(s):
    c = s.candidate()
    s.select([c], [], [s.evaluate(c)], need=[c])


@case("choices", "SelectionInvalid")
def choice_without_evaluation(s):
    c = s.candidate()
    s.select([c], [c])


@case("choices", None, selection_requires_evaluation=False)
def choice_without_evaluation_allowed(s):
    c = s.candidate()
    s.select([c], [c])


@case("choices", "SelectionInvalid")
def evaluation_of_one_not_considered(s):
    c, d = s.candidate(), s.candidate(source={"git": {"algo": "sha1", "tree": "ef" * 20, "commit": None}})
    s.select([c], [c], [s.evaluate(d)])


@case("choices", "SelectionInvalid", evidence_thresholds={})
def rejected_evaluation_counts_nothing(s):
    c = s.candidate()
    s.select([c], [c], [s.evaluate(c, use=False)])


@case("choices", "SelectionInvalid", max_considered=1)
def too_many_considered(s):
    c, d = s.candidate(), s.candidate(source={"git": {"algo": "sha1", "tree": "ef" * 20, "commit": None}})
    s.select([c, d], [c], [s.evaluate(c)])


@case("choices", "SelectionInvalid", min_binding="manifest")
def binding_too_weak(s): s.chosen()  # noqa: E704


@case("choices")
def reaffirmed(s):
    c, e, x = s.chosen()
    s.retract(e)
    s.select([c], [c], [s.evaluate(c, by="ann")], replaces=x)


@case("choices", "ReaffirmationInvalid")
def reaffirmed_for_another_objective(s):
    c, e, x = s.chosen()
    s.select([c], [c], [e], replaces=x, objective="other")


@case("choices", "ReaffirmationInvalid", reaffirmation_actors={"ann"})
def reaffirmed_by_someone_else(s):
    c, e, x = s.chosen()
    s.select([c], [c], [e], replaces=x)


def _selection_approval(s: Script, c: bytes, replaces: bytes | None = None, actor: str = "pat", expiry: int | None = None) -> bytes:
    return s.approve(canonical_hash([DIALECT.approval_domain, "pat", replaces, s.select_data([c], [c])]), actor=actor, expiry=expiry)


def _approved(s: Script, **k: Any) -> tuple[bytes, bytes]:
    c = s.candidate()
    e, a = s.evaluate(c), _selection_approval(s, c, **k)
    s.select([c], [c], [e], need=[c, a])
    return c, a


@case("choices", None, selection_requires_approval=True)
def approved_choice(s): _approved(s)  # noqa: E704


@case("choices", "ApprovalMissing", selection_requires_approval=True)
def choice_to_be_approved(s): s.chosen()  # noqa: E704


@case("choices", "ApprovalMissing", selection_requires_approval=True)
def choice_approved_for_another(s): _approved(s, actor="sys")  # noqa: E704


@case("choices", "ApprovalExpired", selection_requires_approval=True)
def choice_approved_too_early(s): _approved(s, expiry=6)  # noqa: E704


@case("choices", "ApprovalMissing", selection_requires_approval=True)
def approval_of_a_choice_used_twice(s):
    c, a = _approved(s)
    s.select([c], [c], [s.evaluate(c)], need=[c, a])


@case("choices", "ApprovalMissing", selection_requires_approval=True)
def approval_diverted_to_a_reaffirmation(s):
    c, _ = _approved(s)
    x, a = s.records[-2].id, _selection_approval(s, c)
    s.select([c], [c], [s.evaluate(c)], need=[c, a], replaces=x)


@case("choices", None, selection_requires_approval=True)
def approved_reaffirmation(s):
    c, _ = _approved(s)
    x = s.records[-2].id
    a = _selection_approval(s, c, replaces=x)
    s.select([c], [c], [s.evaluate(c)], need=[c, a], replaces=x)


def _request() -> dict[str, Any]:
    return {"objective": "build", "scope": SCOPE, "attachments": [], "parent_request_id": None}


def _summary() -> dict[str, Any]:
    return {"summary_type": "Lesson", "subject": SCOPE, "scope": SCOPE, "claim_payload": b"x"}


def _candidate() -> dict[str, Any]:
    source = {"git": {"algo": "sha1", "tree": "cd" * 20, "commit": None}, "manifest_hash": None, "binding": "reported"}
    return {"source": source, "basis": "root", "parent": None, "note": None, "artifacts": None}


def _rejected_request(s: Script) -> bytes:
    return s.put("request.v1", _request(), by="pat")


# -- queries -----------------------------------------------------------------------------------------


def _played(family: str) -> dict[str, Script]:
    out = {}
    for name, (script, _, rules) in CASES[family].items():
        out[name] = Script(**rules)
        script(out[name])
    return out


def record_table(spark: SparkSession, logs: dict[str, list[Record]]) -> DataFrame:
    """Records of scripted logs (a few rows each) as a table."""
    return spark.createDataFrame([r.row(name, i) for name, records in logs.items() for i, r in enumerate(records)], RECORD_COLUMNS)


def verdicts(family: str) -> Callable[[SparkSession, str], DataFrame]:
    """The verdict of the last record of every script of a family."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = _played(family)
        records = record_table(spark, {n: s.records for n, s in logs.items()})
        rules = spark.createDataFrame([(n, dumps(s.rules.written()).decode()) for n, s in logs.items()], "log_id string, rules_json string")
        judged = judge_logs(records, rules, DIALECT)
        last = judged.groupBy("log_id").agg(F.max_by(F.struct("kind", "result", "reason"), "pos").alias("x"))
        return last.select(F.col("log_id").alias("name"), "x.result", "x.reason")

    return query


def _all_logs() -> dict[str, Script]:
    return {f"{family}/{n}": s for family in CASES for n, s in _played(family).items()}


def q_verdicts_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of every script whose kind the relational rules cover, all logs at once."""
    logs = _all_logs()
    records = record_table(spark, {n: s.records for n, s in logs.items()})
    rules = spark.createDataFrame([(n, dumps(s.rules.written()).decode()) for n, s in logs.items()], "log_id string, rules_json string")
    last = [(n, len(s.records) - 2) for n, s in logs.items()]
    asked = spark.createDataFrame(last, "log_id string, pos bigint")
    return batteries.reasons(records, rules, DIALECT).join(asked, ["log_id", "pos"]).select(F.col("log_id").alias("name"), "result", "reason")


def _relational_sql() -> str:
    kinds = {n: s.records[-2].kind for n, s in _all_logs().items()}
    rows = [(f"{f}/{n}", "Reject" if reason else "Accept", reason) for f, cases in CASES.items() for n, (_, reason, _) in cases.items()]
    return _values([r for r in rows if kinds[r[0]] in batteries.COVERED], "name", "result", "reason")


def _values(rows: list[tuple], *names: str) -> str:
    text = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    body = ",\n  ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"select * from (values\n  {body}\n) as t({', '.join(names)})"


def verdicts_sql(family: str) -> str:
    return _values([(n, "Reject" if reason else "Accept", reason) for n, (_, reason, _) in CASES[family].items()], "name", "result", "reason")


def _signed_log() -> Script:
    s = Script(**pinned("pat"))
    s.seeds = SEEDS
    c, e, x = s.chosen()
    s.candidate("continuation", ("Cause", x), parent=c)
    return s


def _logs() -> dict[str, list[Record]]:
    """A signed log and forgeries of it."""
    whole = _signed_log()
    r, v = whole.records, whole._verdict
    new = lambda x, **k: dataclasses.replace(y := dataclasses.replace(x, **k), id=y.computed_id())
    return {
        "whole": r,
        "empty_end": r[:-2],
        "verdict_lost": r[:-1],
        "beginning_lost": r[2:],
        "time_skipped": [*r[:2], *(dataclasses.replace(x, time=x.time + 1) for x in r[2:])],
        "id_changed": [dataclasses.replace(r[0], id=bytes(32)), *r[1:]],
        "author_changed": [*r[:4], dataclasses.replace(r[4], author="bob"), *r[5:]],
        "verdict_forged": [*r[:4], r[4], v(r[4], "Refused"), *r[6:]],
        "accepted_wrongly": [*r[:2], bad := new(r[2], author_type="Executor"), v(bad, None)],
        "rejected_wrongly": [*r[:7], v(r[6], "LineageInvalid")],
        "signature_lost": [bare := new(r[0], signature=None), v(bare, None)],
        "signature_lost_and_rejected": [bare, v(bare, "SignatureMissing")],
        "time_beyond_bounds": [dataclasses.replace(r[0], time=2**64 - 1)],
        "verdict_of_another": [*r[:5], new(v(r[2], None), time=6)],
    }


#: log -> (reason, records that hold)
LOG_VERDICTS = {
    "whole": (None, 8), "empty_end": (None, 6), "verdict_lost": ("InvalidPayload", 6), "beginning_lost": ("InvalidPayload", 0),
    "time_skipped": ("InvalidPayload", 0), "id_changed": ("InvalidPayload", 0), "author_changed": ("InvalidPayload", 0),
    "verdict_forged": ("InvalidPayload", 4), "accepted_wrongly": ("AuthorRoleInvalid", 2), "rejected_wrongly": ("InvalidPayload", 6),
    "signature_lost": ("SignatureMissing", 0), "signature_lost_and_rejected": (None, 2), "time_beyond_bounds": ("InvalidPayload", 0),
    "verdict_of_another": ("InvalidPayload", 4),
}


def q_verify_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed log and its forgeries, replayed."""
    return verify_logs(record_table(spark, _logs()), _signed_log().rules, DIALECT).select(F.col("log_id").alias("name"), "result", "reason", "checked")


CORE = {"id": "core", "version": 1, "clauses": [{"id": f"B{i}", "statement": "s"} for i in range(1, 7)]}
DELIVERY = {"id": "delivery", "version": 1, "clauses": [{"id": f"D{i}", "statement": "s"} for i in range(8)]}
SIGNED = {"id": "signed", "version": 1, "clauses": [{"id": f"S{i}", "statement": "s"} for i in range(4)]}
TABLES = {t["id"]: t for t in (CORE, DELIVERY, SIGNED)}


def _delivery(s: Script, evidence: Any = None, by: str = "sys", outcome: str = "passed", evaluator: Any = None, covers: bool = True, old: bool = False, retract: str = "") -> Script:
    """A delivery whose clauses all hold but for what the arguments spoil."""
    r = s.request()
    q = s.require(r)
    other = s.put("requirement.v1", {"key": "soft", "description": "d", "required": False, "expected_evidence": None, "provenance": "derived"}, ("Cause", r))
    c = s.candidate("root", ("Cause", r), artifacts=[ART])
    need = tuple(sorted([q, other])) if covers else (other,)
    more = {"evidence": [ART] if evidence is None else evidence, "outcome": outcome} | ({"evaluator": evaluator} if evaluator else {})
    e = s.evaluate2(c, need, by=by, **more)
    s.select([c], [c], [e, s.evaluate(c)] if old else [e])
    if retract:
        s.retract({"evaluation": e, "candidate": c}[retract])
    return s


def _no_hashes() -> dict[str, Any]:
    return {"id": "e", "version": None, "procedure_hash": None, "input_hash": SCOPE}


#: receipt -> (script, status, clauses that fail by profile)
RECEIPTS: dict[str, tuple[Callable[[], Script], str, dict[str, str]]] = {
    "delivered": (lambda: _delivery(Script()), "Clean", {"core": "", "delivery": "", "signed": "S1 S2 S3"}),
    "required_not_covered": (lambda: _delivery(Script(), covers=False), "Clean", {"core": "", "delivery": "D1", "signed": "S1 S2 S3"}),
    "outcome_failed": (lambda: _delivery(Script(), outcome="failed"), "Clean", {"core": "", "delivery": "D1 D2", "signed": "S1 S2 S3"}),
    "evidence_not_in_the_record": (lambda: _delivery(Script(), evidence=[ART | {"digest": "cd" * 32}]), "Clean", {"core": "", "delivery": "D3", "signed": "S1 S2 S3"}),
    "no_evidence": (lambda: _delivery(Script(), evidence=[]), "Clean", {"core": "", "delivery": "D3", "signed": "S1 S2 S3"}),
    "judged_by_its_author": (lambda: _delivery(Script(), by="pat"), "Clean", {"core": "", "delivery": "D4", "signed": "S1 S2 S3"}),
    "evaluator_unbound": (lambda: _delivery(Script(), evaluator=_no_hashes()), "Clean", {"core": "", "delivery": "D5", "signed": "S1 S2 S3"}),
    "plain_evaluation_beside": (lambda: _delivery(Script(), old=True), "Clean", {"core": "", "delivery": "D3 D5", "signed": "S1 S2 S3"}),
    "weak_rules": (lambda: _delivery(Script(evidence_thresholds={})), "Clean", {"core": "B3", "delivery": "D6", "signed": "S0 S1 S2 S3"}),
    "context_without_bound": (lambda: _delivery(Script(max_context_records=100_001)), "Clean", {"core": "B4", "delivery": "D6", "signed": "S0 S1 S2 S3"}),
    "evaluation_retracted": (lambda: _delivery(Script(), retract="evaluation"), "Tainted", {"core": "", "delivery": "D1 D7", "signed": "S1 S2 S3"}),
    "candidate_retracted": (lambda: _delivery(Script(), retract="candidate"), "Tainted", {"core": "", "delivery": "D7", "signed": "S1 S2 S3"}),
    "nothing_delivered": (lambda: _line(Script()), "Clean", {"core": "", "delivery": "D0 D1 D2 D3 D4 D5 D6 D7", "signed": "S1 S2 S3"}),
    "signed_choice": (lambda: _attested(), "Clean", {"core": "", "delivery": "D0 D1 D2 D3 D4 D5 D6 D7", "signed": ""}),
}


def _line(s: Script) -> Script:
    s.chosen()
    return s


def _attested() -> Script:
    kinds = {"Candidate", "Evaluation", "Selection", "Retraction", "Requirement"}
    s = Script(signature_required_kinds=kinds, **pinned("pat", "exe"))
    s.seeds = SEEDS
    c = s.candidate()
    s.select([c], [c], [s.evaluate2(c, schema="evaluation.attested.v1", by="exe")])
    return s


def _receipts(spark: SparkSession, contents: dict[str, bytes], profiles: tuple[str, ...] = ()) -> DataFrame:
    return validate_receipts(spark.createDataFrame(list(contents.items()), "name string, content binary"), DIALECT, profiles=profiles, tables=TABLES)


def q_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that fail, by receipt and profile."""
    made = _receipts(spark, {n: export(script()) for n, (script, _, _) in RECEIPTS.items()}, tuple(TABLES))
    each = made.select("name", "status", F.explode("profiles").alias("p"))
    return each.select("name", "status", F.col("p.id").alias("profile"), F.concat_ws(" ", F.array_sort("p.failed")).alias("failed"), F.col("p.met").alias("met"))


def _malformed() -> dict[str, bytes]:
    s = Script()
    s.request()
    good = json.loads(export(s))
    put = lambda **k: json.dumps(good | k).encode()
    entry = {"id": "core", "version": 1, "hash": [0] * 32}
    return {
        "good": export(s), "cut_off": export(s)[:-2], "no_json": b"\xff", "empty": b"", "another_epoch": put(spec_version="0.2"),
        "one_field_more": put(more=1), "no_records": json.dumps({k: v for k, v in good.items() if k != "records"}).encode(),
        "records_no_list": put(records={}), "rules_with_more": put(rules=good["rules"] | {"more": 1}),
        "key_twice": export(s)[:-1] + b',"records":[]}', "declared_twice": put(profiles=[entry] * 2), "declared_without_id": put(profiles=[entry | {"id": ""}]),
        "declared_too_early": put(spec_version="0.3", profiles=[entry]), "short_hash": put(records=[good["records"][0] | {"id": [1]}]),
        "verdict_first": put(records=good["records"][1:]),
    }


#: receipt -> (status, whether it is refused before any replay)
MALFORMED = {
    "good": ("Clean", False), "cut_off": ("Invalid", True), "no_json": ("Invalid", True), "empty": ("Invalid", True), "another_epoch": ("Invalid", True),
    "one_field_more": ("Invalid", True), "no_records": ("Invalid", True), "records_no_list": ("Invalid", True), "rules_with_more": ("Invalid", True),
    "key_twice": ("Invalid", True), "declared_twice": ("Invalid", True), "declared_without_id": ("Invalid", True), "declared_too_early": ("Invalid", True),
    "short_hash": ("Invalid", True), "verdict_first": ("Invalid", False),
}


def q_receipts_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that can't be read, and why they are refused."""
    return _receipts(spark, _malformed()).select("name", "status", F.col("problem").isNotNull().alias("structural"))


#: receipt -> what its problem says; limits of a few bytes, records or references where named
PROBLEMS = {
    "one_field_more": "unparseable receipt: unknown field `more`", "declared_with_more": "unparseable receipt: unknown field `more`",
    "key_twice": "duplicate field", "signature_of_numbers": "invalid type", "another_epoch": "unsupported spec version", "no_json": "unparseable receipt",
    "cut_off": "unparseable receipt", "short_hash": "unparseable receipt", "declared_too_early": "profile declarations require spec 0.4",
    "declared_twice": "declared more than once", "declared_without_id": "has an empty id", "many_bytes": "receipt exceeds size limit",
    "many_records": "receipt exceeds record limit", "many_references": "exceeds ref-count limit",
}
LIMITS = {"many_bytes": Limits(max_bytes=9), "many_records": Limits(max_records=1), "many_references": Limits(max_refs_per_record=1)}


def q_receipt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the problem of a receipt says what readers look for."""
    made, chosen = _malformed(), export(_line(Script()))
    good = json.loads(made["good"])
    entry = {"id": "core", "version": 1, "hash": [0] * 32, "more": 1}
    first = good["records"][0]
    signed = first | {"author": first["author"] | {"signature": {"key_id": 123, "sig": "x"}}}
    made |= {"declared_with_more": json.dumps(good | {"profiles": [entry]}).encode(), "signature_of_numbers": json.dumps(good | {"records": [signed]}).encode()}
    plain = [(n, made[n], says) for n, says in PROBLEMS.items() if n not in LIMITS]
    parts = [(plain, None)] + [([(n, chosen, PROBLEMS[n])], limits) for n, limits in LIMITS.items()]
    told = [
        validate_receipts(spark.createDataFrame(rows, "name string, content binary, says string"), DIALECT, limits=limits)
        .select("name", "status", "says", F.contains("problem", "says").alias("said"))
        for rows, limits in parts
    ]
    return reduce(DataFrame.unionAll, told)


def _broken_benchmark() -> tuple[Script, dict[str, bytes]]:
    """A line of development whose first selection rests on an evaluation that is retracted later."""
    s, n = Script(), {}
    n["c0"] = s.candidate()
    n["bench"] = s.evaluate(n["c0"])
    n["s0"] = s.select([n["c0"]], [n["c0"]], [n["bench"]])
    n["c1"] = s.candidate("continuation", ("Cause", n["s0"]), parent=n["c0"])
    n["c2"] = s.candidate("derivation", ("Cause", n["c1"]))
    n["c2b"] = s.candidate("derivation", ("Cause", n["c1"]))
    n["c3"] = s.candidate("derivation", ("Cause", n["c2"]))
    n["c4"] = s.candidate("derivation", ("Cause", n["c0"]), ("Cause", n["bench"]))
    s.retract(n["bench"])
    n["c5"] = s.candidate("derivation", ("Cause", n["c3"]))
    n["review"] = s.evaluate(n["c0"], by="ann", criterion="review")
    n["s1"] = s.select([n["c0"]], [n["c0"]], [n["review"]], replaces=n["s0"])
    s.retract(n["c5"], by="sys")  # rejected: another's
    return s, n


#: (question, answer) in the order of the answer
ANSWERS = [
    ("descent c5", "c3:derivation c2:derivation c1:derivation s0:continuation-anchor c0:parent"),
    ("descent c4", "c0:derivation"),
    ("descent c0", ""),
    ("descendants s0", "c1 c2 c2b c3 c5"),
    ("descendants c0", "c1 c2 c2b c3 c4 c5"),
    ("siblings c2", "c2b"),
    ("siblings c4", ""),
    ("siblings c1", ""),
    ("siblings c0", ""),
    ("frontier", "c1:unconsidered c2:unconsidered c2b:unconsidered c3:unconsidered c4:unconsidered c5:unconsidered"),
    ("standing s0", "unsound restored by s1"),
    ("standing c2", "sound restored by "),
    ("standing bench", "n/a restored by "),
    ("evidence s1", "s1<review:passed"),
    ("evidence c3", "s0<bench:passed"),
    ("selected adopt", "s0:unsound s1:sound"),
    ("selected other", ""),
    ("compromised", ""),
]


def q_named_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named queries on the broken benchmark, asked in a task each."""
    s, n = _broken_benchmark()
    names = {v.hex(): k for k, v in n.items()}
    content = export(s)

    def ask(question: str) -> str:
        from ledgerloom.operators.receipts import open_receipt

        q = Queries(open_receipt(content, DIALECT)[2])
        verb, _, about = question.partition(" ")
        name = lambda x: names[x["id"]]
        if verb == "descent":
            return " ".join(f"{name(x)}:{x['via']}" for x in q.descent(n[about]))
        if verb in ("descendants", "siblings"):
            return " ".join(map(name, getattr(q, verb)(n[about])))
        if verb == "frontier":
            return " ".join(f"{name(x)}:{x['state']}" for x in q.frontier())
        if verb == "standing":
            x = q.standing(n[about])
            return f"{x['standing']} restored by " + " ".join(map(name, x["restored_by"]))
        if verb == "evidence":
            return " ".join(f"{name(g['selection'])}<" + ",".join(f"{name(e)}:{e['outcome']}" for e in g["evaluations"]) for g in q.evidence(n[about]))
        if verb == "selected":
            return " ".join(f"{name(x)}:{x['standing']}" for x in q.selected(about))
        return " ".join(sorted(names[x.hex()] for x in q.marks.compromised))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"question": pdf["question"], "answer": [ask(x) for x in pdf["question"]]})

    asked = spark.createDataFrame([(x,) for x, _ in ANSWERS], "question string")
    return asked.mapInPandas(run, "question string, answer string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"verdicts_{f}": verdicts(f) for f in CASES} | {
    "verdicts_relational": q_verdicts_relational,
    "verify_logs": q_verify_logs,
    "profiles": q_profiles,
    "receipts_malformed": q_receipts_malformed,
    "receipt_problems": q_receipt_problems,
    "named_queries": q_named_queries,
}

ORACLE_SQL: dict[str, str] = {f"verdicts_{f}": verdicts_sql(f) for f in CASES} | {
    "verdicts_relational": _relational_sql(),
    "verify_logs": _values([(n, "Reject" if reason else "Accept", reason, checked) for n, (reason, checked) in LOG_VERDICTS.items()], "name", "result", "reason", "checked").replace(
        "select *", "select name, result, reason, cast(checked as bigint) as checked"
    ),
    "profiles": _values([(n, status, p, failed, not failed) for n, (_, status, by) in RECEIPTS.items() for p, failed in by.items()], "name", "status", "profile", "failed", "met"),
    "receipts_malformed": _values([(n, status, early) for n, (status, early) in MALFORMED.items()], "name", "status", "structural"),
    "receipt_problems": _values([(n, "Invalid", says, True) for n, says in PROBLEMS.items()], "name", "status", "says", "said"),
    "named_queries": _values(ANSWERS, "question", "answer"),
}

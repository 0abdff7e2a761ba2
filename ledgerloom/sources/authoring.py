"""Short ways to commit the records of a line of development.

Each method builds the payload and the references that the rules ask for, so
that callers name only what they mean.  Some guards are the author's, not the
ledger's: an upgrade must keep its Git tree, and flags that exclude each other
are refused before anything is written.
"""

from __future__ import annotations

from typing import Any

from ledgerloom.sources.writer import Commit, LogWriter, Proposal


class Author:
    """An actor that writes to one thread of a log."""

    def __init__(self, writer: LogWriter, actor: str, role: str, thread: bytes):
        self.writer, self.actor, self.role, self.thread = writer, actor, role, thread

    def _commit(self, schema: str, payload: dict[str, Any], *refs: tuple[str, bytes]) -> Commit:
        return self.writer.commit(Proposal(self.thread, self.actor, self.role, schema, payload, refs))

    def request(self, objective: str, scope: bytes, attachments: dict[str, str] | None = None, parent: bytes | None = None) -> Commit:
        files = [{"path": p, "content": c} for p, c in (attachments or {}).items()]
        refs = [("Cause", parent)] if parent else []
        return self._commit("request.v1", {"objective": objective, "scope": scope, "attachments": files, "parent_request_id": parent}, *refs)

    def requirement(self, request: bytes, key: str, description: str, required: bool = True, expected_evidence: str | None = None) -> Commit:
        """State what a request needs; a user's are their own, others' are derived."""
        provenance = "user_authored" if self.role == "User" else "derived"
        payload = {"key": key, "description": description, "required": required, "expected_evidence": expected_evidence, "provenance": provenance}
        return self._commit("requirement.v1", payload, ("Cause", request))

    def candidate(
        self, tree: str, algo: str = "sha1", commit: str | None = None, manifest_hash: bytes | None = None, continues: bytes | None = None,
        parent: bytes | None = None, derives: tuple[bytes, ...] = (), upgrades: bytes | None = None, request: bytes | None = None,
        artifacts: list[dict[str, Any]] | None = None, note: str | None = None,
    ) -> Commit:
        """Propose a source state: a root, the continuation of a selection, a derivation, or an upgrade of a candidate's binding."""
        if sum(map(bool, (continues, derives, upgrades))) > 1:
            raise ValueError("continues, derives and upgrades exclude each other")
        if bool(continues) != bool(parent):
            raise ValueError("a continuation names its selection and its parent")
        if upgrades:
            old = self.writer.ledger.data(self.writer.get(upgrades))
            if not old or old.get("source", {}).get("git", {}).get("tree") != tree:
                raise ValueError("an upgrade keeps the Git tree")
            derives = (upgrades,)
        binding = "manifest" if manifest_hash else "reported"
        source = {"git": {"algo": algo, "tree": tree, "commit": commit}, "manifest_hash": manifest_hash, "binding": binding}
        basis = "continuation" if continues else "derivation" if derives else "root"
        causes = [continues] if continues else list(derives) or ([request] if request else [])
        ordered = artifacts and sorted(artifacts, key=lambda a: (a["scheme"], a["digest"], a["name"] is not None, a["name"] or ""))
        payload = {"source": source, "basis": basis, "parent": parent, "note": note, "artifacts": ordered}
        return self._commit("candidate.v1", payload, *(("Cause", x) for x in causes))

    def evaluate(
        self, candidate: bytes, criterion: str, outcome: Any, procedure: str | None = None, evaluator: dict[str, Any] | None = None, basis: str = "declared",
        evidence: list[dict[str, Any]] | None = None, requirements: tuple[bytes, ...] = (), attested: bool = False,
    ) -> Commit:
        """Judge a candidate; with an ``evaluator`` in the extended shape, which alone can bind requirements."""
        base = {"candidate": candidate, "criterion": criterion, "procedure": procedure, "outcome": outcome}
        if evaluator is None:
            if evidence or requirements or attested:
                raise ValueError("evidence, requirements and attestation need an evaluator")
            return self._commit("evaluation.v1", base, ("Use", candidate))
        who = {"version": None, "procedure_hash": None, "input_hash": None} | evaluator
        needs = sorted(requirements)
        payload = base | {"evaluator": who, "basis": basis, "evidence": evidence or [], "requirements": needs}
        return self._commit("evaluation.attested.v1" if attested else "evaluation.v2", payload, ("Use", candidate), *(("Use", x) for x in needs))

    def select(
        self, objective: str, considered: tuple[bytes, ...], chosen: tuple[bytes, ...] = (), evaluations: tuple[bytes, ...] = (), replaces: bytes | None = None,
        approval: bytes | None = None, rationale: str | None = None,
    ) -> Commit:
        """Decide over candidates; without ``chosen`` the outcome is none."""
        outcome = {"selected": {"candidates": list(chosen)}} if chosen else "none"
        refs = [("Use", x) for x in evaluations] + [("Require", x) for x in (*chosen, *([approval] if approval else []))]
        refs += [("Replace", replaces)] if replaces else []
        payload = {"objective": objective, "considered": list(considered), "outcome": outcome, "rationale": rationale}
        return self._commit("selection.v1", payload, *refs)

    def retract(self, target: bytes, reason: str) -> Commit:
        return self._commit("retraction.v1", {"target_id": target, "reason": reason}, ("Cause", target))

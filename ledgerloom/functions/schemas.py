"""The closed record model: enums, payload schemas and strict decoding.

A payload schema is data: its fields, in any order, with a type each.  Decoding
checks every field against its type and refuses unknown ones; the canonical
check compares the bytes with what the decoded value prints.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from ledgerloom.functions.canonical import SAFE, CanonicalError, dumps, loads, sha256

# Fixed values of the wire format.
REF_TYPES = ("Cause", "Use", "Require", "Replace")
EVIDENCE = ("Deterministic", "Verified", "Reported", "Inferred", "Assumed")
AUTHOR_TYPES = ("User", "Provider", "System", "Executor", "Verifier")
REASONS = (
    "UnknownSchema KindSchemaMismatch SignatureMissing SignatureInvalid RefUnresolved RefCrossSpace RequestMissing "
    "CapabilityMissing CapabilityDenied ApprovalMissing ApprovalExpired ActionClosed ReplacementInvalid ExternalReceiptRequired "
    "EvidenceBelowThreshold Refused InvalidPayload InvalidCheckpoint AuthorRoleInvalid AuthorityRefMissing SourceBindingInvalid "
    "LineageInvalid PayloadRefUnresolved EvaluationInvalid SelectionInvalid ReaffirmationInvalid ArtifactRefInvalid RequirementInvalid"
).split()
SUMMARY_TYPES = ("Procedure", "Pattern", "Lesson", "StateSnapshot")
# The author types that may write each kind.
AUTHORS: dict[str, tuple[str, ...]] = {
    "Request": ("User",),
    "Action": ("Provider",),
    "Response": ("Provider",),
    "Result": ("Executor",),
    "Summary": ("Provider",),
    "Approval": ("User",),
    "Capability": ("User", "System"),
    "Usage": ("Provider", "System"),
    "Refusal": ("User", "System"),
    "Verdict": ("Verifier",),
    "Plan": ("Provider",),
    "Retraction": ("User", "Provider", "System"),
    "Candidate": ("User", "Provider", "Executor", "System"),
    "Evaluation": ("User", "Provider", "Executor", "System"),
    "Selection": ("User", "Provider", "System"),
    "Requirement": ("User", "Provider", "System"),
}
KINDS = tuple(AUTHORS)
REPLACEABLE = ("Summary", "Capability", "Approval", "Plan", "Selection")
# Digest lengths in bytes of the registered artifact schemes.
DIGESTS = {
    "git-tree-sha1": 20,
    "git-tree-sha256": 32,
    "manifest-v1": 32,
    "git-archive-tar-v1": 32,
    "oci-image-manifest": 32,
    "sha256-bytes": 32,
}


class PayloadError(ValueError):
    """A payload that its schema does not admit."""


@dataclass(frozen=True)
class Opt:
    """A value or null; ``absent`` means that null is left out when written."""

    of: Any
    absent: bool = False


@dataclass(frozen=True)
class Many:
    of: Any


@dataclass(frozen=True)
class One:
    """One of fixed names."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Tagged:
    """A bare name, or an object with one key for a variant with content."""

    names: tuple[str, ...]
    holding: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class Struct:
    fields: tuple[tuple[str, Any], ...]
    #: Fields with a default when reading; written in full all the same.
    lenient: tuple[tuple[str, Any], ...] = ()
    filled: tuple[str, ...] = ()  # strings that must not be empty


def _struct(lenient: dict[str, Any] | None = None, filled: tuple[str, ...] = (), **fields: Any) -> Struct:
    return Struct(tuple(fields.items()), tuple((lenient or {}).items()), filled)


_ARTIFACT = _struct({"name": None}, scheme="str", digest="str", name=Opt("str"))
_ARTIFACTS = Opt(Many(_ARTIFACT), absent=True)
_SCORE = _struct(value="safe", scale="scale")
_RESULT = _struct(action_id="hash", status=One(("Success", "Failure")), output="str", artifacts=_ARTIFACTS)
_EVALUATION_2 = _struct(
    filled=("criterion",), candidate="hash", criterion="str", procedure=Opt("str"),
    outcome=Tagged(("passed", "failed", "blocked", "insufficient", "stale", "not_run"), (("scored", _SCORE),)),
    evaluator=_struct(id="str", version=Opt("str"), procedure_hash=Opt("hash"), input_hash=Opt("hash")),
    basis=One(("recomputed", "declared")), evidence=Many(_ARTIFACT), requirements=Many("hash"),
)
_TASK = _struct(
    {"kind": "generic", "inputs_from": [], "done_when": "tool_success", "depends_on": []},
    id="str", description="str", kind=One(("generic", "inspect", "search", "extract", "verify", "write", "summarize")),
    tool_hint=Opt("str"), inputs_from=Many("str"), produces=Opt("str"),
    done_when=One(("tool_success", "non_empty_result", "content_retrieved", "final_response")),
    status=One(("pending", "running", "done", "failed", "skipped")), result_record_id=Opt("hash"), depends_on=Many("str"),
    on_failure=One(("continue", "ask_user", "abort")),
)

# Fixed values of the wire format: name -> (kind, base evidence, payload).
SCHEMAS: dict[str, tuple[str, str, Struct]] = {
    "request.v1": ("Request", "Reported", _struct({"attachments": []}, objective="str", scope="hash", attachments=Many(_struct(path="str", content="str")), parent_request_id=Opt("hash"))),
    "action.v1": ("Action", "Reported", _struct(request_id="hash", action_class="str", scope="hash", exec_mode=One(("Internal", "External")), params="json")),
    "response.v1": ("Response", "Reported", _struct(request_id="hash", content="str", turn_index="u32", closes_request="bool")),
    "result.v1": ("Result", "Reported", _RESULT),
    "result.external_receipt.v1": ("Result", "Verified", _RESULT),
    "result.effect_confirmation.v1": ("Result", "Reported", _RESULT),
    "capability.v1": ("Capability", "Reported", _struct(actor_id="str", action_class="str", scope="hash", mode=One(("Auto", "Ask", "Deny")), expiry=Opt("u64"))),
    "approval.v1": ("Approval", "Reported", _struct(target_action=Opt("hash"), action_class=Opt("str"), scope="hash", actor_id=Opt("str"), expiry=Opt("u64"))),
    "summary.v1": ("Summary", "Inferred", _struct(summary_type=One(SUMMARY_TYPES), subject="hash", scope="hash", claim_payload="bytes")),
    "refusal.v1": ("Refusal", "Reported", _struct(target_id="hash", target_kind=One(("Action", "Request", "VerifiedEffect")), reason_code=Opt(One(tuple(REASONS))))),
    "usage.v1": ("Usage", "Reported", _struct(actor="str", used_record="hash", consuming_record="hash", role="str", outcome=One(("Done", "NotDone", "NoChange")))),
    "verdict.v1": ("Verdict", "Deterministic", _struct(result=One(("Accept", "Reject")), reason=Opt(One(tuple(REASONS))))),
    "plan.v1": ("Plan", "Inferred", _struct(request_id="hash", tasks=Many(_TASK), status=One(("running", "completed", "abandoned")))),
    "retraction.v1": ("Retraction", "Reported", _struct(target_id="hash", reason="str")),
    "candidate.v1": ("Candidate", "Reported", _struct(
        source=_struct(git=_struct(algo=One(("sha1", "sha256")), tree="str", commit=Opt("str")), manifest_hash=Opt("hash"), binding=One(("reported", "manifest"))),
        basis=One(("root", "continuation", "derivation")), parent=Opt("hash"), note=Opt("str"), artifacts=_ARTIFACTS)),
    "evaluation.v1": ("Evaluation", "Reported", _struct(filled=("criterion",), candidate="hash", criterion="str", procedure=Opt("str"), outcome=Tagged(("passed", "failed"), (("scored", _SCORE),)))),
    "selection.v1": ("Selection", "Inferred", _struct(filled=("objective",), objective="str", considered=Many("hash"), outcome=Tagged(("none",), (("selected", _struct(candidates=Many("hash"))),)), rationale=Opt("str"))),
    "requirement.v1": ("Requirement", "Reported", _struct(key="str", description="str", required="bool", expected_evidence=Opt("str"), provenance=One(("user_authored", "derived")))),
    "evaluation.v2": ("Evaluation", "Reported", _EVALUATION_2),
    "evaluation.attested.v1": ("Evaluation", "Verified", _EVALUATION_2),
}
#: Schemas that only the later epoch knows.
LATER = ("requirement.v1", "evaluation.v2", "evaluation.attested.v1")
EPOCHS = ("0.3", "0.4")


def read(kind: Any, value: Any) -> Any:
    """Check a JSON value against a type; hashes and bytes become ``bytes``."""
    if isinstance(kind, Opt):
        return None if value is None else read(kind.of, value)
    if isinstance(kind, Many):
        if not isinstance(value, list):
            raise PayloadError("invalid type: not a list")
        return [read(kind.of, x) for x in value]
    if isinstance(kind, One):
        if not isinstance(value, str) or value not in kind.names:
            raise PayloadError(f"{value!r} is not one of {kind.names}")
        return value
    if isinstance(kind, Tagged):
        if isinstance(value, str) and value in kind.names:
            return value
        if isinstance(value, dict) and len(value) == 1:
            (name, inner), holding = next(iter(value.items())), dict(kind.holding)
            if name in holding:
                return {name: read(holding[name], inner)}
        raise PayloadError(f"{value!r} is no variant")
    if isinstance(kind, Struct):
        return _read_struct(kind, value)
    return _read_plain(kind, value)


def _read_struct(kind: Struct, value: Any) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise PayloadError("invalid type: not an object")
    known = dict(kind.fields)
    if not value.keys() <= known.keys():
        raise PayloadError(f"unknown field `{min(value.keys() - known.keys())}`")
    lenient, out = dict(kind.lenient), {}
    for name, of in kind.fields:
        if name in value:
            out[name] = read(of, value[name])
        elif isinstance(of, Opt):
            out[name] = None
        elif name in lenient:
            out[name] = lenient[name]
        else:
            raise PayloadError(f"{name} is missing")
        if name in kind.filled and not out[name]:
            raise PayloadError(f"{name} is empty")
    return out


def _read_plain(kind: str, value: Any) -> Any:
    number = isinstance(value, int) and not isinstance(value, bool)
    if kind == "json":
        return value
    if kind == "bool" and isinstance(value, bool) or kind == "str" and isinstance(value, str):
        return value
    most = {"u32": (1 << 32) - 1, "u64": (1 << 64) - 1, "scale": 12}.get(kind)
    if most is not None and number and 0 <= value <= most:
        return value
    if kind == "safe" and number and abs(value) <= SAFE:
        return value
    if kind in ("hash", "bytes") and isinstance(value, list) and all(isinstance(b, int) and not isinstance(b, bool) and 0 <= b <= 255 for b in value):
        if kind == "bytes" or len(value) == 32:
            return bytes(value)
    raise PayloadError(f"invalid type: not a {kind}")


def written(kind: Any, value: Any) -> Any:
    """The JSON value that a decoded one is written as."""
    if value is None:
        return None
    if isinstance(kind, Opt):
        return written(kind.of, value)
    if isinstance(kind, Many):
        return [written(kind.of, x) for x in value]
    if isinstance(kind, Tagged) and isinstance(value, dict):
        return {k: written(dict(kind.holding)[k], v) for k, v in value.items()}
    if isinstance(kind, Struct):
        left_out = {n for n, of in kind.fields if isinstance(of, Opt) and of.absent and value.get(n) is None}
        return {n: written(of, value.get(n)) for n, of in kind.fields if n not in left_out}
    return value


@dataclass(frozen=True)
class Dialect:
    """The names that a family of ledgers hashes; ``namespace`` is their prefix.

    Schema ids are SHA-256 of ``<namespace>.<schema name>``, so a ledger can be
    read only under the namespace that it was written with.
    """

    namespace: str = "ledgerloom"
    ids: dict[bytes, str] = field(init=False, compare=False, hash=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "ids", {self.schema_id(n): n for n in SCHEMAS})

    def schema_id(self, name: str) -> bytes:
        return sha256(f"{self.namespace}.{name}".encode())

    def default_space(self) -> bytes:
        return sha256(f"{self.namespace}.default_space.v1".encode())

    def name(self, schema: bytes) -> str | None:
        return self.ids.get(schema)

    def known(self, epoch: str) -> set[bytes] | None:
        """Ids of the schemas an epoch knows; nothing for an unsupported one."""
        if epoch not in EPOCHS:
            return None
        return {i for i, n in self.ids.items() if epoch != "0.3" or n not in LATER}

    def base_evidence(self, schema: bytes) -> int:
        name = self.name(schema)
        return EVIDENCE.index(SCHEMAS[name][1]) if name else len(EVIDENCE) - 1

    @property
    def signature_domain(self) -> str:
        return f"{self.namespace}.record-signature.v0.3"

    @property
    def approval_domain(self) -> str:
        return f"{self.namespace}.selection-approval.v0.3"

    def encode(self, name: str, payload: dict[str, Any]) -> bytes:
        """Canonical bytes of a payload."""
        return dumps(written(SCHEMAS[name][2], payload))


@lru_cache(maxsize=4096)
def _decoded(name: str, data: bytes) -> tuple[Any, bool] | None:
    shape = SCHEMAS[name][2]
    try:
        value = read(shape, loads(data))
    except (PayloadError, CanonicalError):
        return None
    try:
        return value, dumps(written(shape, value)) == data
    except CanonicalError:
        return value, False


def decode(name: str | None, data: bytes) -> Any | None:
    """The payload, canonical or not; nothing if its schema refuses it."""
    found = _decoded(name, data) if name else None
    return found and found[0]


def is_canonical(name: str, data: bytes) -> bool:
    found = _decoded(name, data)
    return bool(found and found[1])


_HEX = re.compile(r"(?:[0-9a-f]{2})+")
_TOKEN = re.compile(r"[a-z0-9][a-z0-9.-]*")


def artifacts_ok(artifacts: list[dict[str, Any]]) -> bool:
    """Well-formed artifact references in strictly ascending order."""
    order = [(a["scheme"], a["digest"], a["name"] is not None, a["name"] or "") for a in artifacts]
    return all(map(_artifact_ok, artifacts)) and all(x < y for x, y in zip(order, order[1:]))


def _artifact_ok(a: dict[str, Any]) -> bool:
    if not _TOKEN.fullmatch(a["scheme"]) or not _HEX.fullmatch(a["digest"]):
        return False
    size = len(a["digest"]) // 2
    return size == DIGESTS[a["scheme"]] if a["scheme"] in DIGESTS else 20 <= size <= 64


def outcome_label(outcome: Any) -> str:
    """``passed`` and the like; a score is ``scored <value>e-<scale>``."""
    if isinstance(outcome, dict):
        s = outcome["scored"]
        return f"scored {s['value']}e-{s['scale']}"
    return outcome

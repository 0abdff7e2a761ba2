"""Records, rules and receipts: reading, hashing and signing forms."""

from __future__ import annotations

import decimal
from dataclasses import dataclass, field
from typing import Any

from ledgerloom.functions import ed25519
from ledgerloom.functions.canonical import canonical_hash, dumps, loads, unhex
from ledgerloom.functions.schemas import (
    AUTHOR_TYPES, EVIDENCE, KINDS, REF_TYPES, SCHEMAS, SUMMARY_TYPES, Dialect, Many, One, Opt, PayloadError, Struct, decode, read,
)

_RECORD = Struct(
    (
        ("id", "hash"), ("space", "hash"), ("thread", "hash"), ("time", "u64"),
        ("author", Struct((("id", "str"), ("type", One(AUTHOR_TYPES)), ("signature", Opt(Struct((("key_id", "str"), ("sig", "bytes")))))))),
        ("kind", One(KINDS)), ("schema", "hash"), ("data", "bytes"),
        ("refs", Many(Struct((("type", One(REF_TYPES)), ("target", "hash"))))), ("evidence", One(EVIDENCE)),
    )
)


#: Columns of a table of records; the signature is null where there is none.
RECORD_COLUMNS = (
    "log_id string, pos bigint, id binary, space binary, thread binary, time decimal(20,0), author string, author_type string, kind string, "
    "schema binary, data binary, refs array<struct<type:string,target:binary>>, evidence string, signature struct<key_id:string,sig:binary>"
)


@dataclass(frozen=True)
class Record:
    """One record of a log; ``refs`` are (type, target) pairs in stored order."""

    id: bytes
    space: bytes
    thread: bytes
    time: int
    author: str
    author_type: str
    signature: tuple[str, bytes] | None
    kind: str
    schema: bytes
    data: bytes
    refs: tuple[tuple[str, bytes], ...]
    evidence: str

    @classmethod
    def read(cls, value: Any) -> Record:
        r = read(_RECORD, value)
        a, s = r["author"], r["author"]["signature"]
        refs = tuple((x["type"], x["target"]) for x in r["refs"])
        return cls(
            r["id"], r["space"], r["thread"], r["time"], a["id"], a["type"], s and (s["key_id"], s["sig"]), r["kind"], r["schema"], r["data"], refs, r["evidence"]
        )

    def body(self, signed: bool) -> dict[str, Any]:
        """The record without its id; the signature only if asked for and there."""
        author: dict[str, Any] = {"id": self.author, "type": self.author_type}
        if signed and self.signature:
            author["signature"] = {"key_id": self.signature[0], "sig": self.signature[1]}
        return {
            "space": self.space, "thread": self.thread, "time": self.time, "author": author, "kind": self.kind, "schema": self.schema,
            "data": self.data, "refs": [{"type": t, "target": x} for t, x in self.refs], "evidence": self.evidence,
        }

    def written(self) -> dict[str, Any]:
        out = self.body(True) | {"id": self.id}
        out["author"].setdefault("signature", None)
        return out

    def computed_id(self) -> bytes:
        return canonical_hash(self.body(True))

    def signing_bytes(self, dialect: Dialect) -> bytes:
        return dumps({"domain": dialect.signature_domain, "record": self.body(False)})

    def verified_key(self, dialect: Dialect) -> bytes | None:
        """The key whose strict signature this is, if it is one."""
        key = self.signature and unhex(self.signature[0])
        return key if key and ed25519.verify(key, self.signing_bytes(dialect), self.signature[1]) else None

    def row(self, log_id: str, pos: int) -> tuple:
        """The record as a row of RECORD_COLUMNS."""
        refs = [{"type": t, "target": x} for t, x in self.refs]
        signature = self.signature and {"key_id": self.signature[0], "sig": self.signature[1]}
        return (
            log_id, pos, self.id, self.space, self.thread, decimal.Decimal(self.time), self.author, self.author_type, self.kind, self.schema, self.data,
            refs, self.evidence, signature,
        )

    @classmethod
    def from_row(cls, r: Any) -> Record:
        """A record from a row that has the columns' names as attributes."""
        part = lambda x, name: x[name] if isinstance(x, dict) else getattr(x, name)
        signed = getattr(r, "signature", None)
        signature = (part(signed, "key_id"), bytes(part(signed, "sig"))) if isinstance(signed, (dict, tuple)) else None
        refs = tuple((part(x, "type"), bytes(part(x, "target"))) for x in r.refs)
        return cls(
            bytes(r.id), bytes(r.space), bytes(r.thread), int(r.time), r.author, r.author_type, signature, r.kind, bytes(r.schema), bytes(r.data), refs, r.evidence
        )

    def targets(self, *types: str) -> list[bytes]:
        return [x for t, x in self.refs if t in types]


@dataclass
class Rules:
    """What a deployment demands of its ledger."""

    space: bytes
    kind_schema_map: dict[bytes, str]
    max_context_records: int
    signature_required_kinds: set[str] = field(default_factory=set)
    author_keys: dict[str, set[bytes]] = field(default_factory=dict)
    author_roles: dict[str, str] = field(default_factory=dict)
    admin_retraction_actors: set[str] = field(default_factory=set)
    allowed_summary_types: set[str] = field(default_factory=lambda: set(SUMMARY_TYPES))
    evidence_thresholds: dict[str, str] = field(default_factory=dict)
    min_binding: str = "reported"
    selection_requires_evaluation: bool = True
    reaffirmation_actors: set[str] = field(default_factory=set)
    max_considered: int = 4096
    selection_requires_approval: bool = False
    reject_compromised_continuation: bool = False

    @classmethod
    def default(cls, dialect: Dialect, space: bytes | None = None, max_context_records: int = 100, baseline: bool = True, **more: Any) -> Rules:
        """Rules for all schemas, with the baseline thresholds unless told otherwise."""
        floor = {"Candidate": "Reported", "Evaluation": "Reported", "Selection": "Inferred"} if baseline else {}
        schemas = {dialect.schema_id(n): s[0] for n, s in SCHEMAS.items()}
        return cls(space or dialect.default_space(), schemas, max_context_records, **({"evidence_thresholds": floor} | more))

    @classmethod
    def read(cls, value: Any) -> Rules:
        """Strict reading: unknown fields, repeated members and wrong types are refused."""
        if not isinstance(value, dict):
            raise PayloadError("rules are not an object")
        need = {"space", "kind_schema_map", "signature_required_kinds", "author_keys", "author_roles", "admin_retraction_actors", "allowed_summary_types", "evidence_thresholds", "max_context_records"}
        extra = set(_RULES)
        if not need <= value.keys() or not value.keys() <= extra:
            odd = value.keys() - extra
            raise PayloadError(f"unknown field `{min(odd)}`" if odd else f"rules lack {min(need - value.keys())}")
        return cls(**{k: _RULES[k](v) for k, v in value.items()})

    def written(self) -> dict[str, Any]:
        kinds = lambda s: sorted(s, key=KINDS.index)
        return {
            "space": self.space,
            "kind_schema_map": [[h, k] for h, k in sorted(self.kind_schema_map.items())],
            "signature_required_kinds": kinds(self.signature_required_kinds),
            "author_keys": {a: sorted(k) for a, k in self.author_keys.items()},
            "author_roles": self.author_roles,
            "admin_retraction_actors": sorted(self.admin_retraction_actors),
            "allowed_summary_types": sorted(self.allowed_summary_types, key=SUMMARY_TYPES.index),
            "evidence_thresholds": self.evidence_thresholds,
            "max_context_records": self.max_context_records,
            "min_binding": self.min_binding,
            "selection_requires_evaluation": self.selection_requires_evaluation,
            "reaffirmation_actors": sorted(self.reaffirmation_actors),
            "max_considered": self.max_considered,
            "selection_requires_approval": self.selection_requires_approval,
            "reject_compromised_continuation": self.reject_compromised_continuation,
        }

    def hash(self) -> bytes:
        return canonical_hash(self.written())

    def for_epoch(self, known: set[bytes]) -> Rules:
        """The same rules without the schemas that an epoch doesn't know."""
        kept = {h: k for h, k in self.kind_schema_map.items() if h in known}
        return Rules(**(self.__dict__ | {"kind_schema_map": kept}))


def _unique(of: Any):
    def parse(value: Any) -> set:
        items = read(Many(of), value)
        if len(set(items)) != len(items):
            raise PayloadError("a repeated member")
        return set(items)

    return parse


def _mapping(key: Any, of: Any):
    def parse(value: Any) -> dict:
        if not isinstance(value, dict):
            raise PayloadError("not an object")
        return {read(key, k): of(v) for k, v in value.items()}

    return parse


def _schema_map(value: Any) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    for pair in read(Many("json"), value):
        if not isinstance(pair, list) or len(pair) != 2:
            raise PayloadError("not a pair")
        key = read("hash", pair[0])
        if key in out:
            raise PayloadError("a repeated schema")
        out[key] = read(One(KINDS), pair[1])
    return out


_plain = lambda kind: lambda v: read(kind, v)
_RULES = {
    "space": _plain("hash"), "kind_schema_map": _schema_map, "signature_required_kinds": _unique(One(KINDS)),
    "author_keys": _mapping("str", _unique("hash")), "author_roles": _mapping("str", _plain(One(AUTHOR_TYPES))),
    "admin_retraction_actors": _unique("str"), "allowed_summary_types": _unique(One(SUMMARY_TYPES)),
    "evidence_thresholds": _mapping(One(KINDS), _plain(One(EVIDENCE))), "max_context_records": _plain("u32"),
    "min_binding": _plain(One(("reported", "manifest"))), "selection_requires_evaluation": _plain("bool"),
    "reaffirmation_actors": _unique("str"), "max_considered": _plain("u32"), "selection_requires_approval": _plain("bool"),
    "reject_compromised_continuation": _plain("bool"),
}


_DECLARATION = Struct((("id", "str"), ("version", "u32"), ("hash", "hash")))


@dataclass
class Receipt:
    """A portable log: its epoch, the rules it was kept under and all records."""

    spec_version: str
    rules: Rules
    records: list[Record]
    profiles: list[dict[str, Any]] = field(default_factory=list)  # id, version and hash of each

    @classmethod
    def from_bytes(cls, data: bytes) -> Receipt:
        value = loads(data)
        if not isinstance(value, dict):
            raise PayloadError("invalid type: a receipt is an object")
        odd, missing = value.keys() - {"spec_version", "profiles", "rules", "records"}, {"spec_version", "rules", "records"} - value.keys()
        if odd or missing:
            raise PayloadError(f"unknown field `{min(odd)}`" if odd else f"the receipt lacks {min(missing)}")
        return cls(
            read("str", value["spec_version"]), Rules.read(value["rules"]), [Record.read(r) for r in read(Many("json"), value["records"])],
            read(Many(_DECLARATION), value.get("profiles", [])),
        )

    def to_bytes(self) -> bytes:
        out = {"spec_version": self.spec_version, "rules": self.rules.written(), "records": [r.written() for r in self.records]}
        return dumps(out | ({"profiles": self.profiles} if self.profiles else {}))


def payload(record: Record, dialect: Dialect) -> Any | None:
    """The record's decoded payload, canonical or not; nothing if it doesn't decode."""
    return decode(dialect.name(record.schema), record.data)



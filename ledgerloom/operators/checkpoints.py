"""Checkpoints: trusting the verdicts of a prefix that was verified before.

A checkpoint states a prefix's length, last record, hash of ids and hash of
state.  Replay from it takes the stored verdicts of the prefix as they are,
rebuilds the state, compares, and judges only what follows; ids and times are
still checked over the whole log.  The state's hash is over this library's own
form of the state, so checkpoints are not exchanged with other implementations.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ledgerloom.functions.canonical import SAFE, canonical_hash, chain_hash
from ledgerloom.functions.records import Record, Rules, payload
from ledgerloom.functions.schemas import Dialect
from ledgerloom.operators.judge import Ledger, LogVerdict, State, _judge_pairs, chain_holds, replay


@dataclass(frozen=True)
class Checkpoint:
    length: int
    last_time: int
    last_id: bytes
    state_hash: bytes
    log_hash: bytes


class TrustedCheckpoint:
    """A checkpoint with a reason to be trusted, bound to the rules it was made under."""

    def __init__(self, checkpoint: Checkpoint, rules_hash: bytes, _token: object = None):
        if _token is not _MADE_HERE:
            raise TypeError("use from_verified_log or assume_verified")
        self.checkpoint, self.rules_hash = checkpoint, rules_hash

    @classmethod
    def from_verified_log(cls, records: list[Record], rules: Rules, dialect: Dialect) -> TrustedCheckpoint:
        """Verify a whole log, then state where it ends."""
        verdict = replay(records, rules, dialect)
        if not verdict.accepted:
            raise ValueError(f"the log is invalid: {verdict.reason}")
        return cls(create(records, verdict.ledger), rules.hash(), _MADE_HERE)

    @classmethod
    def assume_verified(cls, checkpoint: Checkpoint, rules: Rules) -> TrustedCheckpoint:
        """Trust a checkpoint that was stored by someone trusted."""
        return cls(checkpoint, rules.hash(), _MADE_HERE)


_MADE_HERE = object()


def _ordered(value: Any) -> Any:
    if isinstance(value, dict):
        return sorted(([_ordered(k), _ordered(v)] for k, v in value.items() if v != set()), key=repr)
    if isinstance(value, (set, frozenset)):
        return sorted(map(_ordered, value), key=repr)
    if isinstance(value, tuple):
        return [_ordered(x) for x in value]
    return value


def state_hash(state: State) -> bytes:
    """Hash of the state's sets and maps, each in order."""
    slots = {k: v for k, v in vars(state).items() if k != "slot_of"}
    return canonical_hash([[k, _ordered(v)] for k, v in sorted(slots.items())])


def create(records: list[Record], ledger: Ledger) -> Checkpoint:
    """The checkpoint at the end of a replayed log."""
    last = records[-1] if records else None
    return Checkpoint(len(records), last.time if last else 0, last.id if last else bytes(32), state_hash(ledger.state), chain_hash([r.id for r in records]))


def replay_from(records: list[Record], trusted: TrustedCheckpoint, rules: Rules, dialect: Dialect) -> LogVerdict:
    """Replay a log whose prefix a checkpoint vouches for."""
    c, ledger = trusted.checkpoint, Ledger(rules, dialect)
    last = records[-1].time if records else 0
    prefix = records[: c.length]
    matches = (
        trusted.rules_hash == rules.hash() and c.length % 2 == 0 and len(prefix) == c.length and c.last_time <= SAFE
        and (not prefix or (prefix[-1].time, prefix[-1].id) == (c.last_time, c.last_id)) and chain_hash([r.id for r in prefix]) == c.log_hash
    )
    if not matches:
        return LogVerdict("InvalidCheckpoint", 0, last, ledger)
    if not chain_holds(records, ledger):
        return LogVerdict("InvalidPayload", 0, last, ledger)
    for subject, verdict in zip(prefix[::2], prefix[1::2]):
        ledger.admit(subject)
        ledger.admit(verdict)
        ledger.judged.add(subject.id)
        stored = payload(verdict, dialect)
        if stored is None or verdict.kind != "Verdict":
            return LogVerdict("InvalidCheckpoint", 0, last, ledger)
        if stored["result"] == "Accept":
            ledger.fold(subject)
    if state_hash(ledger.state) != c.state_hash:
        return LogVerdict("InvalidCheckpoint", 0, last, ledger)
    return _judge_pairs(ledger, records, c.length, last)

"""``python -m ledgerloom``: validate receipts, query and write logs, make rules.

Exit codes: 0 clean, 1 invalid, 2 tainted, 3 a required profile is not met, 64
usage, 65 unusable data, 66 no input.  Invalid goes before a profile, a profile
before tainted.
"""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
from typing import Any

from ledgerloom.functions import ed25519
from ledgerloom.functions.canonical import dumps, loads, unhex
from ledgerloom.functions.records import Rules
from ledgerloom.functions.schemas import AUTHOR_TYPES, EVIDENCE, KINDS, Dialect
from ledgerloom.operators.judge import replay
from ledgerloom.operators.receipts import Limits, Profiles, Queries, QueryError, Report, _report_row, open_receipt, validate
from ledgerloom.sources.frames import read_log

ADD = ("request", "requirement", "candidate", "evaluate", "select", "retract")
QUERIES = ("descent", "descendants", "siblings", "frontier", "standing", "evidence", "selected", "lineage")


def _text(r: Report) -> str:
    """A report to read: the outcome first, then the log, then what is marked and the clauses by profile."""
    out = [f"{'status:':<17}{r.status.upper()}"]
    out += [f"because {why}" for why in (r.problem, r.reason) if why]
    if r.problem is None:
        out.append(f"epoch {r.spec_version}, {r.checked_records} of {r.record_count} records hold, the last at {r.last_time}")
        out.append(f"head {r.head_hash.hex()} under rules {r.rules_hash.hex()}")
    marks = {"retracted": r.retracted, "tainted": r.tainted, "standing-compromised": r.standing.compromised, "standing-unsound": r.standing.unsound}
    out += [f"{name} {x.hex()}" for name, ids in marks.items() for x in sorted(ids)]
    for p in r.profiles:
        failed = [c for c, ok in p["clauses"].items() if not ok]
        out.append(f"profile {p['id']} {p['status']}" + (f", fails {' '.join(failed)}" if failed else ""))
    return "\n".join(out)


def lineage(q: Queries, x: bytes) -> dict[str, Any]:
    """Ancestors by parent alone, children by parent or cause, siblings by parent; no filter on acceptance."""
    data = {r.id: q.ledger.data(r) for r in q.ledger.by_id.values() if r.kind in ("Candidate", "Selection")}
    candidates = {i: d for i, d in data.items() if d and "basis" in d}
    chosen = lambda d: d["outcome"]["selected"]["candidates"] if isinstance(d["outcome"], dict) else []
    chain, at = [], candidates.get(x, {}).get("parent")
    while at is not None and at not in chain:
        chain.append(at)
        at = candidates.get(at, {}).get("parent")
    hexed = lambda ids: [i.hex() for i in ids]
    parent = candidates.get(x, {}).get("parent")
    selections = {i: d for i, d in data.items() if d and "considered" in d}
    return {
        "ancestors": hexed(chain),
        "children": hexed(c for c, d in candidates.items() if d["parent"] == x or x in q.ledger.by_id[c].targets("Cause")),
        "siblings": hexed(c for c, d in candidates.items() if parent is not None and c != x and d["parent"] == parent),
        "considered_by": hexed(s for s, d in selections.items() if x in d["considered"]),
        "selected_by": hexed(s for s, d in selections.items() if x in chosen(d)),
    }


def _hashes(value: Any) -> Any:
    """The same value with hex of 32 bytes read as bytes and lists as tuples."""
    if isinstance(value, str):
        return unhex(value) or value
    return tuple(map(_hashes, value)) if isinstance(value, list) and all(isinstance(x, str) for x in value) else value


def _write(args: argparse.Namespace, dialect: Dialect) -> int:
    from ledgerloom.sources.authoring import Author
    from ledgerloom.sources.frames import FrameError
    from ledgerloom.sources.writer import LogError, LogWriter, export

    try:
        with open(args.rules, "rb") as f:
            rules = Rules.read(loads(f.read()))
    except OSError:
        return 66
    except ValueError:
        return 65
    try:
        seed = unhex(getattr(args, "seed", None))
        with LogWriter(args.log, rules, dialect, seeds={args.actor: seed} if seed else None) as writer:
            if args.verb == "export":
                with contextlib.ExitStack() as files:
                    tables = [json.load(files.enter_context(open(t))) for t in args.profile]
                sys.stdout.write(export(writer, tables).decode())
                return 0
            thread, given = unhex(args.thread), json.loads(args.args)
            if thread is None or not isinstance(given, dict):
                return 64
            done = getattr(Author(writer, args.actor, args.role, thread), args.record)(**{k: _hashes(v) for k, v in given.items()})
    except (TypeError, ValueError) as e:
        print(json.dumps({"error": str(e)}))
        return 65 if isinstance(e, FrameError) else 64
    except LogError as e:
        print(json.dumps({"error": str(e)}))
        return 65
    print(json.dumps({"id": done.id.hex(), "time": done.time, "result": done.result, "reason": done.reason}))
    return 0 if done.reason is None else 1


def _rules(args: argparse.Namespace, dialect: Dialect) -> int:
    """Print a rules document made from flags."""
    roles, floors = (dict(x.partition("=")[::2] for x in given) for given in (args.role, args.threshold))
    keys: dict[str, set] = {}
    for actor, _, key in (x.partition("=") for x in args.key):
        keys.setdefault(actor, set()).add(unhex(key))
    known = set(roles.values()) <= set(AUTHOR_TYPES) and set(floors) <= set(KINDS) and set(floors.values()) <= set(EVIDENCE)
    if not known or any(None in found for found in keys.values()):
        return 64
    made = Rules.default(
        dialect, max_context_records=args.max_context, baseline=not args.no_baseline, author_roles=roles, admin_retraction_actors=set(args.admin),
        author_keys=keys, signature_required_kinds=set(args.sign), reaffirmation_actors=set(args.reaffirmer), min_binding=args.min_binding,
        max_considered=args.max_considered, selection_requires_approval=args.selection_approval,
        reject_compromised_continuation=args.reject_compromised, selection_requires_evaluation=not args.no_evaluation,
    )
    made.evidence_thresholds |= floors
    print(dumps(made.written()).decode())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom", exit_on_error=False)
    parser.add_argument("--namespace", default="ledgerloom", help="prefix of the schema names that the ledger hashes")
    verbs = parser.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("validate")
    v.add_argument("receipt")
    v.add_argument("--json", action="store_true")
    v.add_argument("--max-size", type=int, default=Limits.max_bytes)
    v.add_argument("--table", action="append", default=[], help="file of a profile's clause table")
    v.add_argument("--require-profile", action="append", default=[])
    q = verbs.add_parser("query")
    q.add_argument("name", choices=QUERIES)
    q.add_argument("receipt", help="a receipt, or a log file with --rules")
    q.add_argument("--rules", help="file of the rules that a log file was kept under")
    q.add_argument("argument", nargs="?", help="id in hex, or the objective for selected")
    r = verbs.add_parser("rules")
    r.add_argument("--role", action="append", default=[], metavar="ACTOR=TYPE")
    r.add_argument("--admin", action="append", default=[])
    r.add_argument("--max-context", type=int, default=100)
    r.add_argument("--key", action="append", default=[], metavar="ACTOR=HEX", help="a key that an actor signs with")
    r.add_argument("--sign", action="append", default=[], choices=KINDS, help="a kind that must be signed")
    r.add_argument("--threshold", action="append", default=[], metavar="KIND=EVIDENCE")
    r.add_argument("--no-baseline", action="store_true", help="leave out the baseline thresholds")
    r.add_argument("--reaffirmer", action="append", default=[])
    r.add_argument("--min-binding", choices=("reported", "manifest"), default="reported")
    r.add_argument("--max-considered", type=int, default=4096)
    for flag in ("--selection-approval", "--reject-compromised", "--no-evaluation"):
        r.add_argument(flag, action="store_true")
    for verb in ("add", "export"):
        w = verbs.add_parser(verb)
        w.add_argument("--log", required=True, help="folder of the log")
        w.add_argument("--rules", required=True, help="file of the rules")
        if verb == "add":
            w.add_argument("record", choices=ADD)
            w.add_argument("--actor", required=True)
            w.add_argument("--role", required=True, choices=AUTHOR_TYPES)
            w.add_argument("--thread", required=True, help="64 hex digits")
            w.add_argument("--seed", help="signing seed, 64 hex digits")
            w.add_argument("--args", default="{}", help="the method's arguments as JSON; ids and hashes in hex")
        else:
            w.add_argument("--profile", action="append", default=[], help="file of the clause table of a profile to declare")
    k = verbs.add_parser("key")
    k.add_argument("seed", help="64 hex digits")
    try:
        args = parser.parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as e:
        return 0 if isinstance(e, SystemExit) and e.code == 0 else 64
    dialect = Dialect(args.namespace)
    if args.verb == "rules":
        return _rules(args, dialect)
    if args.verb == "key":
        seed = unhex(args.seed)
        if seed is None:
            return 65
        print(ed25519.public_key(seed).hex())
        return 0
    if args.verb in ("add", "export"):
        return _write(args, dialect)
    try:
        with open(args.receipt, "rb") as f:
            data = f.read(getattr(args, "max_size", Limits.max_bytes) + 1)
    except OSError:
        return 66
    if args.verb == "validate":
        try:
            tables = {t["id"]: t for t in (json.load(open(p)) for p in args.table)}  # noqa: SIM115
        except (OSError, ValueError, KeyError):
            return 66
        if len(data) > args.max_size:
            return 66
        report = validate(data, dialect, Limits(max_bytes=args.max_size), args.require_profile, tables)
        print(json.dumps(_report_row(report)) if args.json else _text(report))
        met = {p["id"]: Profiles.met(p) for p in report.profiles}
        unmet = not all(met.get(p, False) for p in args.require_profile)
        return 1 if report.status == "Invalid" else 3 if unmet else 2 if report.status == "Tainted" else 0
    try:
        if args.rules:
            with open(args.rules, "rb") as f:
                verdict = replay(read_log(data)[0], Rules.read(loads(f.read())), dialect)
        else:
            _, _, verdict = open_receipt(data, dialect)
    except OSError:
        return 66
    except ValueError:
        return 65
    try:
        if verdict is None:
            raise QueryError("LogInvalid")
        queries = Queries(verdict)
        if args.name == "frontier":
            answer = queries.frontier()
        elif args.name == "selected":
            answer = queries.selected(args.argument or "")
        else:
            x = unhex(args.argument)
            if x is None:
                return 64
            answer = lineage(queries, x) if args.name == "lineage" else getattr(queries, args.name)(x)
    except QueryError as e:
        print(json.dumps({"error": str(e)}))
        return 65
    print(json.dumps(answer))
    return 0


if __name__ == "__main__":
    sys.exit(main())

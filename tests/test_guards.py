"""The writer's guards and recovery, manifests, notes and the command line over logs."""

import json
import os

import pytest

from ledgerloom.__main__ import main
from ledgerloom.functions.records import Receipt
from ledgerloom.operators.judge import State
from ledgerloom.operators.receipts import validate
from ledgerloom.plans import scripted
from ledgerloom.sources.manifest import Entry, scan
from ledgerloom.sources.writer import LogError, LogWriter, Proposal, export

ASK = Proposal(scripted.THREAD, "ann", "User", "request.v1", scripted._request())


def opened(folder):
    return LogWriter(str(folder), scripted.Script().rules, scripted.DIALECT)


@pytest.mark.parametrize("landed", [0, 3, 700, 10**6])
def test_a_decided_pair_is_completed(tmp_path, landed):
    with opened(tmp_path) as w:
        w.commit(ASK)
        size = w.size
        done = w.commit(ASK)
    data = (tmp_path / "log").read_bytes()
    pair = data[size:]
    (tmp_path / "intent").write_bytes(size.to_bytes(8, "big") + pair)  # a crash after so many bytes
    (tmp_path / "log").write_bytes(data[: size + landed])
    with opened(tmp_path) as w:
        assert (tmp_path / "log").read_bytes() == data and w.records[2].id == done.id
    assert not (tmp_path / "intent").exists()


def test_an_intent_that_does_not_fit(tmp_path):
    with opened(tmp_path) as w:
        w.commit(ASK)
        size = w.size
    for told in ((size + 5).to_bytes(8, "big") + b"x", (size - 5).to_bytes(8, "big") + b"other"):
        (tmp_path / "intent").write_bytes(told)
        with pytest.raises(LogError) as e:
            opened(tmp_path)
        assert e.value.code == "CorruptedRecovery"


def test_guards(tmp_path, monkeypatch):
    with opened(tmp_path) as w:
        w.commit(ASK, state=State())
        with pytest.raises(LogError, match="StateMismatch"):
            w.commit(ASK, state=State())
        w.commit(ASK, state=w.ledger.state)
        with pytest.raises(LogError) as e:
            w.checked_batch_commit([ASK], bytes(32))
        assert e.value.actual == w.head and e.value.expected == bytes(32)

        def fail(*_):
            raise OSError

        monkeypatch.setattr(os, "fsync", fail)
        with pytest.raises(OSError):
            w.commit(ASK)
        monkeypatch.undo()
        with pytest.raises(LogError, match="RecoveryRequired"):
            w.commit(ASK)
    with opened(tmp_path) as w:
        assert len(w.records) in (4, 6)
        w.rules.max_considered = 7
        with pytest.raises(LogError, match="RulesMismatch"):
            w.commit(ASK)


def test_manifests_hold_every_gitlink(tmp_path):
    (tmp_path / "f").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g").write_text("y")
    os.mkfifo(tmp_path / "pipe")
    oid = "ab" * 20
    assert scan(str(tmp_path), {"sub": oid, "gone/sub": oid}) == [Entry.file("f", b"x"), Entry.gitlink("gone/sub", oid), Entry.gitlink("sub", oid)]
    with pytest.raises(ValueError):
        scan(str(tmp_path), {"f": oid})


def test_notes_and_bindings():
    made = {p["id"]: p["notes"] for p in validate(export(scripted._delivery(scripted.Script())), scripted.DIALECT, profiles=("core", "delivery"), tables=scripted.TABLES).profiles}
    assert made == {"core": {"B5": "admins: ann; reaffirmers: ", "B6": "manifest: 0; reported: 1"}, "delivery": {"D5": "weakest basis: recomputed"}}
    s = scripted.Script()
    q = s.require(s.request())
    c = s.candidate(artifacts=[scripted.ART])
    e = s.evaluate2(c, (q,))
    node = s.queries().node
    assert node(c)["artifacts"] == [scripted.ART] == node(e)["artifacts"] and node(e)["requirements"] == [q.hex()] and node(q)["artifacts"] == []


def test_command_line_over_logs(tmp_path, capsys):
    run = lambda *a: (main(["--namespace", "scripted", *map(str, a)]), capsys.readouterr().out)
    code, out = run("rules", "--role", "ann=User", "--role", "pat=Provider", "--admin", "ann", "--key", "exe=" + "ab" * 32, "--sign", "Usage", "--threshold", "Request=Reported", "--reaffirmer", "ann", "--reject-compromised")
    made = json.loads(out)
    assert code == 0 and made["evidence_thresholds"]["Request"] == "Reported" and made["author_keys"] == {"exe": [[0xAB] * 32]}
    assert made["signature_required_kinds"] == ["Usage"] and made["reject_compromised_continuation"] and not made["selection_requires_approval"]
    assert run("rules", "--key", "exe=12")[0] == run("rules", "--threshold", "Request=Best")[0] == 64
    (tmp_path / "rules.json").write_text(out)
    (tmp_path / "core.json").write_text(json.dumps(scripted.CORE))
    log = ("--log", tmp_path / "l", "--rules", tmp_path / "rules.json")
    by = ("--actor", "pat", "--role", "Provider", "--thread", "02" * 32)
    code, out = run("add", "candidate", *log, *by, "--args", json.dumps({"tree": "ab" * 20}))
    one = json.loads(out)["id"]
    assert code == 0
    code, out = run("query", "frontier", tmp_path / "l" / "log", "--rules", tmp_path / "rules.json")
    assert code == 0 and [x["id"] for x in json.loads(out)] == [one]
    (tmp_path / "odd").write_bytes(b"\0\0\0\2{}")  # a frame that is no record
    assert run("query", "frontier", tmp_path / "odd", "--rules", tmp_path / "rules.json")[0] == 65
    code, out = run("export", *log, "--profile", tmp_path / "core.json")
    assert [p["id"] for p in Receipt.from_bytes(out.encode()).profiles] == ["core"]
    (tmp_path / "r").write_text(out)
    assert run("validate", tmp_path / "r", "--table", tmp_path / "core.json", "--require-profile", "core")[0] == 0

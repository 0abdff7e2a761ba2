import dataclasses
import json

import pytest

from ledgerloom.__main__ import main
from ledgerloom.operators.checkpoints import TrustedCheckpoint, create, replay_from
from ledgerloom.operators.judge import replay
from ledgerloom.sources.writer import export
from tests.test_ledger import TABLES, D, Log, broken_benchmark, log  # noqa: F401


def test_cli(log, tmp_path, capsys):  # noqa: F811
    n = broken_benchmark(log)
    path, table = tmp_path / "r.json", tmp_path / "t.json"
    path.write_bytes(export(log.w))
    table.write_text(json.dumps(TABLES["delivery"]))
    run = lambda *a: (main(["--namespace", "example", *map(str, a)]), capsys.readouterr().out)
    code, out = run("validate", path)
    assert code == 2 and "status:          TAINTED" in out
    assert run("validate", path, "--require-profile", "delivery", "--table", table)[0] == 3
    code, out = run("validate", path, "--json")
    assert json.loads(out)["unsound"] == [n["s0"].hex()]
    assert run("validate", tmp_path / "none")[0] == 66 and run("validate", path, "--max-size", 5)[0] == 66
    assert main(["validate", str(path)]) == 1  # another namespace knows none of the schemas
    capsys.readouterr()
    code, out = run("query", "descent", path, n["c4"].hex())
    assert code == 0 and [x["id"] for x in json.loads(out)] == [n["c0"].hex()]
    assert run("query", "descent", path, "00" * 32)[0] == 65 and run("query", "descent", path, "xx")[0] == 64
    found = json.loads(run("query", "lineage", path, n["c0"].hex())[1])
    assert found["children"] == [n["c1"].hex(), n["c4"].hex()] and found["selected_by"] == [n["s0"].hex(), n["s1"].hex()]
    assert len(json.loads(run("query", "frontier", path)[1])) == 6 and len(json.loads(run("query", "selected", path, "adopt-baseline")[1])) == 2
    code, out = run("rules", "--role", "a=User")
    assert code == 0 and json.loads(out)["author_roles"] == {"a": "User"}
    assert run("rules", "--role", "a=King")[0] == 64 and run("nothing")[0] == 64 and run("key", "0")[0] == 65
    assert run("key", "9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")[1].startswith("d75a98")


def test_checkpoints(log):  # noqa: F811
    broken_benchmark(log)
    records, rules = log.w.records, log.w.rules
    trusted = TrustedCheckpoint.from_verified_log(records[:12], rules, D)
    got, whole = replay_from(records, trusted, rules, D), replay(records, rules, D)
    assert got.accepted and create(records, got.ledger) == create(records, whole.ledger)
    for change in ({"length": 11}, {"length": 10}, {"last_time": 1}, {"last_id": bytes(32)}, {"state_hash": bytes(32)}, {"log_hash": bytes(32)}):
        wrong = TrustedCheckpoint.assume_verified(dataclasses.replace(trusted.checkpoint, **change), rules)
        assert replay_from(records, wrong, rules, D).reason == "InvalidCheckpoint"
    other = dataclasses.replace(rules, max_considered=1)
    assert replay_from(records, trusted, other, D).reason == "InvalidCheckpoint"
    with pytest.raises(TypeError):
        TrustedCheckpoint(trusted.checkpoint, rules.hash())
    with pytest.raises(ValueError):
        TrustedCheckpoint.from_verified_log(records[:3], rules, D)


def test_cli_writes_a_log(tmp_path, capsys):
    def run(*a):
        code = main(["--namespace", "example", *map(str, a)])
        out = capsys.readouterr().out
        return code, out

    code, text = run("rules", "--role", "human=User", "--role", "agent=Provider")
    (tmp_path / "rules.json").write_text(text)
    at = ("--log", tmp_path / "log", "--rules", tmp_path / "rules.json")
    by = lambda who, role: (*at, "--actor", who, "--role", role, "--thread", "02" * 32)
    code, out = run("add", "request", *by("human", "User"), "--args", json.dumps({"objective": "o", "scope": "0a" * 32}))
    request = json.loads(out)["id"]
    code, out = run("add", "candidate", *by("agent", "Provider"), "--args", json.dumps({"tree": "ab" * 20, "request": request}))
    assert (code, json.loads(out)["time"]) == (0, 3)
    code, out = run("add", "retract", *by("human", "User"), "--args", json.dumps({"target": json.loads(out)["id"], "reason": "r"}))
    assert (code, json.loads(out)["reason"]) == (1, "AuthorRoleInvalid")
    assert run("add", "request", *by("human", "User"), "--args", "{}")[0] == 64
    code, out = run("export", *at)
    (tmp_path / "r.json").write_text(out)
    assert code == 0 and run("validate", tmp_path / "r.json")[0] == 0
    assert run("export", "--log", tmp_path / "log", "--rules", tmp_path / "none")[0] == 66

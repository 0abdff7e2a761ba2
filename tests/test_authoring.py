import pytest

from ledgerloom.sources.authoring import Author
from tests.test_ledger import SCOPE, THREAD, log  # noqa: F401

TREE = "ab" * 20


def test_a_line_of_development(log):  # noqa: F811
    human, agent, host = (Author(log.w, a, r, THREAD) for a, r in (("human", "User"), ("agent", "Provider"), ("host", "System")))
    r = human.request("o", SCOPE, {"a.txt": "x"}).id
    need = human.requirement(r, "k", "d").id
    c0 = agent.candidate(TREE, request=r).id
    art = {"scheme": "sha256-bytes", "digest": "ab" * 32, "name": None}
    e = host.evaluate(c0, "tests", "passed", evaluator={"id": "e"}, evidence=[art], requirements=(need,)).id
    s = agent.select("adopt", (c0,), (c0,), (e,)).id
    c1 = agent.candidate(TREE, continues=s, parent=c0).id
    up = agent.candidate(TREE, upgrades=c1, manifest_hash=SCOPE).id
    host.evaluate(c1, "speed", {"scored": {"value": 930, "scale": 3}})
    human.retract(e, "broken")
    assert all(x in log.w.ledger.state.accepted for x in (r, need, c0, e, s, c1, up))
    assert [n["id"] for n in log.w.queries().descent(up)] == [x.hex() for x in (c1, s, c0)]
    assert log.w.queries().standing(c1)["standing"] == "compromised"
    assert host.select("adopt", (c1,)).reason is None
    for wrong in ({"continues": s}, {"derives": (c0,), "upgrades": c1}, {"upgrades": s}):
        with pytest.raises(ValueError):
            agent.candidate(TREE, **wrong)
    with pytest.raises(ValueError):
        agent.candidate("cd" * 20, upgrades=c1)
    with pytest.raises(ValueError):
        host.evaluate(c0, "c", "passed", attested=True)

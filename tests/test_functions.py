import json
import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions import ed25519
from ledgerloom.functions.canonical import CanonicalError, dumps, loads, sha256, unhex
from ledgerloom.functions.schemas import Dialect, artifacts_ok, decode, is_canonical


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (411e44, "4.11e+46"), (1e21, "1e+21"), (1.5, "1.5"), (-0.0, "0"), (1e-7, "1e-7"), (0.000001, "0.000001"), (5e-324, "5e-324"),
        (123456789.25, "123456789.25"), (100.0, "100"), ("\u001f\"\\\n", '"\\u001f\\"\\\\\\n"'), ({"b": 1, "a": [None, True]}, '{"a":[null,true],"b":1}'),
        ({"": 1, "\U0001d306": 2}, '{"\U0001d306":2,"":1}'), (b"\x01\xff", "[1,255]"),
    ],
)
def test_canonical_form(value, text):
    assert dumps(value).decode() == text


@pytest.mark.parametrize("value", [2**53, -(2**53), math.nan, math.inf, float(2**60), "\ud800", object()])
def test_no_canonical_form(value):
    with pytest.raises(CanonicalError):
        dumps(value)


@pytest.mark.parametrize("text", [b'{"a":1,"a":2}', b"NaN", b"\xff", b"[1,]", b""])
def test_strict_reading_refuses(text):
    with pytest.raises(CanonicalError):
        loads(text)


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_doubles_read_back(x):
    if x == 0 or not 2**53 <= abs(x) < 1e21:
        assert struct.pack("d", float(json.loads(dumps(x)))) == struct.pack("d", x + 0.0 if x else 0.0)


def test_ed25519_vectors_and_strictness():
    # RFC 8032, section 7.1, tests 1 and 2.
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = ed25519.public_key(seed)
    assert key.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = ed25519.sign(seed, b"")
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert ed25519.verify(key, b"", sig)
    assert not ed25519.verify(key, b"x", sig)
    order = 2**252 + 27742317777372353535851937790883648493
    high = sig[:32] + (int.from_bytes(sig[32:], "little") + order).to_bytes(32, "little")
    assert not ed25519.verify(key, b"", high)
    small = bytes([1] + [0] * 31)  # the neutral point
    assert not ed25519.verify(small, b"", small + bytes(32))


def test_hex_and_schema_ids():
    assert unhex("00" * 32) == bytes(32)
    assert unhex("AA" * 32) is None and unhex("00") is None
    d = Dialect("example")
    assert d.schema_id("request.v1") == sha256(b"example.request.v1")
    assert len(d.known("0.4")) == 20 and len(d.known("0.3")) == 17 and d.known("0.2") is None


def test_payloads_are_strict():
    good = {"request_id": list(range(32)), "content": "x", "turn_index": 0, "closes_request": False}
    assert is_canonical("response.v1", dumps(good))
    assert decode("response.v1", json.dumps(good).encode()) is not None  # decodes, though not canonical
    assert not is_canonical("response.v1", json.dumps(good).encode())
    for bad in ({"turn_index": -1}, {"turn_index": 2**32}, {"turn_index": True}, {"turn_index": 1.0}, {"more": 1}, {"request_id": [1]}):
        assert decode("response.v1", json.dumps(good | bad).encode()) is None
    result = {"action_id": [0] * 32, "status": "Success", "output": ""}
    assert is_canonical("result.v1", dumps(result))
    assert not is_canonical("result.v1", dumps(result | {"artifacts": None}))


def test_artifacts():
    a = {"scheme": "sha256-bytes", "digest": "ab" * 32, "name": None}
    assert artifacts_ok([a, a | {"name": "x"}])
    assert not artifacts_ok([a, a])
    assert not artifacts_ok([a | {"digest": "ab"}])
    assert artifacts_ok([a | {"scheme": "other", "digest": "ab" * 20}]) and not artifacts_ok([a | {"scheme": "Other"}])


def test_random_bytes_never_crash():
    rng = random.Random(1)
    for _ in range(3000):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        for name in ("plan.v1", "selection.v1"):
            decode(name, data)

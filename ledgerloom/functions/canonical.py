"""Canonical JSON (RFC 8785), strict JSON reading and content hashes.

Spark's own JSON functions print doubles differently, sort keys by UTF-8 and
accept repeated keys, so the byte-exact steps are here, in plain Python, and
run inside Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

SAFE = (1 << 53) - 1
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


class CanonicalError(ValueError):
    """A value that has no canonical form, or text that isn't strict JSON."""


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, value in pairs:
        if name in out:
            raise CanonicalError(f"duplicate field `{name}`")
        out[name] = value
    return out


def _refuse(name: str) -> None:
    raise CanonicalError(f"{name} is not JSON")


def loads(data: bytes) -> Any:
    """Strict JSON: UTF-8 without lone surrogates, no repeated keys, no NaN."""
    try:
        text = data.decode("utf-8")
        value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_refuse)
        text if "\\u" not in text else json.dumps(value, ensure_ascii=False).encode("utf-8")
        return value
    except (UnicodeError, RecursionError, ValueError) as e:
        raise CanonicalError(str(e)) from None


def _string(s: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def _double(x: float) -> str:
    """A double as ECMAScript prints it."""
    if x != x or x in (float("inf"), float("-inf")):
        raise CanonicalError("not a finite number")
    if x == 0:
        return "0"
    if SAFE < abs(x) < 1e21:
        raise CanonicalError("a double beyond the safe integers")
    sign, digits, point = "-" * (x < 0), *_shortest(abs(x))
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    power = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}{power}"


def _shortest(x: float) -> tuple[str, int]:
    """Shortest digits that read back as ``x``, and where its point is."""
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    point = len(whole) + int(exponent or 0)
    digits = whole + part
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    return stripped.rstrip("0"), point


def dumps(value: Any) -> bytes:
    """The canonical bytes of a JSON value; ``bytes`` count as arrays of numbers."""

    def put(v: Any) -> str:
        if v is None:
            return "null"
        if v is True or v is False:
            return "true" if v else "false"
        if isinstance(v, str):
            return _string(v)
        if isinstance(v, int):
            if abs(v) > SAFE:
                raise CanonicalError("an integer beyond the safe range")
            return str(v)
        if isinstance(v, float):
            return _double(v)
        if isinstance(v, bytes):
            return "[" + ",".join(map(str, v)) + "]"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(put, v)) + "]"
        if isinstance(v, dict):
            keys = sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
            return "{" + ",".join(f"{_string(k)}:{put(v[k])}" for k in keys) + "}"
        raise CanonicalError(f"{type(v).__name__} has no JSON form")

    try:
        return put(value).encode("utf-8")
    except (UnicodeError, RecursionError) as e:
        raise CanonicalError(str(e)) from None


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def canonical_hash(value: Any) -> bytes:
    """SHA-256 of the canonical bytes."""
    return sha256(dumps(value))


def chain_hash(ids: list[bytes]) -> bytes:
    """SHA-256 over ids one after the other: the hash of a log's head."""
    return sha256(b"".join(ids))


def unhex(text: Any) -> bytes | None:
    """32 bytes from exactly 64 lower-case hex digits, else nothing."""
    if isinstance(text, str) and len(text) == 64 and all(c in "0123456789abcdef" for c in text):
        return bytes.fromhex(text)
    return None

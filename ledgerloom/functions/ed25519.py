"""Ed25519 (RFC 8032) with strict verification, in plain Python.

Strict means: the key and the signature's point must decode, neither may have
small order, and the scalar must be below the group's order.
"""

from __future__ import annotations

import hashlib

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)
Point = tuple[int, int, int, int]
_ZERO: Point = (0, 1, 1, 0)


def _add(a: Point, b: Point) -> Point:
    x, y = (a[1] - a[0]) * (b[1] - b[0]) % _P, (a[1] + a[0]) * (b[1] + b[0]) % _P
    t, z = 2 * a[3] * b[3] * _D % _P, 2 * a[2] * b[2] % _P
    e, f, g, h = y - x, z - t, z + t, y + x
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(k: int, point: Point) -> Point:
    out = _ZERO
    while k:
        if k & 1:
            out = _add(out, point)
        point = _add(point, point)
        k >>= 1
    return out


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % _P == 0 and (a[1] * b[2] - b[1] * a[2]) % _P == 0


def _decode(data: bytes) -> Point | None:
    number = int.from_bytes(data, "little")
    y, sign = number & ((1 << 255) - 1), number >> 255
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P or (x == 0 and sign):
        return None
    if x & 1 != sign:
        x = _P - x
    return x, y, 1, x * y % _P


def _encode(point: Point) -> bytes:
    z = pow(point[2], _P - 2, _P)
    x, y = point[0] * z % _P, point[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


_BASE = _decode((4 * pow(5, _P - 2, _P) % _P).to_bytes(32, "little"))


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)
    return a, h[32:]


def _scalar(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def public_key(seed: bytes) -> bytes:
    return _encode(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _encode(_times(a, _BASE))
    r = _scalar(prefix, message)
    point = _encode(_times(r, _BASE))
    return point + ((r + _scalar(point, key, message) * a) % _L).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Strict verification; false for anything malformed."""
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _decode(key), _decode(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    if any(_same(_times(8, p), _ZERO) for p in (a, r)):
        return False
    k = _scalar(signature[:32], key, message)
    return _same(_times(s, _BASE), _add(r, _times(k, a)))

"""Content-defined segments of token sequences, for finding long repeats exactly.

A *window* is ``length`` consecutive tokens (bytes or words) of one document.
Hashes of grams of ``gram`` tokens are built by doubling: the bucket of depth
2d at p comes from the buckets of depth d at p and p + d.  The *anchor* of a
window is the least gram hash inside it, so equal windows have equal anchors
wherever they stand.  Consecutive windows with one anchor form a *segment*:
about 2 / (length - gram + 2) segments a token instead of one window a token.
Equal segments have all windows in common, and equal windows always lie in
segments with one anchor; comparing segments by anchor therefore misses none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; the order counts."""
    return mixed(left * _A + (right ^ (right >> U(29))) * _B)


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (8, 16 or 32) at each position; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 2 * gram + 16, np.uint8)
    padded[:n] = data
    eight = np.empty(n + gram, U)
    for s in range(8):
        part = eight[s::8]
        part[:] = np.frombuffer(padded, U, len(part), s)
    depth, now = 8, mixed(eight)
    while depth < gram:
        now = joined(now[:-depth], now[depth:])
        depth *= 2
    return now[:n] if len(now) >= n else np.concatenate([now, np.zeros(n - len(now), U)])


def word_grams(words: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` words (a power of two) at each position, from word hashes."""
    depth, now = 1, words
    while depth < gram:
        now = joined(now, np.concatenate([now[depth:], np.zeros(min(depth, len(now)), U)]))
        depth *= 2
    return now


def window_hashes(grams: np.ndarray, at: np.ndarray, gram: int, length: int) -> np.ndarray:
    """Hash of the windows at ``at``: grams that cover them, the last one overlapping."""
    out = grams[at]
    for k in [*range(gram, length - gram, gram), length - gram]:
        out = joined(out, grams[at + k])
    return out


@dataclass
class Segments:
    """Segments of a batch of documents, in order."""

    doc: np.ndarray  # index of the document in the batch
    start: np.ndarray  # of the first window, in the document's tokens
    count: np.ndarray  # of windows, at most ``length - gram + 1``
    anchor: np.ndarray
    digest: np.ndarray  # of all tokens that the windows cover
    place: np.ndarray  # of the anchor, from ``start``
    left: np.ndarray  # 12 bits of the gram that ends where the anchor begins, or NONE
    right: np.ndarray  # 12 bits of the gram that begins where the anchor ends, or NONE
    tied: np.ndarray  # whether the anchor stands there more than once

    def take(self, at: np.ndarray) -> Segments:
        return Segments(*(getattr(self, k)[at] for k in self.__dataclass_fields__))


#: Mark of a context that a document's edge cuts off.
NONE = 0xFFF
_LOW = U(63)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if width > span:
        x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
    return x


def segments(grams: np.ndarray, offsets: np.ndarray, gram: int, length: int) -> Segments:
    """Segments of documents that take ``offsets[i]:offsets[i+1]`` of the tokens.

    ``length - gram`` is below 64: a gram's place modulo 64 stands in the low
    bits of its hash, which tells where in a window the least one is.
    """
    width = length - gram + 1
    n = len(grams)
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        none, word, short = np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.uint16)
        return Segments(none, none, none, word, word, none, short, short, short.astype(bool))
    place = np.arange(n, dtype=U) & _LOW
    high = grams & ~_LOW
    least = _sliding_least(high | place, width)
    other = _sliding_least(high | (_LOW - place), width)
    value = least & ~_LOW
    has = sizes >= length
    first, stop = offsets[:-1][has], offsets[1:][has] - length + 1
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.subtract.at(edge, stop, 1)
    valid = np.cumsum(edge[: len(value)]) > 0
    new = np.empty(len(value), bool)
    new[0] = True
    np.not_equal(value[1:], value[:-1], out=new[1:])
    new[first] = True
    starts = np.flatnonzero(new & valid)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    after = np.concatenate([starts[1:], [n]])
    count = np.minimum(after, offsets[doc + 1] - length + 1) - starts
    if (count > width).any():  # one gram that comes again and again
        times = -(-count // width)
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, doc, count = (np.repeat(x, times) for x in (starts, doc, count))
        count = np.minimum(count - part * width, width)
        starts = starts + part * width
    last = starts + count - 1
    digest = joined(window_hashes(grams, starts, gram, length), window_hashes(grams, last, gram, length) + count.astype(U))
    at = starts + ((least[starts] - starts.astype(U)) & _LOW).astype(np.int64)
    same = [
        starts + ((_LOW - (other[starts] & _LOW) - starts.astype(U)) & _LOW).astype(np.int64),
        last + ((least[last] - last.astype(U)) & _LOW).astype(np.int64),
        last + ((_LOW - (other[last] & _LOW) - last.astype(U)) & _LOW).astype(np.int64),
    ]
    tied = (same[0] != at) | (same[1] != at) | (same[2] != at)
    before, behind = at - gram, at + gram
    left = np.where(before >= offsets[doc], ((grams[np.maximum(before, 0)] >> U(40)) % U(NONE)).astype(np.uint16), NONE)
    right = np.where(
        behind + gram <= offsets[doc + 1], ((grams[np.minimum(behind, n - 1)] >> U(40)) % U(NONE)).astype(np.uint16), NONE
    )
    return Segments(doc, starts - offsets[doc], count, value[starts], digest, at - starts, left, right, tied)

"""Texts of an Arrow column as token sequences: bytes, or hashes of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerloom.llm import spans
from ledgerloom.llm.spans import U

#: Tokens worked on at a time; longer texts are cut with an overlap.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RATIO = 0x5851F42D4C957F2D
_BYTE = spans.mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, without copying; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), bounds.astype(np.int64)


def pieces(bounds: np.ndarray, length: int, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``most`` tokens: (document, begin, end) of each.

    A longer document comes in pieces that overlap by ``length - 1``, so each of
    its windows lies in one piece.
    """
    group: list[tuple[int, int, int]] = []
    held = 0
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a < length:
            continue
        while b - a > 2 * most:
            yield np.array([i]), np.array([a]), np.array([a + most + length - 1])
            a += most
        group.append((i, a, b))
        held += b - a
        if held >= most:
            yield tuple(np.array(group).T)
            group, held = [], 0
    if group:
        yield tuple(np.array(group).T)


def gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    return np.concatenate([data[a:b] for a, b in zip(begin.tolist(), end.tolist())]), offsets


def batch_segments(column: pa.Array, length: int, gram: int, unit: str) -> spans.Segments:
    """Segments of all texts of an Arrow column; ``doc`` is the row."""
    data, bounds = read(column, unit)
    parts = []
    for doc, begin, end in pieces(bounds, length):
        part, offsets = gathered(data, begin, end)
        found = spans.segments(grams(part, gram, unit), offsets, gram, length)
        found.start = found.start + (begin - bounds[doc])[found.doc]
        found.doc = doc[found.doc]
        parts.append(found)
    if not parts:
        return spans.segments(np.empty(0, U), np.zeros(1, np.int64), gram, length)
    return spans.Segments(*(np.concatenate([getattr(p, k) for p in parts]) for k in spans.Segments.__dataclass_fields__))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a string column, and each text's offsets in them.

    Words end at ASCII white space.  Blocks of about a million bytes bound the
    memory, whatever the length of a text.
    """
    data, bounds = text_bytes(column)
    low, end = int(bounds[0]), int(bounds[-1])
    power = np.full(2 * PIECE + 1, U(_RATIO))
    power[0] = 1
    inverse = np.full(2 * PIECE + 1, U(pow(_RATIO, -1, 1 << 64)))
    inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    hashes, begins = [np.empty(0, U)], [np.empty(0, np.int64)]
    while low < end:
        high = min(low + PIECE, end)
        if high < end:
            edge = int(bounds[np.searchsorted(bounds, high)])
            gap = np.flatnonzero(_SPACE[data[high : min(edge, low + 2 * PIECE)]]) if edge > low + 2 * PIECE else None
            if gap is None:
                high = edge
            elif len(gap):
                high += int(gap[0])
            else:  # a word of a million bytes: on to its end
                while high < edge and not _SPACE[data[high]]:
                    high += 1
        block = data[low:high]
        if len(block) >= len(power):
            power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(block), U(_RATIO))]))
            inverse = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(block), U(pow(_RATIO, -1, 1 << 64)))]))
        word = ~_SPACE[block]
        cut = np.zeros(len(block) + 1, bool)
        inner = bounds[(bounds >= low) & (bounds < high)] - low
        cut[inner] = True
        begin = np.flatnonzero(word & (cut[:-1] | ~np.concatenate([[False], word[:-1]])))
        stop = np.flatnonzero(word & (cut[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        total = np.concatenate([[U(0)], np.cumsum(_BYTE[block] * power[: len(block)], dtype=U)])
        hashes.append(spans.mixed((total[stop] - total[begin]) * inverse[begin] + (stop - begin).astype(U) * U(0x9E3779B97F4A7C15)))
        begins.append(begin + low)
        low = high
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), bounds)


def read(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and offsets; ``unit`` is ``bytes`` or ``words``."""
    return text_bytes(column) if unit == "bytes" else word_hashes(column)


def grams(tokens: np.ndarray, gram: int, unit: str) -> np.ndarray:
    """Hash of the gram at each position."""
    return spans.byte_grams(tokens, gram) if unit == "bytes" else spans.word_grams(tokens, gram)

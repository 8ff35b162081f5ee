"""Whole texts of Arrow batches as byte arrays, scanned with numpy.

UTF-8 lets ASCII classes be tested byte by byte: every byte of a character
outside ASCII is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds; a longer text gets a pass of its own.
PASS_BYTES = 1 << 20

#: The white space of ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at the same six.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
LOWER_WORD = np.zeros(256, bool)
LOWER_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each row; null gives the empty text."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str, holder: int = 0, own: int | None = None) -> pa.Array:
    """A text column: the field ``name`` of the struct at ``holder``, or the column at ``own`` where it travels alone."""
    return batch.column(own) if own is not None else batch.column(holder).field(name)


def passes(rows: list[bytes], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts stay within ``limit`` bytes together."""
    begin = held = 0
    for i, x in enumerate(rows):
        if i > begin and held + len(x) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(x)
    if begin < len(rows):
        yield begin, len(rows)


def joined(rows: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All rows in one array, ``gap`` after each, and where each row begins (one more: the end)."""
    buf = np.frombuffer(gap.join(rows) + gap, np.uint8)
    begins = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) + len(gap), out=begins[1:])
    return buf, begins


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a finaliser of shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of spans of a byte array, from prefix sums of powers of an odd base."""

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        if len(SpanHash._powers) < n:
            size = max(n, PASS_BYTES + (1 << 16))
            base = np.full(size, self.BASE, np.uint64)
            base[0] = 1
            SpanHash._powers = np.cumprod(base)
            base[1:] = pow(self.BASE, -1, 1 << 64)
            SpanHash._inverse = np.cumprod(base)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self._bytes[buf] * self._powers[: n - 1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[begin]) * self._inverse[begin]
        return mix(value + (end - begin).astype(np.uint64))


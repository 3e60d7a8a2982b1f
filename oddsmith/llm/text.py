"""Vectorised text work inside tasks: documents of an Arrow batch as one byte buffer.

A task walks its batches in blocks of about one megabyte of text, so the arrays
derived from a block (eight bytes for each byte of text at most, a few at a time) stay
small whatever the batch holds; a longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """Some documents: ``data`` holds their UTF-8 bytes, document i is ``data[offsets[i]:offsets[i + 1]]``; a null text is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch, present: np.ndarray):
        self.data, self.offsets, self.rows, self.present = data, offsets, rows, present
        self.n = len(offsets) - 1

    def column(self, name: str) -> pa.Array:
        return self.rows.column(name)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut Arrow batches into blocks of about ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(column)
        present = np.asarray(pc.is_valid(text).to_numpy(zero_copy_only=False))
        text = pc.cast(pc.fill_null(text, ""), pa.large_string())
        _, where, data = text.buffers()
        offsets = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            end = min(end, len(text))
            yield Block(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], batch.slice(at, end - at), present[at:end])
            at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]`` from running sums: equal bytes give equal hashes wherever they lie."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word ``[^\\x20\\x09-\\x0D]+`` and, for each document, the index of its first word (one more at the end)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def sums_by_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for every i; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]

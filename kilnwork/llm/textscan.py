"""Byte-level numpy scanning of Arrow text columns, shared by the operators that work in Arrow batches.

Texts arrive as Arrow strings, so their UTF-8 bytes already lie in one buffer. Everything here works on
that buffer in slices of whole documents (``SLICE`` bytes, or one document if it is longer), so that a
worker's memory is bound by a slice and the longest document, not by a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)

#: ASCII white space of the text contracts: blank and 0x09 to 0x0D. All other bytes belong to words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
#: One random odd 64-bit value for each byte value.
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        n = max(n, SLICE + 1)
        have = np.full(n, _BASE if kind == "up" else _INV)
        have[0] = 1
        have = _powers[kind] = np.cumprod(have, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, z, data[off[a] : off[z]], off[a : z + 1] - off[a]
        a = z


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``inside``, never across rows, and the rows' offsets into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = inside[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    first[edges] = w[edges]
    starts = np.flatnonzero(first)
    last = w.copy()
    last[:-1] &= ~w[1:] | first[1:]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span lies."""
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _power("up", len(data))[: len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def fixed_hash(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` bytes in a row, for each start."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _power("up", len(data))[: len(data)], out=run[1:])
    return mix((run[k:] - run[:-k]) * _power("down", len(data) + 1)[:n])


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive word hashes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = codes[:n].copy()
    for j in range(1, k):
        h *= _STEP
        h += codes[j : j + n]
    return mix(h)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i + 1]], 0 for empty rows."""
    run = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def distinct(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each run of equal values in a sorted array, and the runs' lengths."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(sorted_values)))

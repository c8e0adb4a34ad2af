"""NumPy kernels over the byte buffers of Arrow string columns.

Everything here works on whole texts, a block of rows at a time, and never
decodes a string in Python: words, lines and windows are (start, end) byte
ranges, and equality is tested through 64-bit polynomial hashes of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds at least one row of and otherwise at most.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.RandomState(20240229)
_BYTE_CODE = _rng.randint(1, 1 << 62, size=256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _grow(n: int) -> None:
    """Powers of the hash base and of its inverse, for n positions."""
    global _powers, _inverses
    if len(_powers) >= n:
        return
    n = max(n, 1 << 16)
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.full(n, _U(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    _powers, _inverses = out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class SpanHashes:
    """span_hash of many spans of the same values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        _grow(n + 1)
        self.acc = np.zeros(n + 1, _U)
        np.cumsum(values * _powers[:n], out=self.acc[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.acc[ends] - self.acc[starts]) * _inverses[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every span; equal spans hash alike wherever they lie."""
    return SpanHashes(values)(starts, ends)


def byte_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hash of byte ranges. Ranges in order are hashed a block's worth of bytes at a time: each byte takes 40 bytes of memory meanwhile."""
    if len(buf) <= BLOCK_BYTES or not len(starts) or (starts[1:] < starts[:-1]).any() or (ends[1:] < ends[:-1]).any():
        return span_hash(_BYTE_CODE[buf], starts, ends)
    out, i = np.empty(len(starts), _U), 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + BLOCK_BYTES, "right")))
        out[i:j] = span_hash(_BYTE_CODE[buf[first : ends[j - 1]]], starts[i:j] - first, ends[i:j] - first)
        i = j
    return out


def table(*ranges: tuple[int, int] | int) -> np.ndarray:
    """256 flags: the bytes in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for r in ranges:
        a, b = (r, r) if isinstance(r, int) else r
        out[a : b + 1] = True
    return out


#: Bytes of words for `[^\\x20\\x09-\\x0D]+`: white space is ASCII, so UTF-8 needs no decoding.
NOT_SPACE = ~table(0x20, (0x09, 0x0D))
#: Bytes of words for `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, once A-Z are lower-cased.
ALNUM = ~table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: UTF-8 bytes that begin a code point.
LEADS = ~table((0x80, 0xBF))


class Block:
    """Rows [first, first+n) of an Arrow string column: their bytes and row bounds."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, first: int):
        self.buf, self.bounds, self.first, self.n = buf, bounds, first, len(bounds) - 1

    def segments(self, member: np.ndarray, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of member bytes within rows: starts, ends, and bounds of each row's runs."""
        inside = member[self.buf if buf is None else buf]
        n = len(inside)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.n + 1, np.int64)
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        heads = self.bounds[:-1][self.bounds[:-1] < n]
        before[heads] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        tails = self.bounds[1:][self.bounds[1:] > 0] - 1
        after[tails] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines between newlines: starts, ends (newline left out), bounds of each row's lines. A row has one line at least."""
        cuts = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], cuts + 1]), kind="stable")
        ends = np.sort(np.concatenate([cuts, self.bounds[1:]]), kind="stable")
        per_row = np.searchsorted(cuts, self.bounds[1:]) - np.searchsorted(cuts, self.bounds[:-1]) + 1
        bounds = np.zeros(self.n + 1, np.int64)
        np.cumsum(per_row, out=bounds[1:])
        return starts, ends, bounds

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        return per_row(flags, self.bounds)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, as int64."""
    acc = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[bounds[1:]] - acc[bounds[:-1]]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, given bounds of the rows' items."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def bytes_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row bounds of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, bounds - bounds[0]


def blocks(col: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks of whole rows, about `size` bytes each; a longer row is a block of its own."""
    buf, bounds = bytes_of(col)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(buf[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first)
        first = last


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where k items of one row begin, and the hash of those k items."""
    rows = rows_of(bounds)
    at = np.arange(len(hashes))
    at = at[at + k <= bounds[1:][rows]] if len(hashes) else at
    return at, span_hash(hashes, at, at + k)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the n items that lie in any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start:start+length] of every span, end to end."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return pool[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)] if total else pool[:0]


def distinct(data: np.ndarray, bounds: np.ndarray) -> pa.DictionaryArray:
    """The byte strings data[bounds[i]:bounds[i+1]] as indices into their distinct ones; equality is that of bytes."""
    small = len(data) < 2**31 - 1
    kind, width = (pa.binary(), np.int32) if small else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A string column of data[bounds[i]:bounds[i+1]]."""
    if len(data) < 2**31 - 1:
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))

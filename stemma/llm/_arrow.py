"""Arrow and numpy helpers for text kernels: whole batches of UTF-8 bytes, no per-row Python.

Texts are worked on as the bytes that Arrow hands over. Every word class used in this package is
closed under UTF-8 (bytes of 0x80 and more are word bytes or not, all together), so byte classes
and character classes cut at the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel works on at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

#: Words: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words: digits, small letters and everything beyond ASCII (texts are lower-cased before).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_R = np.uint64(32)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    off = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def padded(data: np.ndarray) -> np.ndarray:
    """A copy with 16 zero bytes behind, so that eight bytes can be loaded at any place."""
    out = np.zeros(len(data) + 16, np.uint8)
    out[: len(data)] = data
    return out


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's first word (texts + 1)."""
    n = len(data)
    w = table[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = w.copy(), w.copy()
    if n:
        start[1:] &= ~w[:-1] | edge[1:n]
        end[:-1] &= ~w[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def loads(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place, little-endian."""
    view = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    return view[at] & _MASK[size]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _R)) * _B
    h = (h ^ (h >> _R)) * _C
    return h ^ (h >> _R)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes. buf: as padded() makes it."""
    ln = e - s
    h = (ln.astype(np.uint64) + np.uint64(seed)) * _A
    h = (h ^ loads(buf, s, np.minimum(ln, 8))) * _B
    h ^= h >> _R
    at, c = np.flatnonzero(ln > 8), 8
    while len(at):
        x = (h[at] ^ loads(buf, s[at] + c, np.minimum(ln[at] - c, 8))) * _B
        h[at] = x ^ (x >> _R)
        c += 8
        at = at[ln[at] > c]
    return mix(h)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A + b
    return (h ^ (h >> _R)) * _B


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each place on, by doubling; len(h) - k + 1 values. Grams may cross texts."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, size, power, rest = None, 0, h, k
    width = 1
    while True:
        if rest & 1:
            out, size = (power, width) if out is None else (_join(power[: len(h) - size - width + 1], out[width : len(h) - size + 1]), size + width)
        rest >>= 1
        if not rest:
            return mix(out)
        power = _join(power[:-width], power[width:])
        width *= 2


def row_of(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(first: np.ndarray, starts: np.ndarray, width) -> np.ndarray:
    """Which words lie in any [start, start + width)."""
    n = int(first[-1])
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + width, -1)
    return np.cumsum(d[:-1]) > 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

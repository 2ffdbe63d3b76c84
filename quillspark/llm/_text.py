"""Vectorised work on the bytes of Arrow text columns.

Whole texts are cut into words, lines and hashes with numpy over the UTF-8
buffer that Arrow hands over, so no Python string is made for a word. A null
text counts as the empty text everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE, _TABLES = 0x9E3779B97F4A7C15 | 1, {}
#: The first k bytes of eight, and the constants of span_hash; longer spans than LONG bytes have a hash of their own.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_STEP, _BLOCK, LONG = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of a 64-bit number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of the rolling hash's base and of its inverse."""
    if len(_TABLES.get("p", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        both = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _TABLES["p"], _TABLES["q"] = both
    return _TABLES["p"], _TABLES["q"]


def prefix_hash(d: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] a rolling hash of bytes i to j, still shifted by i places. Only for choosing places and candidates: it is modulo 2^64, so strings can be made that collide."""
    h = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(_BYTE[d] * powers(len(d) + 1)[0][: len(d)], out=h[1:])
    return h


def rolled(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rolling hash of each span of bytes, from prefix_hash's result; equal bytes, equal hash."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64) * U(0x2545F4914F6CDD1D))


def span_hash(d: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes, mixed after each 8 bytes; spans of up to 8 bytes with one length never share one. Spans over LONG bytes go through BLAKE2b. Other seeds give independent hashes."""
    n = end - start
    padded = np.concatenate([d, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(d) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix((n.astype(np.uint64) + U(seed * 2 + 1)) * _STEP) ^ ((eight[start] & _FIRST[np.minimum(n, 8)]) * _BLOCK)
    h = mix(h)
    at, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(at):
        h[at] = mix((h[at] + _STEP) ^ ((eight[start[at] + k] & _FIRST[np.minimum(n[at] - k, 8)]) * _BLOCK))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = U(int.from_bytes(hashlib.blake2b(d[start[i] : end[i]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little"))
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and, for n texts, its n + 1 offsets into them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def chunks(d: np.ndarray, o: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first, end, their bytes, their offsets from 0."""
    n, i = len(o) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, d[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def words(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and each text's first word among them (n + 1 numbers)."""
    w = IS_WORD[d]
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(o), np.int64)
    before, after = np.zeros(len(d), bool), np.zeros(len(d), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    full = o[1:] > o[:-1]
    before[o[:-1][full]] = False
    after[o[1:][full] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, o)


def sums(flags: np.ndarray, o: np.ndarray) -> np.ndarray:
    """For each text, the sum of flags over its places."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[o[1:]] - c[o[:-1]]


def owners(lo: np.ndarray) -> np.ndarray:
    """For n + 1 bounds, the index of the group that each place belongs to."""
    return np.repeat(np.arange(len(lo) - 1), np.diff(lo))


def grams(h: np.ndarray, lo: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n words inside each text, and each text's first window (n + 1 bounds). Texts with fewer words have none."""
    count = np.maximum(np.diff(lo) - n + 1, 0)
    glo = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(glo[-1]) - np.repeat(glo[:-1], count) + np.repeat(lo[:-1], count)
    g = np.zeros(len(first), np.uint64)
    for k in range(n):
        g = g * U(0xD6E8FEB86659FD93) + h[first + k]
    return mix(g + U(n)), glo


def line_bounds(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between \\n, and each text's first line among them (n + 1 bounds). A text has one line more than it has \\n."""
    ends = np.sort(np.concatenate([np.flatnonzero(d == 10), o[1:]]), kind="stable")
    llo = np.concatenate([[0], np.cumsum(sums(d == 10, o) + 1)])
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1] + 1
    starts[llo[:-1]] = o[:-1]
    return starts, ends, llo


def ordered_sets(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each owner in ascending order: owners that have any, their first places (n + 1 bounds), keys. owner must not fall."""
    if not len(key):
        return owner[:0], np.zeros(1, np.int64), key
    shift = 64 - max(int(owner[-1]).bit_length(), 1)
    both = (owner.astype(np.uint64) << U(shift)) | (key >> U(64 - shift))
    order = np.argsort(both)
    k, w = key[order], owner[order]
    if ((both[order][1:] == both[order][:-1]) & (k[1:] != k[:-1])).any():  # keys that differ in their last bits alone
        order = np.lexsort((key, owner))
        k, w = key[order], owner[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    k, w = k[fresh], w[fresh]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    return w[first], np.append(first, len(k)), k


def set_hashes(first: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a set from others, for each set of ordered_sets (bounds, keys); the order of the keys doesn't matter."""
    n = np.diff(first).astype(np.uint64)
    out = [mix(np.add.reduceat(mix(key ^ U(c)), first[:-1]) + n * U(c) if len(n) else n) for c in (0x51ED270B35AE4C2F, 0xA0761D6478BD642F)]
    return out[0], out[1]


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed numbers."""
    return np.ascontiguousarray(x).view(np.int64)

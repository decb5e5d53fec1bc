"""Vectorised text kernels over Arrow buffers: whole batches of UTF-8 bytes, no per-word Python objects.

All kernels take ``data`` (uint8, the concatenated bytes of several texts) and ``bounds`` (int64, n + 1 offsets
into it). Null texts are empty. A batch is cut into pieces of about ``PIECE`` bytes so that temporary arrays stay
small; a text longer than that is a piece by itself, hence memory is bounded by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)  # odd, so that powers never vanish modulo 2**64
_Q = U64(0xC2B2AE3D27D4EB4F)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_P, 64)


def powers(n: int) -> np.ndarray:
    return _POW[:n] if n <= len(_POW) else _powers(_P, n)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, bounds) of a string or binary column without copying where it has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, bounds) for runs of rows of about ``limit`` bytes."""
    if not len(column):
        return
    data, bounds = buffers(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words: byte starts, byte ends, row of each word, and the lower-cased bytes."""
    low = _LOWER[data]
    inside = ~separators[low]
    n = len(inside)
    edge = np.empty(n + 1, dtype=bool)
    edge[0], edge[n] = False, False
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1]
    cut = bounds[:-1][bounds[:-1] < n]
    starts_at[cut] = inside[cut]  # a new text starts a new word
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    ends_at[last] = inside[last]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    rows = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, rows, low


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over mixed byte codes, modulo 2**64, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(firsts, lengths)
    terms = _BYTE[low[within + np.repeat(starts, lengths)]]
    terms *= powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64) * _Q)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, by its first word; ignores text boundaries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(_powers(_Q, k)):
        out += hashes[j : j + n] * p
    return mix(out)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text: (hashes ascending by text then value, offsets by text).

    A text of fewer than ``k`` words, but not none, has its whole word sequence as its one shingle."""
    n = len(bounds) - 1
    starts, ends, rows, low = words(data, bounds, SPACE)
    hashes = word_hashes(low, starts, ends)
    count = np.bincount(rows, minlength=n)
    first = np.cumsum(count) - count
    full = grams(hashes, k)
    ok = rows[: len(full)] == rows[k - 1 :] if len(full) else np.zeros(0, bool)
    value, row = full[ok], rows[: len(full)][ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = [int(mix(np.add.reduce(hashes[first[r] : first[r] + count[r]] * _powers(_Q, int(count[r])), keepdims=True) + U64(count[r]))[0]) for r in short]
        value, row = np.concatenate([value, np.array(whole, np.uint64)]), np.concatenate([row, short])
    if len(short):
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


def digest64(raw: bytes) -> int:
    """A signed 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def digest128(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()

"""Vectorised text arithmetic for Arrow batches: words, their hashes, shingles, all in numpy, never per row in Python.

Bytes of many texts are laid end to end; a word is a run of bytes other than ASCII white space within one text.  The
hash of a word is a polynomial in an odd base over its bytes, modulo 2**64, taken from a prefix sum, then mixed.  Texts
are handled in blocks of about BLOCK_BYTES, so memory doesn't grow with the batch, and a longer text is a block alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = (np.ones(1, _U), np.ones(1, _U))


class Words(NamedTuple):
    """Words of a block of texts: hash and byte span of each, and where each text's words begin (one more at the end)."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        for s in steps:
            s[0] = 1
        _powers = tuple(np.multiply.accumulate(s) for s in steps)
    return _powers


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of each text in them and the end) of blocks of rows; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and at[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """The words of the texts that ``offsets`` cut out of ``data``."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, closes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    closes[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    power, inverse = _powers_to(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct k-word shingles, sorted, and where each text's begin (one more at the end).

    A text of fewer words has its whole sequence as the only one; a text without words has none.
    """
    h, n = w.hashes, len(w.hashes)
    counts = np.diff(w.first)
    grams = np.zeros(0, _U)
    if n >= k:
        grams = mix(h[: n - k + 1] + _U(k))
        for j in range(1, k):
            grams = mix(grams * _U(3) + h[j : n - k + 1 + j])
    sets, first = [], np.zeros(len(counts) + 1, np.int64)
    for i, (at, count) in enumerate(zip(w.first[:-1].tolist(), counts.tolist(), strict=True)):
        if count >= k:
            own = np.unique(grams[at : at + count - k + 1])
        elif count:
            acc = mix(h[at : at + 1] + _U(count))
            for j in range(1, count):
                acc = mix(acc * _U(3) + h[at + j : at + j + 1])
            own = acc
        else:
            own = h[:0]
        sets.append(own)
        first[i + 1] = first[i] + len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), first


def fold(values: np.ndarray, first: np.ndarray, how: np.ufunc) -> np.ndarray:
    """``how`` reduced over each run of ``values``; 0 for an empty run."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = how.reduceat(values, first[full])
    return out


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and where each list begins in them (one more at the end)."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return values, offsets


def binaries(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The same of a column of binaries without nulls that hold 64-bit numbers."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint64, at[-1] // 8) if data is not None and at[-1] else np.zeros(0, np.uint64)), at // 8


def common(left: np.ndarray, at: np.ndarray, right: np.ndarray, to: np.ndarray, most: int = BLOCK_BYTES) -> np.ndarray:
    """How many values the i-th set of ``left`` and the i-th of ``right`` have in common; sets begin at ``at`` and ``to``.

    Pairs are handled in blocks of about ``most`` values: one sort brings equal values of a pair next to each other.
    """
    n = len(at) - 1
    out = np.zeros(n, np.int64)
    sizes = np.cumsum(np.diff(at) + np.diff(to))
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + most, "right")))
        own = [np.repeat(np.arange(stop - row), np.diff(x[row : stop + 1])) for x in (at, to)]
        owner, values = np.concatenate(own), np.concatenate([left[at[row] : at[stop]], right[to[row] : to[stop]]])
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        again = (owner[1:] == owner[:-1]) & (values[1:] == values[:-1])
        out[row:stop] = np.bincount(owner[1:][again], minlength=stop - row)
        row = stop
    return out

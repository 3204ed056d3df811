"""Vectorised word tables over Arrow string columns.

A word is a maximal run of bytes other than space and U+0009..U+000D, which in
UTF-8 is the same as `[^\\x20\\x09-\\x0D]+` over characters.  Words are kept as
two 64-bit hashes of their bytes with byte offsets, so tasks work on numpy arrays of a bounded
slice of rows instead of on Python strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows are taken in slices of about this many bytes of text.
SLICE_BYTES = 1 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of more bytes are hashed one by one.
_LONG = 256
_LANES = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some rows: row r has words ptr[r] to ptr[r + 1]."""

    hash: np.ndarray
    hash2: np.ndarray  # a second, independent hash
    start: np.ndarray  # byte offsets into `data`
    end: np.ndarray
    ptr: np.ndarray
    row: np.ndarray  # byte offsets of the rows
    data: np.ndarray


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices of about `size` bytes each."""
    n, ends = len(column), _offsets(column)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to - at
        at = to


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def segments(text: bytes, size: int) -> Iterator[bytes]:
    """`text` in parts of about `size` bytes that end before white space."""
    at = 0
    while at < len(text):
        end = _SPACE.search(text, at + size)
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """`column` in one chunk, null taken as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def word_table(column: pa.Array, lower: bool = False) -> Words:
    """All words of a column without nulls; `lower` maps A-Z to a-z."""
    if len(column) == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none.astype(np.uint64), none, none, np.zeros(1, np.int64), np.zeros(1, np.int64), none.astype(np.uint8))
    ends = _offsets(column)
    held = column.buffers()[2]
    data = (np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]]
    row = ends - ends[0]
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    before[row[row < n]] = False
    after[row[row > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(*_word_hashes(data, start, end - start), start, end, np.searchsorted(start, row), row, data)


def _word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word: eight bytes at a time, scrambled after each."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    hashes = [mix(size.astype(np.uint64) + salt) for salt, _ in _LANES]
    left = np.flatnonzero(size <= _LONG)
    at = 0
    while len(left):
        held = np.minimum(size[left] - at, 8).astype(np.uint64)
        piece = eight[start[left] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * held))
        for h, (salt, factor) in zip(hashes, _LANES):
            h[left] = mix((h[left] ^ mix(piece + salt)) * factor)
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=16).digest()
        hashes[0][i], hashes[1][i] = np.frombuffer(digest, dtype="<u8")
    return hashes[0], hashes[1]

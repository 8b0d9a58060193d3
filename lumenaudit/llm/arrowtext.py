"""Whole columns of text as one byte array: words, shingles and their hashes, without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import mix

# ASCII white space that separates words: 0x20 and 0x09-0x0D (fixed values).
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_P = 0x9DDFEA08EB382D69
_POWERS = np.ones(1, np.uint64)
#: Text handled at once by the vectorised steps (bytes); a longer text is handled alone.
PIECE = 1 << 20


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 256) - 1, _P, np.uint64))]).astype(np.uint64)
    return _POWERS


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and where each value starts (one more offset than values). Null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    if col.null_count:
        lengths = np.where(np.asarray(col.is_valid()), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            keep = [data[a : a + n] for a, n in zip(offsets[:-1], lengths)]
            return np.concatenate(keep), np.concatenate([[0], np.cumsum(lengths)])
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of values of about `most` bytes; a longer value is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word, in order. A word: a longest run of bytes that aren't ASCII white space."""
    solid = ~_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    before[offsets] = False
    first = solid & ~before[:-1]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = np.flatnonzero(first[at])
    lengths = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    value = (_BYTE_LOWER if lower else _BYTE)[data[at]] * powers(int(lengths.max()))[place]
    h = mix(np.add.reduceat(value, begins) + lengths.astype(np.uint64))
    return h, np.searchsorted(offsets, at[begins], "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, sorted hashes of its distinct k-word shingles). Fewer than k words: all of them as one. No word: nothing is given."""
    h, doc = words(data, offsets)
    if not len(h):
        return
    edges = np.flatnonzero(np.diff(doc, prepend=-1))
    ends = np.append(edges[1:], len(doc))
    s = h[: max(0, len(h) - k + 1)].copy()
    for j in range(1, k):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(s)])
    for a, b in zip(edges.tolist(), ends.tolist()):
        if b - a >= k:
            yield int(doc[a]), np.unique(s[a : b - k + 1])
        else:
            x = np.array([b - a], np.uint64)
            for y in h[a:b]:
                x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + y)
            yield int(doc[a]), x

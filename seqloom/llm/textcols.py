"""Whole Arrow columns of text as byte arrays: words, their hashes and shingles, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes, which stay in a core's cache; a longer text is a run of its own.
RUN_BYTES = 1 << 17


def _in_words(raw: np.ndarray) -> np.ndarray:
    """Which bytes are none of space, tab, line feed, vertical tab, form feed, carriage return."""
    return (raw != 0x20) & (raw - np.uint8(0x09) > np.uint8(4))


def _lower(raw: np.ndarray) -> np.ndarray:
    return raw + (raw - np.uint8(0x41) < np.uint8(26)).view(np.uint8) * np.uint8(0x20)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, where


def runs(where: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows first to last of each run of about RUN_BYTES."""
    first, n = 0, len(where) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(where, where[first] + RUN_BYTES, "right")) - 1)
        yield first, last
        first = last


def words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``raw``; ``cuts`` are ascending places that no word spans."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _in_words(raw)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    ends = [np.zeros(int(inside[0]), np.int64), edges, np.full(int(inside[-1]), len(raw))]
    between = cuts[(cuts > 0) & (cuts < len(raw))]
    between = between[inside[between] & inside[between - 1]]
    if len(between):
        between = np.unique(between)
        ends += [between, between]
    places = np.concatenate(ends)
    if len(between):
        places.sort()
    return np.ascontiguousarray(places[0::2]), np.ascontiguousarray(places[1::2])


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_STRIDE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words, A-Z taken as a-z.

    A word is read eight bytes at a time, each time mixed into what is there so far.
    """
    starts, ends = words(raw, cuts)
    length = ends - starts
    hashes = length.astype(np.uint64) * _STRIDE
    if not len(starts):
        return starts, ends, hashes
    padded = np.concatenate((_lower(raw), np.zeros(8, np.uint8)))
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    open_, at, left, h = None, starts, length, hashes
    while len(at):
        h = mix(h ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        h *= _STRIDE
        more = np.flatnonzero(left > 8)
        if open_ is None:
            hashes, open_ = h, more
        else:
            hashes[open_] = h
            open_ = open_[more]
        at, left, h = at[more] + 8, left[more] - 8, h[more]
    return starts, ends, mix(hashes)


def hashed_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each run of rows: first row, last row, the words' hashes, and each row's first word."""
    raw, where = bytes_of(column)
    for first, last in runs(where):
        base = int(where[first])
        part = raw[base : int(where[last])]
        starts, _, hashes = word_hashes(part, where[first : last + 1] - base)
        yield first, last, hashes, np.searchsorted(starts, where[first : last + 1] - base)


_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within each row, and each row's first shingle.

    A row of fewer words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(at)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate(([0], np.cumsum(made)))
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    row = np.repeat(np.arange(len(made)), made)
    start = at[:-1][row] + (np.arange(first[-1]) - first[:-1][row])
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    total = padded[start] * _STEP[0]
    for k in range(1, size):
        total += padded[start + k] * _STEP[k]
    for i in np.flatnonzero((counts < size) & (counts > 0)):
        total[first[i]] = np.sum(hashes[at[i] : at[i + 1]] * np.array(_STEP[: counts[i]]))
    return mix(total + np.uint64(size)), first

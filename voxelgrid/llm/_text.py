"""Vectorised word hashing and shingling shared by the operators of this subpackage.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z folded to a-z. A word's
64-bit hash is a polynomial over per-byte random values, so whole batches are hashed with a
few numpy passes instead of a Python loop. Hash equality stands for word equality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TABLE[65:91] = _TABLE[97:123]
_DELIMITER = np.zeros(256, bool)
_DELIMITER[[32, 9, 10, 11, 12, 13]] = True
_TABLE[_DELIMITER] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        if size > 1 << 21:
            _powers.clear()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.ones(size, _U)
            step = 1
            factor = base
            while step < size:
                p[step : 2 * step] = p[:step] * _U(factor)
                factor = factor * factor % 2**64
                step *= 2
            out.append(p)
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def arrow_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in order, and the index of each row's first word (rows + 1 long)."""
    hashes, bounds, _, _ = placed_words(data, offsets)
    return hashes, bounds


def placed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``hash_words``, with the first and last byte (exclusive) of each word.

    The bytes are worked through in segments of about a megabyte cut at delimiters or row
    ends, so memory does not grow with a text; a single longer word only widens its segment.
    """
    hashes, starts, sizes = [], [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + SEGMENT)
        if stop < end:
            gaps = np.flatnonzero(_DELIMITER[data[at:stop]])
            row = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else at, row)
            while cut <= at and stop < end:
                more = min(end, stop + SEGMENT)
                gaps = np.flatnonzero(_DELIMITER[data[stop:more]])
                cuts = [stop + int(gaps[0]) + 1] if len(gaps) else []
                k = np.searchsorted(offsets, stop, "left")
                if k < len(offsets) and offsets[k] <= more:
                    cuts.append(int(offsets[k]))
                stop = more
                cut = min(cuts) if cuts else (end if more == end else at)
            stop = cut
        h, s, size = _segment(data[at:stop], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at)
        hashes.append(h)
        starts.append(s + at)
        sizes.append(size)
        at = stop
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    all_starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    ends = all_starts + np.concatenate(sizes) if sizes else all_starts
    return all_hashes, np.searchsorted(all_starts, offsets), all_starts, ends


def _segment(d: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(d) + 2, bool)
    inside[1:-1] = ~_DELIMITER[d]
    first = np.zeros(len(d) + 1, bool)
    first[rows] = True
    s = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    first[-1] = True
    e = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    forward, back = _power(len(d) + 1)
    sums = np.zeros(len(d) + 1, _U)
    np.cumsum(_TABLE[d] * forward[: len(d)], out=sums[1:])
    h = (sums[e] - sums[s]) * back[s]
    return mix(h ^ (e - s).astype(_U)), s, e - s


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles in order, and each row's bounds in them.

    A row of 1 to ``size`` - 1 words has its whole sequence as one shingle.
    """
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(ends[-1]), _U)
    if len(words) >= size:
        h = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            h = mix(h) + words[k : len(words) - size + 1 + k]
        h = mix(h)
        mask = np.zeros(len(words) + 1, np.int32)
        long = n >= size
        np.add.at(mask, bounds[:-1][long], 1)
        np.add.at(mask, bounds[:-1][long] + counts[long], -1)
        keep = np.cumsum(mask[:-1])[: len(h)] > 0
        target = np.zeros(len(out) + 1, np.int32)
        np.add.at(target, ends[:-1][long], 1)
        np.add.at(target, ends[1:][long], -1)
        out[np.cumsum(target[:-1]) > 0] = h[keep]
    for r in np.flatnonzero((n > 0) & (n < size)):
        h = np.zeros(1, _U)
        for w in words[bounds[r] : bounds[r + 1]]:
            h = mix(h + w + _U(n[r]))
        out[ends[r]] = h[0]
    return out, ends


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = 4 << 20):
    """Row ranges of about ``limit`` bytes each."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        stop = min(stop, rows)
        yield at, stop
        at = stop

"""Word hashes of whole Arrow columns at once.

A text's bytes are mapped to random 64-bit values, weighted by powers of an odd base and summed as
prefixes; the hash of a word is a difference of two prefixes, shifted back to exponent 0 and mixed.
Hashes depend on the word alone, so they agree between processes, batches and tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import U64, mix64

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of texts with A-Z lower-cased.
ALNUM = ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)
#: Words `[^\x20\x09-\x0D]+`.
BLANK = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
_VALUE = mix64((_LOWER.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
_BASE, _SEGMENT = 0x5851F42D4C957F2D, 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < size:
        size = max(size, _SEGMENT + 4096)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def word_hashes(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a binary column without nulls, and for each row the index of its first word
    (with the total at the end)."""
    rows = len(column)
    if rows == 0 or column.buffers()[2] is None:
        return np.empty(0, U64), np.zeros(rows + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if len(data) == 0:
        return np.empty(0, U64), np.zeros(rows + 1, np.int64)
    inside = kind[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[edge] = inside[edge]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edge - 1] = inside[edge - 1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    hashes = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        low = int(start[at])
        end = max(at + 1, int(np.searchsorted(stop, low + _SEGMENT, side="right")))
        size = int(stop[end - 1]) - low
        power, back = _powers(size)
        sums = np.empty(size + 1, U64)
        sums[0] = 0
        np.cumsum(_VALUE[data[low : low + size]] * power[:size], out=sums[1:])
        hashes[at:end] = (sums[stop[at:end] - low] - sums[start[at:end] - low]) * back[start[at:end] - low]
        at = end
    hashes += (stop - start).astype(U64)
    return mix64(hashes), np.searchsorted(start, offsets).astype(np.int64)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words (also across rows: callers leave those out)."""
    out = np.full(max(0, len(hashes) - k + 1), 0x2545F4914F6CDD1D + k, U64)
    for i in range(k):
        out += hashes[i : len(hashes) - k + 1 + i]
        mix64(out)
    return out


def sets(column: pa.Array, kind: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words, but not none, are one shingle."""
    hashes, bounds = word_hashes(column, kind)
    grams = windows(hashes, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            found = np.sort(grams[a : b - k + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.empty(0, U64))
    return out

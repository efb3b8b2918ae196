"""Vectorised text primitives over Arrow string columns.

Texts are handled as the UTF-8 buffers that Arrow already holds: words, lines and windows are found and hashed with
numpy over slabs of whole documents, so no Python object is made for a word. Slabs bound the temporary memory; one
document longer than a slab makes a slab of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:  # doubling: have[done:2*done] = have[:done] * base**done
            upto = min(size, 2 * done)
            have[done:upto] = have[: upto - done] * np.uint64(step)
            step = step * step & _MASK
            done *= 2
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slabs(column, max_bytes: int = SLAB_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole texts."""
    raw, off = column_bytes(column)
    n, at = len(off) - 1, 0
    while at < n:
        upto = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
        upto = min(n, max(upto, at + 1))
        part = off[at : upto + 1]
        yield at, raw[part[0] : part[-1]], part - part[0]
        at = upto


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts."""
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]).astype(np.int64)


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs where inside holds, never across texts: (starts, ends, first run of each text and their total)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    begin[heads] = inside[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    end[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", _INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each run, from the runs' first index by text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-item windows within each text."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = owners(first)
    at = np.flatnonzero(own[: m] == own[k - 1 :])
    total, c = np.zeros(len(at), np.uint64), 1
    for j in range(k):
        c = c * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D & _MASK | 1
        total += h[at + j] * np.uint64(c)
    return at, mix(total)


def whole(h: np.ndarray, begin: int, end: int) -> int:
    """Hash of one run sequence as a whole."""
    value = 0x51ED270B7F9C2A63 + int(end - begin)
    for x in h[begin:end].tolist():
        value = (value ^ x) * 0x9E3779B97F4A7C15 & _MASK
        value ^= value >> 29
    return value

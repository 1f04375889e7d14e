"""Words and hashes of many texts at once, in numpy.

Texts are UTF-8 bytes joined by a separator byte, so that one pass over the
joined bytes serves a whole slice of rows. Words are runs of bytes outside
space, tab, newline, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 256 << 10
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers


def word_spans(buf: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes that begin and end anywhere."""
    inside = np.empty(len(buf) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(is_space[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``buf``: polynomial over byte values, from prefix sums."""
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def segments(buf: np.ndarray, is_space: np.ndarray) -> list[tuple[int, int]]:
    """Places that divide long bytes into segments, always after a separator."""
    cuts = [0]
    while len(buf) - cuts[-1] > SLICE_BYTES:
        at = cuts[-1] + SLICE_BYTES
        while at < len(buf):
            window = np.flatnonzero(is_space[buf[at : at + (1 << 16)]])
            if len(window):
                at += int(window[0]) + 1
                break
            at += 1 << 16
        cuts.append(min(at, len(buf)))
    if cuts[-1] < len(buf):
        cuts.append(len(buf))
    return list(zip(cuts[:-1], cuts[1:]))


def words(buf: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all words; memory for hashing is bounded by the slice size and the longest word."""
    parts = []
    for a, b in segments(buf, is_space):
        starts, ends = word_spans(buf[a:b], is_space)
        parts.append((starts + a, ends + a, span_hashes(buf[a:b], starts, ends)))
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; order matters."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _PLACE[k]
    return mix(total)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Rows [a, b) with their texts joined by newlines, and where each text starts (one more entry: the end).

    Text i is ``joined[at[i] : at[i + 1] - 1]``. Null texts are empty. A slice
    holds about ``limit`` bytes, or one longer text.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    data = texts.cast(pa.large_binary())  # offsets widened, bytes shared
    ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    whole = memoryview(data.buffers()[2] or b"")
    a = 0
    while a < len(data):
        # As many rows as fit, one at least.
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1)
        b = min(b, len(data))
        at = ends[a : b + 1] - ends[a] + np.arange(b - a + 1)
        yield a, b, b"\n".join([*(whole[x:y] for x, y in zip(ends[a:b].tolist(), ends[a + 1 : b + 1].tolist())), b""]), at
        a = b

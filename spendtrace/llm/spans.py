"""Ids of repeated spans of bytes, looked up by hash instead of encoded again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from spendtrace.llm.textnum import span_hashes

_FREE = np.uint64(np.iinfo(np.uint64).max)
_ODD = np.uint64(0x9E3779B97F4A7C15)

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
#: ASCII punctuation but the apostrophe, which may belong to the letters behind it.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[list(b"!#$%&()*+,-./:;=?@[]^_`{|}~\"\\<>")] = True


def letters(buf: np.ndarray) -> np.ndarray:
    """Bytes that end a letter of ASCII or Latin-1."""
    out = LETTER[buf]
    if len(buf) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        out[1:] |= latin
    return out


class HashTable:
    """Open addressing from 64-bit keys to 32-bit values, probed for many keys at once."""

    def __init__(self, capacity: int):
        bits = max(4, int(np.ceil(np.log2(max(1, 2 * capacity)))))
        self.down = np.uint64(64 - bits)
        self.last = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _FREE, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _ODD) >> self.down).astype(np.int64)

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == _FREE
            self.keys[slot[free]] = key[free]  # of several for one slot, the last stays
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) & self.last

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values; -1 for keys not in the table."""
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
        left = np.flatnonzero((found != key) & (found != _FREE))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != _FREE)]
        return out


class SpanIds:
    """Ids of spans. Spans are told apart by a 64-bit hash; ``encode`` gives those of spans not met before.

    The table holds at most ``limit`` spans and ``4 * limit`` ids and starts
    anew when full, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._restart()

    def _restart(self) -> None:
        self.table = HashTable(self.limit)
        self.pool = np.zeros(4 * self.limit, dtype=np.uint32)
        self.starts = np.zeros(self.limit, dtype=np.int64)
        self.counts = np.zeros(self.limit, dtype=np.int64)
        self.spans = self.used = 0

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each span)."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        hashes = span_hashes(buf, starts, ends)
        number = self.table.get(hashes)
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return self._gather(self.pool, self.starts[number], self.counts[number])
        fresh, where, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
        at = missing[where]
        data = buf.tobytes()
        packed = self.encode([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        counts = np.array([len(p) for p in packed]) // 4
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        if self.spans + len(fresh) > self.limit or self.used + len(ids) > len(self.pool):
            # Answer from old and new ids together, then start anew.
            pool = np.concatenate([self.pool[: self.used], ids])
            all_starts = np.concatenate([self.starts[: self.spans], self.used + np.cumsum(counts) - counts])
            all_counts = np.concatenate([self.counts[: self.spans], counts])
            number[missing] = self.spans + which
            answer = self._gather(pool, all_starts[number], all_counts[number])
            self._restart()
            return answer
        new = self.spans + np.arange(len(fresh))
        self.table.put(fresh, new.astype(np.int32))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[new] = self.used + np.cumsum(counts) - counts
        self.counts[new] = counts
        self.spans += len(fresh)
        self.used += len(ids)
        number[missing] = new[which]
        return self._gather(self.pool, self.starts[number], self.counts[number])

    @staticmethod
    def _gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(counts)
        return pool[np.arange(ends[-1]) + np.repeat(starts - ends + counts, counts)], counts

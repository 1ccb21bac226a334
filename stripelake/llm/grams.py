"""Byte n-grams of a batch of texts as integers, and hashed look-up of them (numpy only)."""

from __future__ import annotations

import numpy as np

from .text_hash import mix

#: Stands before each text and, as the end symbol, behind it; no UTF-8 text holds this byte.
EDGE = 0xFF


def gram_buffer(texts: list[bytes], order: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, ``order`` EDGE bytes before each and, with ``end``, one behind; and where each one's own bytes start
    (with the end as a last entry, from which ``order`` is to be taken)."""
    pad, tail = bytes([EDGE]) * order, bytes([EDGE]) if end else b""
    parts = [pad + t + tail for t in texts]
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), at


def grams(buf: np.ndarray, order: int) -> np.ndarray:
    """For every position the context bytes, nearest first (highest), and the byte itself (lowest), in one integer."""
    out = buf.astype(np.uint64)
    for j in range(1, order + 1):
        out[j:] |= buf[:-j].astype(np.uint64) << np.uint64(8 * (order + 1 - j))
    return out


def own_positions(at: np.ndarray, order: int) -> np.ndarray:
    """A mask of the positions that are not padding before a text."""
    mask = np.ones(int(at[-1]), dtype=bool)
    for j in range(order):
        mask[at[:-1] + j] = False
    return mask


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums the value columns of (keys, values...) parts by key."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return parts[0]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) for i in range(1, len(parts[0]))))


class HashIndex:
    """Open addressing over distinct unsigned 64-bit keys; find() gives each query's place among them, or -1."""

    def __init__(self, keys: np.ndarray, room: int = 0):
        """``room``: how many keys there will be in the end, if more are added."""
        self.keys = np.zeros(0, dtype=np.uint64)
        self.bits = max(4, int(2 * max(len(keys), room)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.add(keys)

    def add(self, keys: np.ndarray) -> None:
        """More distinct keys, which are not there yet."""
        old = len(self.keys)
        self.keys = np.concatenate((self.keys, np.asarray(keys, dtype=np.uint64)))
        left = np.arange(old, len(self.keys), dtype=np.int32)
        at = self._home(self.keys[old:])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, q: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((q * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(q), -1, dtype=np.int32)
        at = self._home(q)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != q))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.slots) - 1)
            got = self.slots[at]
            out[open_] = got
            go = (got >= 0) & (self.keys[got] != q[open_])
            open_, at = open_[go], at[go]
        return out


def _spot(h: np.ndarray, level: int, slots: np.ndarray | np.uint64) -> np.ndarray:
    """Places below ``slots`` (less than 2**32) for mixed keys, another one at each level."""
    with np.errstate(over="ignore"):
        return ((h * (mix(np.full(1, level, dtype=np.uint64), 1) | np.uint64(1))) >> np.uint64(32)) * slots >> np.uint64(32)


def place(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: 64-bit words of each level, the bits of all levels, and the keys' order by place.

    A level has two slots for each key that is left.  Keys alone in their slot stay there and set its bit, the others go on to the next level.
    """
    h, left = mix(keys), np.arange(len(keys))
    sizes: list[int] = []
    bits, order = [np.zeros(0, dtype=np.uint64)], [left[:0]]
    while len(left):
        n = -(-2 * len(left) // 64)
        at = _spot(h[left], len(sizes), np.uint64(64 * n)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * n) == 1
        bits.append(np.packbits(alone, bitorder="little").view("<u8"))
        stays = alone[at]
        order.append(left[stays][np.argsort(at[stays])])
        left = left[~stays]
        sizes.append(n)
    return sizes, np.concatenate(bits), np.concatenate(order)


class PlacedIndex:
    """Several tables of ``place`` end to end.  find() gives the place of keys of theirs; a key that no table has gets any place, or -1."""

    #: Keys are looked up in pieces of this size, whose intermediate arrays stay in the processor's cache.
    PIECE = 1 << 15

    def __init__(self, sizes: list[list[int]], bits: np.ndarray):
        self.size = np.zeros((max(map(len, sizes), default=0), len(sizes)), dtype=np.uint64)
        for t, s in enumerate(sizes):
            self.size[: len(s), t] = s
        ends = np.cumsum(self.size.T.ravel(), dtype=np.uint64).reshape(self.size.T.shape).T
        self.start = ends - self.size
        self.bits = np.append(bits, np.uint64(0))  # a place behind the last, for keys of no table
        self.before = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64) - np.bitwise_count(self.bits)

    def find(self, q: np.ndarray, table: np.ndarray) -> np.ndarray:
        """``table`` tells for each key which of the tables has it."""
        out = np.empty(len(q), dtype=np.int64)
        for lo in range(0, len(q), self.PIECE):
            out[lo : lo + self.PIECE] = self._find(q[lo : lo + self.PIECE], table[lo : lo + self.PIECE])
        return out

    def _find(self, q: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.full(len(q), -1, dtype=np.int64)
        h, left = mix(q), np.arange(len(q))
        for level, (start, size) in enumerate(zip(self.start, self.size)):
            at = _spot(h, level, size[table] << np.uint64(6))
            word, bit = start[table] + (at >> np.uint64(6)), at & np.uint64(63)
            got = self.bits[word]
            hit = (got >> bit) & np.uint64(1) == 1
            lower = got[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(lower)
            open_ = ~hit
            h, left, table = h[open_], left[open_], table[open_]
            if not len(left):
                break
        return out

"""External induced sorting of suffixes to a bounded depth, with common-prefix values.

The strings of a group are aligned slices around one shared anchor.  Suffixes that start one column
further left are the present ones with a byte put before them, so their order is induced: popping the
present suffixes in order and pushing each into the queue of its preceding byte sorts the next ones,
and the longest common prefix of two neighbours in a queue is one more than the least value popped between
them.  Groups that fit in memory are induced together, a column a round.  A group that does not is streamed to the folder that driver
and executors share, and goes through queues whose runs lie there: memory then holds a block of tuples, a value for each byte,
and of every slice one byte and the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs

#: Tuples of one group that are kept in memory; larger groups use queues on disk.
IN_MEMORY = 20_000
BLOCK = 20_000


def _least(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of lcp[a:b] for pairs of bounds, none of them empty."""
    out = lcp[a]
    wide = np.flatnonzero(b - a > 1)
    if len(wide):
        pairs = np.empty(2 * len(wide), dtype=np.int64)
        pairs[0::2], pairs[1::2] = a[wide], b[wide]
        out[wide] = np.minimum.reduceat(np.append(lcp, lcp.dtype.type(0)), pairs)[::2]
    return out


def repeated(text: np.ndarray, group: np.ndarray, left: int, depth: int) -> np.ndarray:
    """For slices (rows of bytes, all of one width) of ascending groups: whether the suffix at each column 0..left shares its first ``depth``
    bytes with another slice of its group at the same column."""
    m, width = text.shape
    out = np.zeros((left + 1, m), dtype=bool)
    if m < 2:
        return out.T
    columns = np.ascontiguousarray(text.T)
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, m)))
    for lo in range(0, len(first), 60_000):  # group numbers as 16-bit integers: two stable radix passes a round
        hi = min(lo + 60_000, len(first))
        a, b = first[lo], first[hi] if hi < len(first) else m
        own = (rank[a:b] - lo).astype(np.uint16)
        order, lcp = np.arange(b - a, dtype=np.int64), np.zeros(b - a, dtype=np.int16)
        for t in range(width - 1, -1, -1):
            before = columns[t, a:b][order]
            perm = np.argsort(before, kind="stable")
            perm = perm[np.argsort(own[order[perm]], kind="stable")]
            order, before = order[perm], before[perm]
            g = own[order]
            same = np.flatnonzero((before[1:] == before[:-1]) & (g[1:] == g[:-1])) + 1
            new = np.zeros(b - a, dtype=np.int16)
            new[same] = np.minimum(_least(lcp, perm[same - 1] + 1, perm[same] + 1) + 1, depth)
            lcp = new
            if t <= left:
                deep = lcp >= depth
                deep[:-1] |= deep[1:]
                out[t, a + order[deep]] = True
    return out.T


class Spool:
    """A folder of files on any store that pyarrow reaches, written and read by the task that makes it."""

    def __init__(self, folder: str):
        self.fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        self.folder = f"{base.rstrip('/')}/induced-{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder)

    def write(self, name: str):
        return self.fs.open_output_stream(f"{self.folder}/{name}")

    def read(self, name: str):
        return self.fs.open_input_file(f"{self.folder}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.folder}/{name}")

    def close(self) -> None:
        self.fs.delete_dir(self.folder)


class DiskQueue:
    """A priority queue of (suffix, common prefix) tuples by byte, first in first out within a byte; runs lie in files."""

    def __init__(self, spool: Spool):
        self.spool, self.mark = spool, uuid.uuid4().hex
        self.files: dict[int, object] = {}
        self.carry = np.full(256, -1, dtype=np.int32)  # least value popped since a byte's last push; -1: no push yet

    def push(self, byte: np.ndarray, suffix: np.ndarray, lcp: np.ndarray, depth: int) -> None:
        """Pushes a block of tuples in the order they were popped."""
        perm = np.argsort(byte, kind="stable")
        c = byte[perm]
        new = np.zeros(len(c), dtype=np.int32)
        same = np.flatnonzero(c[1:] == c[:-1]) + 1
        new[same] = _least(lcp, perm[same - 1] + 1, perm[same] + 1) + 1
        heads = np.flatnonzero(np.diff(c.astype(np.int16), prepend=np.int16(-1)))
        prefix = np.minimum.accumulate(lcp)
        held = self.carry[c[heads]]
        new[heads] = np.where(held >= 0, np.minimum(held, prefix[perm[heads]]) + 1, 0)
        new = np.minimum(new, depth)
        suffix_min = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int32(1 << 20))
        self.carry = np.where(self.carry >= 0, np.minimum(self.carry, prefix[-1]), self.carry)
        tails = np.append(heads[1:], len(c)) - 1
        self.carry[c[tails]] = suffix_min[perm[tails] + 1]
        for h, t in zip(heads.tolist(), tails.tolist()):
            run = np.empty((t + 1 - h, 2), dtype="<i4")
            run[:, 0], run[:, 1] = suffix[perm[h : t + 1]], new[h : t + 1]
            b = int(c[h])
            if b not in self.files:
                self.files[b] = self.spool.write(f"{self.mark}-{b}")
            self.files[b].write(run.tobytes())

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples in order, in blocks; the files go as they are read."""
        for f in self.files.values():
            f.close()
        for b in sorted(self.files):
            with self.spool.read(f"{self.mark}-{b}") as f:
                while data := f.read(8 * BLOCK):
                    run = np.frombuffer(data, dtype="<i4").reshape(-1, 2)
                    yield run[:, 0].astype(np.int64), run[:, 1].astype(np.int32)
            self.spool.delete(f"{self.mark}-{b}")
        self.files = {}


class External:
    """One group whose slices are streamed to disk, block by block with columns together, and then sorted there."""

    def __init__(self, folder: str, left: int, depth: int):
        self.spool, self.left, self.depth = Spool(folder), left, depth
        self.blocks: list[int] = []
        self.width = 0

    def append(self, text: np.ndarray) -> None:
        self.width = text.shape[1]
        with self.spool.write(f"text-{len(self.blocks)}") as f:
            f.write(np.ascontiguousarray(text.T).tobytes())
        self.blocks.append(len(text))

    def column(self, t: int) -> np.ndarray:
        """Byte ``t`` of every slice."""
        parts = []
        for i, n in enumerate(self.blocks):
            with self.spool.read(f"text-{i}") as f:
                parts.append(np.frombuffer(f.read_at(n, t * n), dtype=np.uint8))
        return np.concatenate(parts)

    def repeated(self) -> np.ndarray:
        """As repeated(), for this group; its files are gone afterwards."""
        m, depth = sum(self.blocks), self.depth
        out = np.zeros((self.left + 1, m), dtype=bool)
        try:
            queue = None
            for t in range(self.width - 1, -1, -1):
                source = ((np.arange(i, min(i + BLOCK, m)), np.zeros(min(i + BLOCK, m) - i, dtype=np.int32)) for i in range(0, m, BLOCK)) if queue is None else queue.pop()
                after, column, held = DiskQueue(self.spool), self.column(t), -1
                for suffix, lcp in source:
                    if queue is not None and t + 1 <= self.left:
                        held = _mark(out[t + 1], suffix, lcp, depth, held)
                    after.push(column[suffix], suffix, lcp, depth)
                queue = after
            held = -1
            for suffix, lcp in queue.pop():
                held = _mark(out[0], suffix, lcp, depth, held)
        finally:
            self.spool.close()
        return out.T


def repeated_on_disk(text: np.ndarray, left: int, depth: int, folder: str) -> np.ndarray:
    """As repeated(), for one group, with blocks and queues in ``folder``."""
    group = External(folder, left, depth)
    for i in range(0, len(text), BLOCK):
        group.append(text[i : i + BLOCK])
    return group.repeated()


def _mark(row: np.ndarray, suffix: np.ndarray, lcp: np.ndarray, depth: int, held: int) -> int:
    deep = lcp >= depth
    row[suffix[deep]] = True
    row[suffix[:-1][deep[1:]]] = True
    if deep[0] and held >= 0:
        row[held] = True
    return int(suffix[-1])

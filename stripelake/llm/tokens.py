"""Token ids of whole texts with the tokenizers library, each distinct piece of a batch encoded once.

Byte-level BPE never merges over the start of a pre-token.  A space or line feed between two characters that
are not white space always starts one, and so does a punctuation mark between an ASCII letter and such a place.  A batch is cut there
into chunks; equal chunks are found by hash, the distinct ones are encoded together in one call, and
their ids are dealt back; a bounded cache keeps them for the process's next batches.  Spaces next to anything that might be white space in some table (control
bytes, characters outside U+0021..U+007E and U+00C0..U+07FF) are no cuts, so the ids are those of the whole text.
"""

from __future__ import annotations

import os

import numpy as np

from .grams import HashIndex
from .text_hash import span_hashes

#: Bytes of new chunks that are encoded in one call, about.
PIECE = 64 << 10
_loaded: dict[str, tuple] = {}


def load(path: str):
    """(tokenizer, table of ids whose token starts with the space's letter or is the line feed's), kept by the process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        vocab = t.get_vocab()
        starts = np.zeros(max(vocab.values()) + 1, dtype=bool)
        starts[[i for token, i in vocab.items() if token.startswith("Ġ") or token == "Ċ"]] = True
        _loaded[path] = (t, starts)
    return _loaded[path]


_PLAIN = np.array([0x21 <= c <= 0x7E for c in range(256)])
_LEAD2 = np.array([0xC3 <= c <= 0xDF for c in range(256)])
_TAIL = np.array([0x80 <= c <= 0xBF for c in range(256)])
_LETTER = np.array([0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in range(256)])
_MARK = _PLAIN & ~_LETTER & ~np.array([0x30 <= c <= 0x39 for c in range(256)])


class _Cache:
    """Ids of chunks seen by this process, by hash; when it holds ``LIMIT`` chunks those met once alone are forgotten."""

    LIMIT = 600_000

    def __init__(self):
        self.index = HashIndex(np.zeros(0, dtype=np.uint64), room=2 * self.LIMIT)
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int32)
        self.again = np.zeros(0, dtype=bool)  # whether a chunk was met again
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        if len(self.start) > self.LIMIT:
            self._forget()
        got = self.index.find(keys)
        self.again[got[got >= 0]] = True
        return got

    def _forget(self) -> None:
        kept = np.flatnonzero(self.again)
        if len(kept) > self.LIMIT // 2:
            kept = kept[:0]
        keys, start, length = self.index.keys[kept], self.start[kept], self.length[kept].astype(np.int64)
        upto = np.cumsum(length)
        ids = self.pool[np.repeat(start - (upto - length), length) + np.arange(length.sum())]
        self.__init__()
        self.add(keys, length, ids)

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct chunks that are not there yet."""
        if len(self.start) + len(keys) > 2 * self.LIMIT:  # a batch of its own size: a larger table
            self.index = HashIndex(self.index.keys, room=2 * (len(self.start) + len(keys)))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), dtype=np.uint32)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate((self.start, self.used + np.cumsum(lengths) - lengths))
        self.length = np.concatenate((self.length, lengths.astype(np.int32)))
        self.again = np.concatenate((self.again, np.zeros(len(keys), dtype=bool)))
        self.used += len(ids)
        self.index.add(keys)


_caches: dict[str, _Cache] = {}


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end (unsigned 32-bit), and where each text's start (with the end as a last entry)."""
    tok, starts_word = load(path)
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    data = b"".join(raw)
    buf = np.frombuffer(data, dtype=np.uint8)
    ids_at = np.zeros(len(raw) + 1, dtype=np.int64)
    if not len(buf):
        return np.zeros(0, dtype=np.uint32), ids_at
    gap = (buf == 0x20) | (buf == 0x0A)
    p = np.flatnonzero(gap)
    p = p[(p > 0) & (p < len(buf) - 1)]
    ok = (_PLAIN[buf[p + 1]] | _LEAD2[buf[p + 1]]) & (_PLAIN[buf[p - 1]] | (_TAIL[buf[p - 1]] & _LEAD2[buf[np.maximum(p - 2, 0)]]))
    p = p[ok]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[at] = True
    p = p[~edge[p] & ~edge[p + 1]]
    stop = edge.copy()
    stop[p] = True
    q = np.flatnonzero(stop[1:])  # bytes right before a cut or a text's end
    q = q[_MARK[buf[q]] & ~edge[q]]
    q = q[_LETTER[buf[q - 1]]]
    heads = np.unique(at[:-1][at[1:] > at[:-1]])
    cuts = np.sort(np.concatenate((p, q, heads)))
    ends = np.append(cuts[1:], len(buf))
    is_head = edge[cuts]
    gaps = np.concatenate(([0], np.cumsum(gap)))
    alone = is_head | ~gap[cuts] | (gaps[ends] - gaps[cuts + 1] > 0)  # chunks that do not start with their only gap
    h = span_hashes(buf, cuts, ends)
    h[alone] = ~h[alone]  # never equal to the others
    cache = _caches.setdefault(path, _Cache())
    got = cache.find(h)
    missing = np.flatnonzero(got < 0)
    if len(missing):
        new = missing[np.unique(h[missing], return_index=True)[1]]
        inner, outer = new[~alone[new]], new[alone[new]]
        lengths, flat = [], []
        if len(inner):
            parts, size = [data[a:b] for a, b in zip(cuts[inner].tolist(), ends[inner].tolist())], ends[inner] - cuts[inner]
            turn = np.cumsum(size) // PIECE  # an encoding keeps much more than its ids, so few are alive at once
            bounds = np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(parts)).tolist()
            joined = (b"".join(parts[a:b]).decode("utf-8") for a, b in zip(bounds[:-1], bounds[1:]))
            ids = np.concatenate([np.array(tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, dtype=np.uint32) for t in joined])
            begin = np.flatnonzero(starts_word[ids])
            if len(begin) != len(inner):
                raise ValueError("chunks and encoded words differ; the tokenizer is not byte-level BPE with a word-start letter")
            lengths.append(np.diff(np.append(begin, len(ids))))
            flat.append(ids)
        if len(outer):
            parts = [x.ids for x in tok.encode_batch_fast([data[a:b].decode("utf-8") for a, b in zip(cuts[outer].tolist(), ends[outer].tolist())], add_special_tokens=False)]
            lengths.append(np.array([len(x) for x in parts], dtype=np.int64))
            flat += [np.array(x, dtype=np.uint32) for x in parts]
        cache.add(h[np.concatenate((inner, outer))], np.concatenate(lengths), np.concatenate(flat))
        got[missing] = cache.index.find(h[missing])
    n = cache.length[got].astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(n)))
    where = np.repeat(cache.start[got] - upto[:-1], n) + np.arange(upto[-1])
    ids_at[:] = upto[np.searchsorted(cuts, at)]
    return cache.pool[: cache.used][where], ids_at


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text's ids."""
    return np.insert(ids, at[1:], end_id).astype(np.uint32), at + np.arange(len(at))

"""Vectorised hashing of words and shingles over a batch of texts (numpy only).

All texts of a batch lie end to end in one byte buffer; a word's hash is a difference of
prefix sums of a polynomial in an odd base (so it can be shifted back by the base's inverse),
finished with a 64-bit mixer.  Nothing here keeps state between batches.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
U64 = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _cache.get(base)
    if have is None or len(have) < n:
        have = _cache[base] = _powers(base, max(1 << 16, n + n // 4))
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def join_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """ASCII-lower-cased UTF-8 bytes of all texts, each followed by one line feed, and where each text starts
    (with the end as a last entry).  A lone surrogate becomes a question mark."""
    parts = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts).translate(LOWER), dtype=np.uint8), starts


def words(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table is_word holds."""
    inside = is_word[buf].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the buffer."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, dtype=U64)
        np.cumsum((buf.astype(U64) + U64(1)) * powers(_BASE, len(buf)), out=sums[1:])
        return mix((sums[end] - sums[start]) * powers(_INV, len(buf) + 1)[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


SPACE_WORD = np.array([not (c == 0x20 or 0x09 <= c <= 0x0D) for c in range(256)])


def shingle_sets(texts: list[str | None], k: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    buf, at = join_texts(texts)
    s, e = words(buf, SPACE_WORD)
    h = span_hashes(buf, s, e)
    first = np.searchsorted(s, at)
    mult = [U64(m | 1) for m in np.random.RandomState(7).randint(1, 2**62, k + 1, dtype=np.int64).tolist()]
    with np.errstate(over="ignore"):
        if len(h) >= k:
            sh = h[: len(h) - k + 1] * mult[0]
            for j in range(1, k):
                sh = sh + h[j : len(h) - k + 1 + j] * mult[j]
            sh = mix(sh)
        else:
            sh = h[:0]
        out = []
        for i in range(len(texts)):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                x = np.sort(sh[a : b - k + 1])
                out.append(x[np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))])
            elif b > a:
                x = np.full(1, mult[k] * U64(b - a), dtype=U64)
                for j in range(a, b):
                    x = mix(x + h[j])
                out.append(x)
            else:
                out.append(h[:0])
    return out

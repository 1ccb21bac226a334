"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(rows, k, percent):
    """rows: (id, text) with distinct ids; {id: (n, component)}."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(texts, size):
    """Removed-byte masks of all texts."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                mask[i : i + size] = b"\1" * size
        out.append((b, mask))
    return out


def repeated_runs(rows, k, lone_bytes):
    """As repeated_lines, with lines of ``lone_bytes`` or more that have an earlier copy."""
    out, single = repeated_lines(rows, k), repeated_lines(rows, 1)
    for i, t in rows:
        if t is not None:
            lines = t.split("\n")
            out[i].update(p for p in single[i] if len(lines[p].encode()) >= lone_bytes)
    return out


def repeated_lines(rows, k):
    """rows: distinct (id, text) in order; {id: set of removed line numbers}."""
    seen, out = set(), defaultdict(set)
    for i, t in rows:
        if t is None:
            continue
        lines = t.split("\n")
        for p in range(len(lines) - k + 1):
            run = tuple(lines[p : p + k])
            if run in seen:
                out[i].update(range(p, p + k))
            seen.add(run)
    return out


def hits(text, items, size):
    """(n_words, hit words, items) of a text; items: (id, text)."""
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = rx.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        v = rx.findall(lower(t))
        for s in range(max(1, len(v) - size + 1)) if v else ():
            win = v[s : s + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    if item is not None:
                        found.add(str(item))
    return len(w), hit, found

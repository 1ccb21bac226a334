"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are normalised to ``<space>word<space>word<space>``, so a window of item words is one byte string with a
space at each end.  Windows of like length share a table: the shift table tells for each hashed
block of text how far every window is away at least, suffix buckets name the windows that end in a
block of shift zero, and the window's bytes are then compared in place.  The search runs over many
lanes of a batch at once, each lane with its own place in the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches
from .scratch import Table

#: Item texts up to this many bytes are searched for in one pass; more are dealt to several passes.
ITEM_BYTES = 16 << 20
#: Lower bounds of the length classes that get a table each.
CLASSES = (2, 8, 16, 32)
TABLE_BITS = 18
LANE = 2048

#: Lower-cases ASCII letters and turns every byte that is no digit, ASCII letter or part of a longer character into a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BREAK = 1  # between documents; no window holds it


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def windows(text: str | None, size: int) -> list[bytes]:
    """The distinct windows of an item, as padded byte strings; an item of fewer words is one window."""
    w = item_words(text)
    return [] if not w else sorted({b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))})


def _slot(blocks: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def _at(data: bytes, width: int) -> np.ndarray:
    """The little-endian numbers of ``width`` bytes at every offset; data has 8 spare bytes at its end."""
    view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    return view if width == 8 else view & np.uint64((1 << 8 * width) - 1)


class WuManber:
    """Search tables of one class of patterns."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        mask = (1 << 8 * self.block) - 1
        self.mask = np.uint64(mask)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, dtype=np.int32)
        for end in range(self.block, self.m + 1):
            blocks = np.array([int.from_bytes(p[end - self.block : end], "little") for p in patterns], dtype=np.uint64)
            np.minimum.at(self.shift, _slot(blocks).astype(np.int64), self.m - end)
        last = np.array([int.from_bytes(p[self.m - self.block : self.m], "little") for p in patterns], dtype=np.uint64)
        first = np.array([int.from_bytes(p[: self.block], "little") for p in patterns], dtype=np.uint64)
        order = np.argsort(last, kind="stable")
        self.order, self.last, self.first = order, last[order], first[order]

    def find(self, data: bytes) -> list[tuple[int, int]]:
        """(position, index of pattern) of every occurrence; data has 8 spare bytes at its end."""
        n = len(data) - 8
        if n < self.m:
            return []
        view = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        p = np.arange(0, n - self.m + 1, LANE, dtype=np.int64)
        end = np.minimum(p + LANE, n - self.m + 1)
        found = []
        while len(p):
            s = self.shift[_slot(view[p + (self.m - self.block)] & self.mask).astype(np.int64)]
            zero = s == 0
            if zero.any():
                found.append(p[zero])
            p = p + np.maximum(s, 1)
            go = p < end
            p, end = p[go], end[go]
        if not found:
            return []
        at = np.concatenate(found)
        block = view[at + (self.m - self.block)] & self.mask
        lo, hi = np.searchsorted(self.last, block), np.searchsorted(self.last, block, side="right")
        count = hi - lo
        at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
        each = np.repeat(np.arange(len(at)), count)
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[each]
        same = (view[at[each]] & self.mask) == self.first[which]
        out = []
        for pos, k in zip(at[each[same]].tolist(), self.order[which[same]].tolist()):
            if data.startswith(self.patterns[k], pos):
                out.append((pos, k))
        return out


class Searcher:
    """All windows of a set of items, by class of length."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        of: dict[bytes, set[str]] = {}
        for item_id, text in items:
            for w in windows(text, size):
                of.setdefault(w, set())
                if item_id is not None:
                    of[w].add(item_id)
        by: dict[int, list[bytes]] = {}
        for w in sorted(of):
            by.setdefault(max(c for c in CLASSES if c <= len(w)), []).append(w)
        self.tables = [WuManber(p) for _, p in sorted(by.items())]
        self.items = [[sorted(of[w]) for w in t.patterns] for t in self.tables]
        self.words = [[w.count(b" ") - 1 for w in t.patterns] for t in self.tables]

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text its number of words, the hit spans of words, and the items that occur."""
        parts = [b" " + (t or "").encode("utf-8", "replace").translate(NORMAL) + b" \x01" for t in texts]
        at = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        space = raw == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[:1] = True
        at = np.concatenate(([0], np.cumsum(keep)))[at]
        norm = raw[keep]
        word_at = np.flatnonzero((norm[:-1] == 32) & (norm[1:] != BREAK))  # the space before each word
        base = np.searchsorted(word_at, at)
        data = norm.tobytes() + b"\0" * 8
        hits: dict[int, np.ndarray] = {}
        found: dict[int, set[str]] = {}
        for t, table in enumerate(self.tables):
            places = table.find(data)
            if not places:
                continue
            pos = np.array([p for p, _ in places])
            doc = np.searchsorted(at, pos, side="right") - 1
            first = np.searchsorted(word_at, pos)
            for d, f, (_, k) in zip(doc.tolist(), first.tolist(), places):
                if d not in hits:
                    hits[d], found[d] = np.zeros(base[d + 1] - base[d], dtype=bool), set()
                hits[d][f - base[d] : f - base[d] + self.words[t][k]] = True
                found[d].update(self.items[t][k])
        out = []
        for d in range(len(texts)):
            spans = []
            if d in hits:
                e = np.diff(hits[d].view(np.int8), prepend=np.int8(0), append=np.int8(0))
                spans = list(zip(np.flatnonzero(e == 1).tolist(), np.flatnonzero(e == -1).tolist()))
            out.append((int(base[d + 1] - base[d]), spans, found.get(d, set())))
        return out


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, size: int = 10) -> DataFrame:
    """One row per document: (id_col, n_words, spans, items).

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII.  spans are the
    maximal runs [start, end) of words that lie inside an occurrence of a window of ``size`` item
    words (an item of fewer words is one window), items the ids, as strings in order, of the items
    that occur.  A null or empty text has no words and no hits; a null or wordless item has no
    windows; windows of an item without an id make hits but name no item; repeated rows, of either
    table, change nothing else.  Other columns are ignored.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    total = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = total // ITEM_BYTES + 1
    spans_type = "array<struct<start:int,end:int>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = rows
    for turn in range(passes):  # one pass unless the items outgrow a worker; each keeps what the earlier found
        part = listed if passes == 1 else listed.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == turn)
        searcher = Searcher([(r["id"], r["text"]) for r in part.toLocalIterator()], size)
        shared = spark.sparkContext.broadcast(searcher)
        last, first = turn == passes - 1, turn == 0

        def search(batch: pa.RecordBatch, shared=shared, last=last, first=first) -> dict:
            got = shared.value.search(batch.column("text").to_pylist())
            spans, names = [g[1] for g in got], [g[2] for g in got]
            if not first:
                for i, (s, n) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                    names[i] = names[i] | set(n)
                    merged: list[list[int]] = []
                    for a, b in sorted(spans[i] + [(x["start"], x["end"]) for x in s]):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    spans[i] = merged
            return {"id": batch.column("id"), "n_words": np.array([g[0] for g in got], dtype=np.int64), "spans": [[{"start": a, "end": b} for a, b in s] for s in spans], "items": [sorted(n) for n in names]} | ({} if last else {"text": batch.column("text")})

        out = map_batches(out, "text", search, f"id {kind}, n_words long, spans {spans_type}, items array<string>" + ("" if last else ", text string"))
        if not last:
            out = Table(out, "searched").df
    return out.withColumnRenamed("id", id_col)
